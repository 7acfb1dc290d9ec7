"""Licence scans by patience alignment.

A text and a licence template are lists of words. Words that occur exactly once in both are anchors; the longest run of anchors in the same order
on both sides is kept (longest increasing subsequence by patience piles), and the gaps between anchors are aligned in the same way. Gaps
without an anchor are matched from both ends. The coverage of a template is the share of its words that are matched in a window of the text of at most
``slack`` times the template. Each window that may begin a copy is aligned on its own, and every place of every template is told, so copies that
follow each other or stand among other words of a template are all found.

A template is aligned only if the text holds enough of its different words to reach ``threshold``, which skips nothing that could.
Null, empty and wordless texts match nothing. Repeated rows get equal results. An input column ``licenses`` is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.ship import ship

WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")

#: Short notices and the operative paragraphs of common public licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, that rises in the second: patience piles with links back."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo >= hi or low >= high:
            continue
        mine = Counter(b[low:high])
        place = {w: j for j, w in enumerate(b[low:high], low) if mine[w] == 1}
        once: dict[str, int] = {}
        for i in range(lo, hi):
            if (w := a[i]) in place:
                once[w] = -1 if w in once else i
        anchors = _rising(sorted((i, place[w]) for w, i in once.items() if i >= 0))
        if not anchors:
            continue
        out += anchors
        edges = [(lo - 1, low - 1), *anchors, (hi, high)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = 0.8, slack: float = 1.5):
        self.templates = {name: words(t) for name, t in templates.items()}
        self.counts = {name: Counter(t) for name, t in self.templates.items()}
        self.vocabulary = {w for t in self.templates.values() for w in t}
        self.threshold, self.slack = threshold, slack

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) for every place where a template is covered well enough, best first; places of one template do not overlap."""
        tokens = words(text)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(tokens):
            if w in self.vocabulary:
                places.setdefault(w, []).append(i)
        found = []
        for name, template in self.templates.items():
            need = self.threshold * len(template)
            if sum(min(n, len(places.get(w, ()))) for w, n in self.counts[name].items()) < need:
                continue
            hits = sorted({i for w in self.counts[name] for i in places.get(w, ())})
            for matched, first, last in self._places(tokens, hits, template):
                found.append((name, matched / len(template), first, last))
        return sorted(found, key=lambda f: (-f[1], -len(self.templates[f[0]]), f[0], f[2]))

    def _places(self, tokens: list[str], hits: list[int], template: list[str]) -> list[tuple[int, int, int]]:
        """(matched words, first, last) of places that do not overlap, the best taken first and of equals the first.

        A window opens at every word of the template that may be its first matched one (so many words can be missing at most) and is aligned on its own, so nothing that
        stands before or beside a copy hides it. What a place takes is taken from the windows it overlaps, and these are aligned again.
        """
        need = self.threshold * len(template)
        openers = set(template[: len(template) - ceil(need) + 1])
        stops: set[tuple[int, int]] = set()
        taken, out = [], []
        for at, first in enumerate(hits):
            if tokens[first] in openers:
                for width in (len(template), int(self.slack * len(template))):
                    end = bisect_left(hits, first + width)
                    if end - at >= need:
                        stops.add((first, hits[end - 1] + 1))
        todo = [(*self._stretch(tokens, lo, hi, template), lo, hi) for lo, hi in sorted(stops)]
        heap = [(-m, a, b, lo, hi) for m, a, b, lo, hi in todo if m >= need]
        heapify(heap)
        while heap:
            less, a, b, lo, hi = heappop(heap)
            # places taken do not overlap, so those that touch the window stand in a row
            over = taken[max(0, bisect_left(taken, (lo, lo)) - 1) : bisect_left(taken, (hi, hi))]
            over = [(x, y) for x, y in over if lo <= y]
            if not any(x <= b and a <= y for x, y in over):
                insort(taken, (a, b))
                out.append((-less, a, b))
            else:  # what is left of the window on both sides of what was taken
                for left, right in zip([lo, *(y + 1 for _, y in over)], [*(x for x, _ in over), hi], strict=True):
                    if right - left >= need:
                        m, a, b = self._stretch(tokens, left, right, template)
                        if m >= need:
                            heappush(heap, (-m, a, b, left, right))
        return out

    def _stretch(self, tokens: list[str], lo: int, hi: int, template: list[str]) -> tuple[int, int, int]:
        """(matched words, first, last) of the alignment of ``tokens[lo:hi]``."""
        pairs = align(tokens[lo:hi], template)
        return (len(pairs), pairs[0][0] + lo, pairs[-1][0] + lo) if pairs else (0, lo, lo)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """``docs`` with ``licenses``: array of (license, coverage, first_word, last_word), best first."""
    ship(docs.sparkSession)
    kind = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())]))

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates, threshold)
        for texts in batches:
            yield pd.Series([[dict(zip(("license", "coverage", "first_word", "last_word"), f, strict=True)) for f in scanner.scan(t)] for t in texts], index=texts.index, dtype=object)

    return docs.withColumn("licenses", run(docs[text].cast("string")))
