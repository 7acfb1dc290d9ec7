"""The template tree of the URL filter against the same tree in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tideline.llm import queries, urls

SF = "/root/testdata/sf0.01"


def shape(s):
    if re.fullmatch("[0-9]+", s):
        return "{n}"
    if re.fullmatch(r"[0-9]+\.[A-Za-z0-9]{1,5}", s):
        return "{n}." + s.rsplit(".", 1)[1]
    return "{h}" if re.fullmatch(r"[0-9a-fA-F\-]{8,}", s) else s


def split(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c < "\x80" else c for c in rest[:end])
    return host, re.split("[?#]", rest[end:], maxsplit=1)[0]


def rule_of(host, path, rules):
    fits = []
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def tree(rows, min_child=3, min_branch=8):
    """{(host, shapes): template}; rows: (host, shapes, bad)."""
    out, going = {}, {r[:2]: () for r in rows}
    level = 0
    while going:
        branch = defaultdict(list)
        for host, shapes, bad in rows:
            if (host, shapes) in going:
                if len(shapes) <= level:
                    out[host, shapes] = going[host, shapes]
                else:
                    branch[host, going[host, shapes]].append((shapes, bad))
        following = {}
        for (host, template), members in branch.items():
            if len(members) < min_branch:
                for shapes, _ in members:
                    out[host, shapes] = (*template, "**")
                continue
            kids, pool = defaultdict(Counter), Counter()
            good, bad_ = Counter(), Counter()
            for shapes, bad in members:
                nxt = shapes[level + 1] if len(shapes) > level + 1 else "{end}"
                kids[shapes[level]][nxt] += 1
                pool[nxt] += 1
                good[shapes[level]] += bad == 0
                bad_[shapes[level]] += bad == 1
            free = len(pool) - 1
            fits = set()
            for child, counts in kids.items():
                n = sum(counts.values())
                chi = sum(c * c / (n * pool[f] / len(members)) for f, c in counts.items()) - n
                alike = len(kids) > 1 and chi <= free + 2 * (2 * free) ** 0.5 + 1e-9
                if not child.startswith("{") and (alike or n < min_child):
                    fits.add(child)
            labelled = sum(good[c] + bad_[c] for c in fits)
            share = sum(bad_[c] for c in fits) / labelled if labelled else 0
            for child in list(fits):
                mine = good[child] + bad_[child]
                if mine and (bad_[child] - mine * share) ** 2 > 4 * mine * share * (1 - share) + 1e-9:
                    fits.discard(child)
            for shapes, _ in members:
                following[host, shapes] = (*template, "*" if shapes[level] in fits else shapes[level])
        going, level = following, level + 1
    return out


def judged(pages, rules, label=None, alpha=2.0, prior=0.1, purity=0.5):
    rows, rule = [], {}
    for i, url in enumerate(pages):
        host, path = split(url)
        rule[i] = rule_of(host, path, rules)
        bad = label[i] if label else {"block": 1, "allow": 0}.get(rule[i][1])
        rows.append((host, tuple(shape(s) for s in path.split("/") if s), bad))
    template = tree(rows)
    of_host, of_all = defaultdict(list), defaultdict(list)
    for host, shapes, bad in rows:
        if bad is not None:
            t = template[host, shapes]
            for k in range(len(t) + 1):
                of_host[host, t[:k]].append(bad)
                of_all[t[:k]].append(bad)
    out = []
    for i, (host, shapes, _) in enumerate(rows):
        t = template[host, shapes]
        found = next((of_host[host, t[:k]] for k in range(len(t), -1, -1) if (host, t[:k]) in of_host), None)
        found = found or next((of_all[t[:k]] for k in range(len(t), -1, -1) if t[:k] in of_all), [])
        share = (sum(found) + alpha * prior) / (len(found) + alpha)
        out.append((rule[i][0], rule[i][1] or ("block" if share >= purity else "allow"), "/" + "/".join(t), round(share, 9)))
    return out


def compare(spark, pages, rules, label=None):
    df = spark.createDataFrame([(i, u, label[i] if label else None) for i, u in enumerate(pages)], "page_id long, url string, mark int")
    got = {r.page_id: (r.rule, r.verdict, r.template, round(r.template_share, 9)) for r in urls.judge(df, rules, label="mark" if label else None).collect()}
    want = dict(enumerate(judged(pages, rules, label)))
    assert got == want
    return want


def test_the_pages_of_the_query(spark):
    pages = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    out = compare(spark, pages, queries.RULES)
    free = [v for rule, v, *_ in out.values() if rule is None]
    assert "block" in free and "allow" in free  # the templates decide


@pytest.mark.parametrize("seed", range(3))
def test_random_trees_with_labels(spark, seed):
    rnd = random.Random(seed)
    pages, label = [], []
    for _ in range(900):
        host = rnd.choice(["a.com", "b.com", "c.org"])
        kind = rnd.choice(["shop", "blog", "user", f"t{rnd.randrange(40)}"])
        depth = rnd.randrange(7)
        tail = [rnd.choice(["x", "y", str(rnd.randrange(999)), f"{rnd.randrange(99)}.html", "deadbeef01"]) for _ in range(depth)]
        pages.append(f"https://{host}/{'/'.join([kind, *tail])}")
        label.append(rnd.choice([None, int(kind == "shop" or "x" in tail)]))
    out = compare(spark, pages, [("block", "b.com/blog/")], label)
    assert len({t for *_, t, _ in out.values()}) > 10


@pytest.mark.parametrize("seed", range(2))
def test_deep_paths_in_common(spark, seed):
    rnd = random.Random(seed)
    stem = [rnd.choice(["a", "b", str(rnd.randrange(99))]) for _ in range(40)]
    pages, label = [], []
    for _ in range(120):
        cut = stem[: rnd.choice([3, 10, 25, 40, 40])]
        tail = rnd.choice([[], [], ["end"], [f"e{rnd.randrange(30)}", "z"], ["k"] * rnd.randrange(12)])
        pages.append(f"https://{rnd.choice(['a.com', 'a.com', 'b.com'])}/{'/'.join([*cut, *tail])}")
        label.append(rnd.choice([None, int("end" in tail)]))
    pages += ["https://trap.com/" + "/".join(["a"] * n) for n in range(1, 60)] + ["https://wall.com/" + "/".join(stem * 8) + f"/p{i}" for i in range(20)]
    label += [rnd.choice([None, 0, 1]) for _ in range(79)]
    compare(spark, pages, [("block", "b.com/a/")], label)


def test_edge_cases(spark):
    long = "https://h.com/" + "/".join(["seg"] * 60) + "/" + "q" * 50_000
    pages = [None, "", "no scheme", "x://", "http://H.COM", "http://h.com//a///b?c#d", long, "http://h.net/x", "http://h.net/x", "ftp://h.org/fr/1"]
    compare(spark, pages, queries.RULES)
    clash = spark.createDataFrame([(1, "http://a.net/", "v", "t")], "page_id long, url string, verdict string, template string")
    assert urls.judge(clash, queries.RULES).collect()[0].verdict == "block"
    assert urls.judge(clash.limit(0), queries.RULES).count() == 0
    nulls = spark.createDataFrame([(None, "http://a.net/"), (None, None)], "page_id long, url string")
    assert urls.judge(nulls, queries.RULES).count() == 2
