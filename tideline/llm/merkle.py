"""A Merkle manifest of a table: one tree for each value of a column, and one over the roots of these trees.

A row's leaf is the SHA-256 of its columns, in hex. The leaves of a tree ascend by key; ``fanout`` consecutive nodes become the hash of their digests, the last
run of a level may be shorter, down to a single node; a tree of one leaf is that leaf. The roots of the trees, ordered by their value (null first, then by UTF-8 bytes), are the leaves of the upper tree.

Places come from one range partitioning by (tree, key, leaf): a row's place is its place in its partition after the rows of the partitions before. A tree is hashed in
aligned blocks of at most ``BLOCK_NODES`` nodes (a power of the fanout), each a contiguous matrix of 64 hex bytes a row that a task reshapes by the fanout and hashes level by level;
block roots are the next nodes. Then paths go down again, block by block, and every sibling is found by index arithmetic. No tree passes through one task: tasks have one block.

Null values are written ``-``. Rows with equal keys are ordered by leaf, so repeated rows, which are equal, have places beside one another. Null keys come first. An empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.ship import ship
from tideline.llm.common import written

HEX = 64
#: Nodes of one block at the most.
BLOCK_NODES = 4096
PATH = "before array<string>, after array<string>"


def leaf_of(columns: list[Column]) -> Column:
    """SHA-256 of the columns' values, each as its UTF-8 length, a colon and itself, or ``-`` if null."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def levels_of(n: int, fanout: int) -> int:
    """How often n nodes are hashed until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def hashed(leaves: np.ndarray, fanout: int, levels: int) -> list[np.ndarray]:
    """The digest matrices of a block: the leaves and what they become, level by level."""
    out = [np.ascontiguousarray(leaves)]
    for _ in range(levels):
        m = out[-1]
        full = len(m) // fanout * fanout
        digests = [sha256(run).hexdigest() for run in m[:full].reshape(-1, fanout * HEX)]
        if full < len(m):
            digests.append(sha256(m[full:].tobytes()).hexdigest())
        out.append(matrix(digests))
    return out


def matrix(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode("ascii"), np.uint8).reshape(-1, HEX)


def paths(levels: list[np.ndarray], fanout: int, at: np.ndarray) -> list[tuple[list[bytes], list[bytes]]]:
    """For each level below the root and each leaf in ``at``: the siblings' digests before and after its node."""
    out = []
    for m in levels[:-1]:
        first, end = at // fanout * fanout, np.minimum(at // fanout * fanout + fanout, len(m))
        flat = m.tobytes()
        out.append(([flat[a * HEX : i * HEX] for a, i in zip(first, at, strict=True)], [flat[(i + 1) * HEX : e * HEX] for i, e in zip(at, end, strict=True)]))
        at = at // fanout
    return out


def folded(leaf: bytes, before: list[bytes], after: list[bytes]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for b, a in zip(before, after, strict=True):
        leaf = sha256(b + leaf + a).hexdigest().encode("ascii")
    return leaf


def _placed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its place ``pos`` among the rows of its ``tree``, by ``key`` and ``digest``, and the tree's ``size``. ``row`` tells equal rows apart."""
    ranges = df.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("tree", key, "digest", "row").sortWithinPartitions("tree", key, "digest", "row").drop("row")
    ranges = written(ranges.withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id()}), "ranges")
    of_tree = Window.partitionBy("tree")
    sizes = ranges.groupBy("tree", "part").agg(F.min("i").alias("low"), F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumns({"start": F.sum("n").over(of_tree.orderBy("part")) - F.col("n"), "size": F.sum("n").over(of_tree)}).drop("n")
    return ranges.join(sizes, ["tree", "part"]).withColumn("pos", F.col("i") - F.col("low") + F.col("start")).drop("part", "i", "low", "start")


class _Tree:
    """How nodes, given as (tree, pos, size, digest), are hashed into one root for each tree, and paths handed down to them."""

    def __init__(self, fanout: int):
        self.fanout, self.deep = fanout, max(1, int(math.log(BLOCK_NODES, fanout) + 1e-9))
        self.width = fanout**self.deep

    def blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(self.width)))

    def local(self, size: int) -> int:
        """Levels that are hashed in a block of a tree with so many nodes."""
        return self.deep if size > self.width else levels_of(size, self.fanout)

    def climb(self, nodes: DataFrame) -> list[DataFrame]:
        """The nodes and the roots of their blocks, again and again, until every tree has one."""
        fanout, width, local = self.fanout, self.width, self.local

        def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("pos")
            size = int(rows["size"].iloc[0])
            root = hashed(matrix(rows["digest"].tolist()), fanout, local(size))[-1]
            return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "size": [-(-size // width)], "digest": [root.tobytes().decode("ascii")]})

        levels = [nodes]
        while (levels[-1].agg(F.max("size")).first()[0] or 1) > 1:
            grouped = self.blocks(levels[-1].select("tree", "pos", "size", "digest")).groupBy("tree", "block")
            levels.append(written(grouped.applyInPandas(up, "tree string, pos long, size long, digest string"), "nodes"))
        return levels

    def descend(self, nodes: DataFrame, above: DataFrame, schema: str, make: Callable[..., pd.DataFrame]) -> DataFrame:
        """``make(rows, before, after, n)`` for the rows of each block, in order: each row's siblings before and after it at every level up to the root, of which ``n`` levels are the block's own. ``above`` has the blocks' paths."""
        fanout, local = self.fanout, self.local

        def down(rows: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("pos").reset_index(drop=True)
            levels = hashed(matrix(rows["digest"].tolist()), fanout, local(int(rows["size"].iloc[0])))
            by_level = paths(levels, fanout, np.arange(len(rows)))
            before, after = ([[*[x[side][i] for x in by_level], *[s.encode("ascii") for s in rest]] for i in range(len(rows))] for side, rest in enumerate((over["before"].iloc[0], over["after"].iloc[0])))
            return make(rows, before, after, len(by_level))

        return self.blocks(nodes).groupBy("tree", "block").cogroup(above.groupBy("tree", "pos")).applyInPandas(down, schema)

    def hand_down(self, levels: list[DataFrame], above: DataFrame) -> DataFrame:
        """(tree, pos, before, after) of the nodes of ``levels[0]``; ``above`` has those of the roots."""
        decode = lambda paths: [[x.decode("ascii") for x in p] for p in paths]
        for nodes in reversed(levels[:-1]):
            make = lambda rows, before, after, n: pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "before": decode(before), "after": decode(after)})
            above = written(self.descend(nodes.select("tree", "pos", "size", "digest"), above, f"tree string, pos long, {PATH}", make), "paths")
        return above


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", tree: str = "lang", fanout: int = 2, claimed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: the key, ``leaf``, ``position`` and ``size`` of its tree, ``subroot``, ``root``, ``proof`` (the siblings' digests in a row, upwards) and ``folded_root``.

    ``folded_root`` is what the row's own leaf and its proof lead to; for rows ``where`` it is the leaf with the columns of ``claimed`` in place of their own, so that
    anything but the recorded row leads elsewhere. ``verified`` tells whether it is the root. Other columns of ``docs`` are left out.
    """
    ship(docs.sparkSession)
    claimed = claimed or {}
    own = [docs[c] for c in columns]
    other = F.when(F.lit(False) if where is None else where, leaf_of([claimed.get(c, docs[c]) for c in columns]))
    named = F.coalesce(F.concat(F.lit("="), docs[tree].cast("string")), F.lit(""))
    rows = _placed(docs.select(named.alias("tree"), docs[key].alias("key"), leaf_of(own).alias("digest"), other.alias("other")), "key")

    hashing = _Tree(fanout)
    levels = hashing.climb(rows)
    upper = written(_placed(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "of"), "subroots")
    upper_levels = hashing.climb(upper)
    top = upper_levels[-1].select("tree", "pos", "digest", *[F.array().cast("array<string>").alias(c) for c in ("before", "after")])
    root = F.lit(next((r.digest for r in top.select("digest").take(1)), None))
    above = hashing.hand_down(upper_levels, top).join(upper.select("pos", "of"), "pos").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "before", "after")
    above = hashing.hand_down(levels[1:] or levels, above)

    def finish(rows: pd.DataFrame, before: list[list[bytes]], after: list[list[bytes]], n: int) -> pd.DataFrame:
        proof, ends, known = [], [], {}
        for record, claim, b, a in zip(rows["digest"], rows["other"], before, after, strict=True):
            proof.append(b"".join([x for pair in zip(b, a, strict=True) for x in pair]).decode("ascii"))
            at = folded((claim or record).encode("ascii"), b[:n], a[:n])
            if at not in known:  # most rows of a block meet in its root and go on alike
                known[at] = folded(at, b[n:], a[n:]).decode("ascii")
            ends.append(known[at])
        size = int(rows["size"].iloc[0])
        in_tree = levels_of(size, fanout)
        subroot = folded(rows["digest"].iloc[0].encode("ascii"), before[0][:in_tree], after[0][:in_tree]).decode("ascii")
        return pd.DataFrame({"key": rows["key"], "leaf": rows["digest"], "position": rows["pos"], "size": size, "subroot": subroot, "proof": proof, "folded_root": ends})

    kind = docs.schema[key].dataType.simpleString()
    out = hashing.descend(rows, above, f"key {kind}, leaf string, position long, size long, subroot string, proof string, folded_root string", finish)
    return out.select(F.col("key").alias(key), "leaf", "position", "size", "subroot", root.alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))
