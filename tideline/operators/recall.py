"""Candidate generation: co-visitation, vectors, heuristics, channels, implicit ALS, fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.shared import written
from tideline.functions.ship import ship
from tideline.operators.interactions import clicks


def _fold(df: DataFrame) -> list[str]:
    """The column that tells several models apart, if there is one."""
    return ["fold"] if "fold" in df.columns else []


def sessions(imp: DataFrame) -> DataFrame:
    return clicks(imp).select(*_fold(imp), "session_id", "item").distinct()


def _dealt_sessions(imp: DataFrame, rows: int = 500_000) -> DataFrame:
    """``sessions``, written once, in partitions of about ``rows`` by session, whose number follows the table: Spark would merge them by their bytes, before the pairs are made."""
    s = written(sessions(imp), "sessions")
    return s.repartition(max(1, -(-s.count() // rows)), "session_id", *_fold(imp))


def pair_counts(imp: DataFrame) -> DataFrame:
    """(item, neighbour, n): sessions that clicked both, in both directions. Both sides of the join share one shuffle on the session."""
    return _pairs(_dealt_sessions(imp))


def _pairs(s: DataFrame) -> DataFrame:
    by = _fold(s)
    a, b = s.alias("a"), s.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("session_id", *by)]
    pairs = a.join(b, [*same, F.col("a.item") != F.col("b.item")])
    return pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.item").alias("item"), F.col("b.item").alias("neighbour")).agg(F.count(F.lit(1)).alias("n"))


def covisitation(imp: DataFrame, damping: float = 0.5, min_count: int = 2, top_k: int = 100) -> DataFrame:
    """(item, neighbour, score, rank): damped pair counts, the best ``top_k`` of each item; a ``fold`` of the impressions keeps several apart."""
    by = _fold(imp)
    s = _dealt_sessions(imp)
    popularity = s.groupBy(*by, "item").agg(F.count(F.lit(1)).alias("p"))
    pairs = _pairs(s).filter(F.col("n") >= min_count)
    both = pairs.join(popularity, [*by, "item"]).join(popularity.select(*by, F.col("item").alias("neighbour"), F.col("p").alias("q")), [*by, "neighbour"])
    scored = both.withColumn("score", F.col("n") / (F.pow("p", F.lit(damping)) * F.pow("q", F.lit(1 - damping))))
    best = Window.partitionBy(*by, "item").orderBy(F.desc(F.round("score", 9)), "neighbour")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k).select(*by, "item", "neighbour", "score", "rank")


def covisit_scores(history: DataFrame, neighbours: DataFrame, exclude: bool = True) -> DataFrame:
    """(user_id, item, score): neighbours' scores pooled by the decayed weights of the history; the history itself left out if asked for."""
    pooled = history.join(neighbours, "item").groupBy("user_id", F.col("neighbour").alias("cand")).agg(F.sum(F.col("score") * F.col("decayed")).alias("score")).withColumnRenamed("cand", "item")
    return pooled.join(history.select("user_id", "item").distinct(), ["user_id", "item"], "left_anti") if exclude else pooled


def top_by(scored: DataFrame, key: str, k: int, score: str = "score", item: str = "item", digits: int = 6) -> DataFrame:
    """The best k of each key with their rank from 1; ties in the rounded score go to the smaller item."""
    best = Window.partitionBy(key).orderBy(F.desc(F.round(score, digits)), item)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` best, best first, ties by column: only what reaches the k-th score is sorted."""
    if k >= score.shape[1]:
        return np.argsort(-score, axis=1, kind="stable")
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(score), k), np.int64)
    for i, row in enumerate(score):
        at = np.flatnonzero(row >= least[i])
        out[i] = at[np.argsort(-row[at], kind="stable")][:k]
    return out


def _sides(queries: int, items: int, cores: int, least: int = 4096, most: tuple[int, int] = (32_768, 65_536)) -> tuple[int, int]:
    """Rows of a block of queries and of items. What is copied falls with the size of blocks, so these grow with the tables as long as every core has some, up to what a task holds."""
    side = int((queries * items / (4 * cores)) ** 0.5)
    return tuple(min(max(side, least), m) for m in most)


def blocked_topk(queries: DataFrame, items: DataFrame, key: str, k: int | Column, rows: int | None = None, digits: int = 6, cells: int = 1 << 22) -> DataFrame:
    """(key, item, score): for each query (key, ``q``) its best ``k`` items (item, ``v``) by dot product; ties in the rounded score go to the smaller item.

    Queries and items are dealt into blocks of about ``rows``, or as many as a task can hold; each pair of blocks is multiplied some queries at a time, ``cells`` products or so, and gives back ``k`` rows a
    query, and the blocks' best are merged. Block numbers have one type on both sides, as Spark places an int and a bigint apart. No task holds more than a block of each side. ``k`` may be a column of the
    queries, such as the length of a history that is taken out afterwards.
    """
    ship(items.sparkSession)
    items, queries = written(items.select("item", "v"), "items"), written(queries.select(key, "q", (k if isinstance(k, Column) else F.lit(k)).cast("int").alias("k")), "queries")
    n_items, n_queries = items.count(), queries.count()
    of_query, of_items = (rows, rows) if rows else _sides(n_queries, n_items, items.sparkSession.sparkContext.defaultParallelism)
    across, down = max(1, -(-n_items // of_items)), max(1, -(-n_queries // of_query))
    left = queries.select(key, "q", "k", F.pmod(F.xxhash64(key), F.lit(down)).cast("int").alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"))
    right = items.select("item", "v", F.pmod(F.xxhash64("item"), F.lit(across)).cast("int").alias("across"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({key: [], "item": [], "score": [], "k": []})
        b = b.sort_values("item")
        q, v, names = np.stack(a["q"]), np.stack(b["v"]).T, b["item"].to_numpy()
        most, found, scores = np.minimum(a["k"].to_numpy(), len(b)), [], []
        step = max(1, cells // len(b))
        for i in range(0, len(a), step):
            score, n = q[i : i + step] @ v, most[i : i + step]
            best = _best(np.round(score, digits), max(1, int(n.max())))
            at = best[np.arange(best.shape[1]) < n[:, None]]
            found.append(names[at])
            scores.append(score[np.repeat(np.arange(len(n)), n), at])
        row = np.repeat(np.arange(len(a)), most)
        return pd.DataFrame({key: a[key].to_numpy()[row], "item": np.concatenate(found), "score": np.concatenate(scores), "k": a["k"].to_numpy()[row]})

    schema = f"{key} {dict(queries.dtypes)[key]}, item {dict(items.dtypes)['item']}, score double, k int"
    parts = left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInPandas(lambda a, b: cell(a, b), schema)
    best = Window.partitionBy(key).orderBy(F.desc(F.round("score", digits)), "item")
    return parts.withColumn("rank", F.row_number().over(best)).filter("rank <= k").select(key, "item", "score")


def channel_scores(affinity: DataFrame, items: DataFrame, quality: Column) -> DataFrame:
    """(user_id, item, score) from (user_id, channel_id, affinity): every item of every channel. For lists see ``channel_topk``."""
    return affinity.join(items.withColumn("__q", quality), "channel_id").select("user_id", F.col("video_id").alias("item"), (F.col("affinity") * (1 + 0.15 * F.log1p("__q"))).alias("score"))


def channel_topk(affinity: DataFrame, items: DataFrame, quality: Column, seen: DataFrame, k: int, bins: int = 512, digits: int = 6) -> DataFrame:
    """(user_id, item, score, rank): the best ``k`` of ``channel_scores`` that ``seen`` (user_id, item) lacks, without scoring whole channels.

    In a channel, scores go with the item's lift. ``k`` and as many more as a user has seen there is how deep a list can go, so the score at that depth, the greatest over the user's channels, is the
    least that counts. Only lifts that reach it are met, by bins of the lift, and of items of equal lift only the first that deep. Channels without positive affinity are scored as a whole.
    """
    lift = items.select("channel_id", F.col("video_id").alias("item"), (1 + 0.15 * F.log1p(quality)).alias("lift")).filter("channel_id is not null and lift is not null")
    equal, whole = Window.partitionBy("channel_id", "lift").orderBy("item"), Window.partitionBy("channel_id").orderBy(F.desc("lift"), "item")
    ladder = written(lift.withColumns({"nth": F.row_number().over(equal), "depth": F.row_number().over(whole), "bin": F.floor(F.col("lift") * bins)}), "ladder")
    gone = written(seen.select("user_id", "item").distinct(), "seen")
    known = gone.join(ladder.select("item", "channel_id"), "item").groupBy("user_id", "channel_id").agg(F.count(F.lit(1)).alias("n_seen"))
    asked = affinity.filter("affinity > 0").join(known, ["user_id", "channel_id"], "left").withColumn("need", F.coalesce("n_seen", F.lit(0)) + k)
    at = ladder.select("channel_id", F.col("depth").cast("long").alias("need"), F.col("lift").alias("at"))
    asked = asked.join(at, ["channel_id", "need"], "left").withColumn("least", F.max(F.round(F.col("affinity") * F.col("at"), digits)).over(Window.partitionBy("user_id")))
    low = F.coalesce((F.col("least") - 10.0**-digits) / F.col("affinity"), F.lit(float("-inf")))
    top = ladder.groupBy("channel_id").agg(F.min("lift").alias("bottom"), F.max("bin").alias("top"))
    asked = asked.join(top, "channel_id").select("user_id", "channel_id", "affinity", "need", "least", F.greatest(low, F.col("bottom")).alias("low"), "top")
    asked = written(asked.filter(F.floor(F.col("low") * bins) <= F.col("top")), "asked")
    used = ladder.join(asked.groupBy("channel_id").agg(F.min("low").alias("lowest"), F.max("need").alias("deepest")), "channel_id").filter("lift >= lowest and nth <= deepest").select("channel_id", "bin", "item", "lift", "nth")
    reached = asked.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * bins), F.col("top"))))
    met = reached.join(written(used, "ladder"), ["channel_id", "bin"]).filter("lift >= low and nth <= need").withColumn("score", F.col("affinity") * F.col("lift"))
    met = met.filter(F.col("least").isNull() | (F.round("score", digits) >= F.col("least"))).select("user_id", "item", "score")
    rest = channel_scores(affinity.filter("affinity <= 0"), items, quality)
    return top_by(met.unionByName(rest).join(gone, ["user_id", "item"], "left_anti"), "user_id", k)


#: Weights of the sources; a source without one counts 1.
SOURCE_WEIGHTS = {"content": 1.0, "covisit": 1.15, "als": 1.10, "channel": 0.75, "trending": 0.45}


def fuse(candidates: DataFrame, key: str, weights: dict[str, float] = SOURCE_WEIGHTS, k: float = 60.0, most: int = 400) -> DataFrame:
    """(key, item, fused, sources, rank): reciprocal ranks of (key, source, item, score) summed over the sources, with provenance."""
    in_source = Window.partitionBy(key, "source").orderBy(F.desc(F.round("score", 6)), "item")
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(1.0))
    ranked = candidates.withColumn("place", F.row_number().over(in_source) - 1)
    fused = ranked.groupBy(key, "item").agg(F.sum(weight / (k + F.col("place") + 1)).alias("fused"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", F.struct(F.col("place").alias("rank"), "score"))))).alias("sources"))
    return top_by(fused, key, most, "fused", digits=9)


class ImplicitALS:
    """Implicit-feedback factorisation: confidence 1 + alpha r, constant ridge, alternating exact solves.

    Several models may be fitted at once, told apart by a column ``fold`` of the interactions; each has its own Gram matrix, all else is keyed by (fold, id).
    Interactions move to their id with the other side's factor, sorted, and are summed to normal equations (their upper triangle) as they come in; an id of very many is dealt into parts, each of
    which moves one partial sum. Factors travel by join, not by broadcast, and are stored after each half round; only the f x f Gram matrices go through the driver.
    """

    def __init__(self, factors: int = 8, ridge: float = 0.05, alpha: float = 30.0, iterations: int = 3):
        self.f, self.ridge, self.alpha, self.iterations = factors, ridge, alpha, iterations
        self.triangle = np.triu_indices(factors)

    def start(self, ids: DataFrame) -> DataFrame:
        """(fold, id, y): small values from integer arithmetic."""
        cells = [(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) * 0.2 for j in range(self.f)]
        return ids.select("fold", "id", F.array(*cells).alias("y"))

    def gram(self, factors: DataFrame) -> dict[int, np.ndarray]:
        f = self.f

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for fold, ys in b.groupby("fold")["y"]:
                    y = np.stack(ys)
                    sums[fold] = sums.get(fold, 0.0) + y.T @ y
            yield pd.DataFrame({"fold": list(sums), "g": [g.ravel() for g in sums.values()]})

        out: dict[int, np.ndarray] = {}
        for r in factors.select("fold", "y").mapInPandas(part, "fold int, g array<double>").select("fold", F.posexplode("g")).groupBy("fold", "pos").agg(F.sum("col").alias("x")).collect():
            out.setdefault(r.fold, np.zeros(f * f))[r.pos] = r.x
        return {fold: g.reshape(f, f) for fold, g in out.items()}

    def half_step(self, ratings: DataFrame, other: DataFrame) -> DataFrame:
        """(fold, id, y) solved from (fold, id, other, r) and the other side's (fold, id, y)."""
        ship(ratings.sparkSession)
        f, alpha, ridge, (up, down), grams = self.f, self.alpha, self.ridge, self.triangle, self.gram(other)
        kind, width = dict(ratings.dtypes)["id"], len(up) + f
        rows = ratings.join(other.select("fold", F.col("id").alias("other"), "y"), ["fold", "other"]).select("fold", "id", F.pmod(F.xxhash64("other"), "parts").alias("part"), "parts", "r", "y")

        def runs(b: pd.DataFrame, cells: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
            """Sums of the rows of each (fold, id, part), which follow each other, and the first row of each."""
            firsts = np.flatnonzero((b["fold"].diff().ne(0) | (b["id"] != b["id"].shift()) | b["part"].diff().ne(0)).to_numpy())
            return np.add.reduceat(cells, firsts, axis=0), b[["fold", "id", "part", "parts"]].iloc[firsts]

        def summed(batches: Iterator[pd.DataFrame], cells: Callable[[pd.DataFrame], np.ndarray]) -> Iterator[pd.DataFrame]:
            """Sums of sorted rows; a group that a batch ends in is carried to the next."""
            head, last = None, None
            for b in batches:
                if len(b) == 0:
                    continue
                s, heads = runs(b, cells(b))
                if head is not None:
                    if tuple(head.iloc[0]) == tuple(heads.iloc[0]):
                        s[0] += last
                    else:
                        s, heads = np.concatenate([last[None], s]), pd.concat([head, heads])
                head, last = heads.iloc[-1:], s[-1].copy()
                if len(s) > 1:
                    yield heads.iloc[:-1].assign(s=list(s[:-1]))
            if head is not None:
                yield head.assign(s=[last])

        def equations(b: pd.DataFrame) -> np.ndarray:
            y, c = np.stack(b["y"]), alpha * b["r"].to_numpy()
            return np.concatenate([y[:, up] * y[:, down] * c[:, None], y * (1 + c)[:, None]], axis=1)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from summed(batches, equations)

        def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in summed((x.assign(part=0) for x in batches), lambda b: np.stack(b["s"])):
                a = np.stack(b["s"]).reshape(-1, width)
                left = np.empty((len(a), f, f))
                left[:, up, down] = left[:, down, up] = a[:, : len(up)]
                left += np.stack([grams[i] for i in b["fold"]]) + ridge * np.eye(f)
                yield pd.DataFrame({"fold": b["fold"].to_numpy(), "id": b["id"].to_numpy(), "y": list(np.linalg.solve(left, a[:, len(up) :, None])[:, :, 0])})

        sorted_by = lambda df, *by: df.repartition(*by).sortWithinPartitions(*by)
        partial = sorted_by(rows, "fold", "id", "part").mapInPandas(sums, f"fold int, id {kind}, part long, parts long, s array<double>")
        return sorted_by(partial, "fold", "id").mapInPandas(solved, f"fold int, id {kind}, y array<double>")

    @staticmethod
    def _dealt(ratings: DataFrame, rows: int = 65536) -> DataFrame:
        """``ratings`` with the number of ``parts`` that an id's are dealt into, of about ``rows`` each."""
        n = ratings.groupBy("fold", "id").agg(F.ceil(F.count(F.lit(1)) / rows).cast("long").alias("parts"))
        return ratings.join(n, ["fold", "id"])

    @staticmethod
    def _keyed(user_item: DataFrame) -> DataFrame:
        fold = F.col("fold").cast("int") if "fold" in user_item.columns else F.lit(0)
        return user_item.select(fold.alias("fold"), F.col("user_id").alias("id"), F.col("item").alias("other"), F.col("weight").alias("r"))

    def fit_folds(self, user_item: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(users, items), each (fold, id, y), from (fold, user_id, item, weight)."""
        keyed = written(self._keyed(user_item), "ratings")
        by_user = written(self._dealt(keyed), "ratings")
        by_item = written(self._dealt(keyed.select("fold", F.col("other").alias("id"), F.col("id").alias("other"), "r")), "ratings")
        items = written(self.start(by_item.select("fold", "id").distinct()), "factors")
        for _ in range(self.iterations):
            users = written(self.half_step(by_user, items), "factors")
            items = written(self.half_step(by_item, users), "factors")
        return users, items

    def fit(self, user_item: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(users, items), each (id, y), from (user_id, item, weight)."""
        users, items = self.fit_folds(user_item.drop("fold"))
        return users.drop("fold"), items.drop("fold")

    def fold_in(self, user_item: DataFrame, items: DataFrame) -> DataFrame:
        """(id, y), with fold if ``items`` have one, of users that were not in the fit."""
        many = "fold" in items.columns
        out = self.half_step(self._dealt(self._keyed(user_item)), items if many else items.withColumn("fold", F.lit(0)))
        return out if many else out.drop("fold")
