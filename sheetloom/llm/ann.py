"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by a codebook of their own, so that a pair of centroids names one of
many fine cells. A query walks through the pairs by the sum of its two squared distances, from a heap that holds
the border of what it has seen, until the cells hold the wanted share of the distinct vectors; the sum it stops at
tells of every row whether it is to be ranked again, by its true distance.

Bounded samples (SAMPLE rows with the smallest hashes of vec_id) fit the codebooks and choose the share: the least
whose recall among the sample reaches TARGET. Every row is indexed. The driver gets the sample, the codebooks and
a count for each pair of centroids, whose number is bounded, too. Rows are dealt by their first centroid and, where
that is frequent, by a hash of vec_id into blocks; a query goes only to those first centroids that it reaches, and
takes at most k vec_ids from a block. Many copies of a vector count once when cells are counted, as do many rows of
a vec_id, so that the cells seen hold enough that may be listed.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of another
length than most. Rows with the query's own vec_id are no candidates; a vec_id that occurs more often is listed
once, with its least distance. Ties go to the smaller vec_id. An empty table gives an empty result. Columns other than the two asked for aren't looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches

CENTROIDS, SAMPLE, ROUNDS = 128, 16_384, 12
TARGET = 0.96
SHARES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 1.0)
#: Rows of a block, on average, and queries ranked together.
BLOCK, TOGETHER = 8192, 256


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    small_batches(rows.sparkSession)
    v = F.col("v")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    found = rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine)
    sizes = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return found.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means, started from k distinct vectors (fewer if there are no more)."""
    rng = np.random.default_rng(7)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        own = squared(x, c).argmin(1)
        n, total = np.bincount(own, minlength=len(c)), np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def reach(first: np.ndarray, second: np.ndarray, cells: dict[int, int], wanted: int) -> float:
    """The sum of distances at which the cells seen hold `wanted` vectors: pairs in ascending order, from a heap."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    wide, held, at = len(second), 0, 0.0
    border = [(x[0] + y[0], 0, 0)]
    while border:
        at, i, j = heapq.heappop(border)
        held += cells.get(a[i] * wide + b[j], 0)
        if held >= wanted:
            return at
        if i + 1 < len(x) and j == 0:
            heapq.heappush(border, (x[i + 1] + y[0], i + 1, 0))
        if j + 1 < wide:
            heapq.heappush(border, (x[i] + y[j + 1], i, j + 1))
    return float("inf")


class Index:
    """Codebooks of the two halves, and the share of the vectors to rank again."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS, target: float = TARGET, k: int = 10):
        sample = np.unique(sample, axis=0)
        self.half = max(1, sample.shape[1] // 2)
        self.books = [codebook(sample[:, : self.half], centroids), codebook(sample[:, self.half :], centroids) if sample.shape[1] > 1 else np.zeros((1, 0))]
        self.share = self.tuned(sample, target, k)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.books[0]), squared(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(x)
        return a.argmin(1), b.argmin(1)

    def tuned(self, sample: np.ndarray, target: float, k: int, asked: int = 200) -> float:
        rng = np.random.default_rng(11)
        sample = sample[rng.permutation(len(sample))]
        asked = min(asked, len(sample))
        if len(sample) <= 20 * k:
            return 1.0
        a, b = self.cells(sample)
        one, two = self.distances(sample[:asked])
        sums, true = one[:, a] + two[:, b], squared(sample[:asked], sample)
        sums[np.arange(asked), np.arange(asked)] = true[np.arange(asked), np.arange(asked)] = np.inf
        near = np.take_along_axis(sums, np.argpartition(true, k, axis=1)[:, :k], axis=1)
        rank = (sums[:, None, :] < near[:, :, None]).mean(axis=2) if len(sample) * asked * k < 4e7 else np.stack([np.searchsorted(np.sort(s), n) / len(s) for s, n in zip(sums, near, strict=True)])
        return next(s for s in SHARES if s == 1.0 or (rank <= s).mean() >= target)


def nearest(index_rows: DataFrame, queries: DataFrame, k: int = 10, centroids: int = CENTROIDS, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, both given as (vec_id, v)."""
    spark = index_rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    # hashes above the share of the rows that are wanted stay where they are, so that what is sent doesn't grow with the input
    share, h = min(1.0, 1.5 * SAMPLE / max(1, index_rows.count())), F.xxhash64("vec_id")
    sample = index_rows.where(h <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))).orderBy(h, "vec_id").limit(SAMPLE).select("v").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    index = Index(np.array([r["v"] for r in sample], float), centroids, target, k)
    wide = len(index.books[1])

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                a, b = index.cells(np.stack(rows["v"].to_numpy()))
                yield rows.assign(first=a.astype("int64"), second=b.astype("int64"))

    found = index_rows.mapInPandas(celled, "vec_id long, v array<double>, first long, second long")
    once = found.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "first", "second")).alias("one"))
    distinct = once.select("one.first", "one.second", "one.h").distinct().groupBy("first", "second").count()
    cells = {r["first"] * wide + r["second"]: r["count"] for r in distinct.collect()}
    counts = {r["first"]: r["count"] for r in found.groupBy("first").count().collect()}
    blocks = {a: -(-n // BLOCK) for a, n in counts.items()}
    wanted = max(k + 1, int(np.ceil(index.share * sum(cells.values()))))
    present = np.zeros((len(index.books[0]), wide), bool)
    for c in cells:
        present[c // wide, c % wide] = True

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            one, two = index.distances(np.stack(rows["v"].to_numpy()))
            out = []
            for i, (x, y) in enumerate(zip(one, two, strict=True)):
                limit = reach(x, y, cells, wanted)
                closest = np.where(present, y[None, :], np.inf).min(axis=1)
                out += [(i, limit, a, s) for a in np.flatnonzero(x + closest <= limit).tolist() for s in range(blocks.get(a, 0))]
            i = np.array([o[0] for o in out], np.int64)
            yield pd.DataFrame({"query_id": rows["vec_id"].to_numpy()[i], "v": rows["v"].to_numpy()[i], "limit": [o[1] for o in out], "first": [o[2] for o in out], "block": [o[3] for o in out]})

    asked = queries.dropDuplicates(["vec_id", "v"]).mapInPandas(sent, "query_id long, v array<double>, limit double, first long, block long")
    spread = F.element_at(F.create_map(*[F.lit(x) for a, n in blocks.items() for x in (a, n)]), F.col("first"))
    dealt = found.withColumn("block", F.pmod(F.xxhash64("vec_id"), spread.cast("long")))

    def ranked(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(rows) and len(asked):
            v, ids, second = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy(), rows["second"].to_numpy()
            repeated = len(np.unique(ids)) < len(ids)
            for start in range(0, len(asked), TOGETHER):
                part = asked.iloc[start : start + TOGETHER]
                q = np.stack(part["v"].to_numpy())
                one, two = index.distances(q)
                sums = one[:, int(rows["first"].iloc[0])][:, None] + two
                for i, (own, limit) in enumerate(zip(part["query_id"], part["limit"], strict=True)):
                    at = np.flatnonzero((sums[i] <= limit)[second] & (ids != own))
                    if not len(at):
                        continue
                    d = np.sqrt(((v[at] - q[i]) ** 2).sum(axis=1))
                    if repeated:  # each vec_id once, with its least distance, before the nearest are cut out
                        order = np.lexsort((d, ids[at]))
                        at, d = at[order], d[order]
                        one = np.concatenate([[True], ids[at][1:] != ids[at][:-1]])
                        at, d = at[one], d[one]
                    if len(at) > 4 * k:
                        near = d <= np.partition(d, k)[k]
                        at, d = at[near], d[near]
                    order = np.lexsort((ids[at], d))
                    best = pd.DataFrame({"query_id": own, "vec_id": ids[at][order], "score": d[order]})
                    out.append(best.head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    hits = dealt.groupBy("first", "block").cogroup(asked.groupBy("first", "block")).applyInPandas(ranked, "query_id long, vec_id long, score double")
    best = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
