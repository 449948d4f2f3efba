"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import apart, staged


#: Edges from which on a node's may be too many for one task; for fewer, dealing minima anew costs more than it saves.
MANY = 10_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, many: int = MANY) -> DataFrame:
    """(node, root) of every node of an edge, root the component's least node (long ids).

    Large and small stars in turn: each node ties its larger neighbours to its least one, then itself and its smaller
    neighbours. Both are a minimum by key, summed before the shuffle, and a join that may be split where a node has
    many edges: with `many` edges or more the minima are dealt anew before they are joined, which changes the plan, not
    the result. The number of edges doesn't grow. Rounds are about the logarithm of the longest path.
    """
    e = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    seen, n = None, e.count()
    for _ in range(rounds):
        dealt = (lambda df: apart(df, "u")) if n >= many else (lambda df: df)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(dealt(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(dealt(least), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(tied.unionAll(least.withColumnRenamed("m", "v")).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if tuple(now) == seen:
            break
        seen, n = tuple(now), now[0]
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
