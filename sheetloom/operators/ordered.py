"""Computations along an order: allocation, fill-down, change points, neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def waterfall(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Remaining quantity of each row after a pool is handed down its siblings in plan order.

    rows: key, order, quanttrp, produced (null: the phase is missing), closed, pool (the same for a key, from 0 up).
    A row without a planned quantity or a phase has no remaining quantity (null), a closed one 0; neither draws from
    the pool. Others take what they need; the last of all siblings takes what is left, but only if none was skipped.
    """
    skipped = F.col("produced").isNull() | F.col("closed") | F.col("quanttrp").isNull()
    need = F.when(~skipped, F.col("quanttrp") - F.greatest(F.col("produced"), F.lit(0.0)))
    r = rows.withColumns({"_skipped": skipped, "_need": need})
    whole = Window.partitionBy(*key)
    before = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.greatest(F.col("_need"), F.lit(0.0))).over(before), F.lit(0.0))
    available = F.greatest(F.col("pool") - taken, F.lit(0.0))
    none_skipped = F.max(F.col("_skipped").cast("int")).over(whole) == 0
    last = F.row_number().over(whole.orderBy(F.desc(order))) == 1
    share = F.when(last & none_skipped, available).otherwise(F.least(F.greatest(F.col("_need"), F.lit(0.0)), available))
    left = F.when(F.col("produced").isNull(), None).when(F.col("closed"), 0.0).when(F.col("quanttrp").isNull(), None).otherwise(F.col("_need") - share)
    return r.withColumn("remaining", left).drop("_skipped", "_need")


def fill_down(rows: DataFrame, columns: list[str], key: list[str], order: str, marks: tuple[str, ...] = ('"', "''", "”", "“", "〃", "idem")) -> DataFrame:
    """Ditto marks take the last valid value above; blanks and ? stay and are no source; marks without one get ''."""
    above = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for c in columns:
        t = F.trim(F.col(c))
        ditto = F.coalesce(F.lower(t).isin(*marks), F.lit(False))
        valid = F.when(~ditto & (t != "") & ~t.rlike(r"^\?+$"), F.col(c))
        out[c] = F.when(ditto, F.coalesce(F.last(valid, ignorenulls=True).over(above), F.lit(""))).otherwise(F.col(c))
    return rows.withColumns(out)


def last_edit(edit: DataFrame, keys: list[str]) -> DataFrame:
    """The newest edit of each path, by id; one pass, no sort."""
    rest = [c for c in edit.columns if c not in keys]
    return edit.groupBy(*keys).agg(F.max_by(F.struct(*rest), "id").alias("_e")).select(*keys, "_e.*")


def reverted(edit: DataFrame, keys: list[str]) -> DataFrame:
    """Paths whose last edit is the system's, though a human had set another value before."""
    last = edit.groupBy(*keys).agg(
        F.max_by("source", "id").alias("source"),
        F.max_by("new_value", "id").alias("value"),
        F.max_by(F.when(F.col("source") == "human", F.col("new_value")), F.when(F.col("source") == "human", F.col("id"))).alias("human_value"),
    )
    return last.where((F.col("source") == "system") & F.col("human_value").isNotNull() & ~F.col("value").eqNullSafe(F.col("human_value")))


def cusum(series: DataFrame, key: list[str], order: str, z: Column, slack: float, limit: float) -> DataFrame:
    """Page's sum S = max(0, S + z - slack), from prefix sums, and whether it is over the limit for the first time."""
    upto = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    p = series.withColumn("_p", F.sum(z - slack).over(upto))
    s = p.withColumn("s", F.round(F.col("_p") - F.least(F.lit(0.0), F.min("_p").over(upto)), 9)).drop("_p")
    over = F.when(F.col("s") > limit, F.col(order))
    return s.withColumn("alarm", F.coalesce(F.min(over).over(Window.partitionBy(*key)) == F.col(order), F.lit(False)))


def wald_bounds(alpha: float = 0.05, beta: float = 0.01) -> tuple[float, float]:
    return math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))


def sequential_test(cells: DataFrame, arm: str, order: str, step: Column, alpha: float = 0.05, beta: float = 0.01) -> DataFrame:
    """Of each arm the log-likelihood ratio at its first crossing of Wald's bounds, or at its end, and the decision."""
    upper, lower = wald_bounds(alpha, beta)
    upto = Window.partitionBy(arm).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("llr", F.sum(step).over(upto))
    crossed = F.when((F.col("llr") >= upper) | (F.col("llr") <= lower), F.col(order))
    run = run.withColumn("at", F.min(crossed).over(Window.partitionBy(arm))).where(F.col("at").isNull() | (F.col(order) <= F.col("at")))
    out = run.groupBy(arm).agg(F.max(order).alias("last"), F.count("*").alias("n"), F.round(F.max_by("llr", order), 6).alias("llr"))
    return out.withColumn("decision", F.when(F.col("llr") >= upper - 1e-6, "worse").when(F.col("llr") <= lower + 1e-6, "same").otherwise("open"))


def active_before(days: DataFrame, events: DataFrame, key: str, window: int = 14) -> DataFrame:
    """days (key, day) with active: whether the key has an event in the window of days before, the day itself excluded."""
    d = days.select(key, "day").distinct().withColumn("_asked", F.lit(1)).unionByName(events.select(key, F.col("day")).distinct().withColumn("_asked", F.lit(0)))
    d = d.withColumn("_n", F.datediff("day", F.lit("1970-01-01").cast("date")))
    past = Window.partitionBy(key).orderBy("_n").rangeBetween(-window, -1)
    return d.withColumn("active", F.coalesce(F.sum(1 - F.col("_asked")).over(past), F.lit(0)) > 0).where("_asked = 1").select(key, "day", "active")


def neighbours(rows: DataFrame, key: list[str], order: str, column: str) -> DataFrame:
    """A column's value in the row before and in the row after."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumns({f"{column}_before": F.lag(column).over(w), f"{column}_after": F.lead(column).over(w)})


def adjacency_lift(rows: DataFrame, key: list[str], order: str, column: str) -> DataFrame:
    """How often a row has its predecessor's value (smoothed), against the chance that two rows have the same."""
    w = Window.partitionBy(*key).orderBy(order)
    kept = rows.where(F.col(column).isNotNull()).withColumn("_before", F.lag(column).over(w))
    near = kept.where(F.col("_before").isNotNull()).agg(F.sum((F.col(column) == F.col("_before")).cast("bigint")).alias("same"), F.count("*").alias("pairs"))
    n = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    chance = n.agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("chance"))
    out = near.crossJoin(chance)  # one row by one row
    rate = (F.col("same") + 1) / (F.col("pairs") + 2)
    return out.select("same", "pairs", F.round(rate, 9).alias("rate"), F.round("chance", 9).alias("chance"), F.round(F.log2(rate / F.col("chance")), 6).alias("bits"))


def collisions(rows: DataFrame, group: list[str], core: str) -> DataFrame:
    """rows with collided: whether rows of a group have different cores."""
    w = Window.partitionBy(*group)
    return rows.withColumn("collided", F.size(F.collect_set(core).over(w)) > 1)


def previous_workday(days: DataFrame, calendar: DataFrame, look_back: int = 30) -> DataFrame:
    """days (day) with the last working day before each: calendar entries (day, working) go before the rule that
    Monday to Friday are worked; without one in look_back days, the day before."""
    back = days.select("day").distinct().withColumn("_d", F.explode(F.transform(F.sequence(F.lit(1), F.lit(look_back)), lambda i: F.date_sub("day", i))))
    known = calendar.select(F.col("day").alias("_d"), "working")
    works = F.coalesce("working", F.weekday("_d") < 5)
    out = back.join(known, "_d", "left").groupBy("day").agg(F.max(F.when(works, F.col("_d"))).alias("previous"))
    return out.withColumn("previous", F.coalesce("previous", F.date_sub("day", 1)))


def recent_against_before(rows: DataFrame, order: Column, value: str, recent: int = 20, before: int = 100) -> DataFrame:
    """Means over the newest rows and over those that follow them."""
    newest = rows.orderBy(order).limit(recent + before)
    place = newest.withColumn("_n", F.row_number().over(Window.orderBy(order)))  # over a bounded number of rows
    return place.agg(F.round(F.avg(F.when(F.col("_n") <= recent, F.col(value))), 6).alias("recent"), F.round(F.avg(F.when(F.col("_n") > recent, F.col(value))), 6).alias("before"))


def isotonic(points: DataFrame, order: str, value: str, weight: str) -> DataFrame:
    """points, few ordered buckets, with values made non-increasing by weighted least squares: that of a bucket is the least,
    over all stretches' beginnings up to it, of the greatest mean of stretches that hold it."""
    by = Window.orderBy(order)  # buckets: a handful of rows
    p = points.select(F.col(order).alias("_i"), F.sum(F.col(value) * F.col(weight)).over(by).alias("_s"), F.sum(weight).over(by).alias("_w"), (F.col(value) * F.col(weight)).alias("_own"), F.col(weight).alias("_one"))
    j = p.select(F.col("_i").alias("_j"), (F.col("_s") - F.col("_own")).alias("_s0"), (F.col("_w") - F.col("_one")).alias("_w0"))
    k = p.select(F.col("_i").alias("_k"), F.col("_s").alias("_s1"), F.col("_w").alias("_w1"))
    means = F.broadcast(j).join(F.broadcast(k), F.col("_j") <= F.col("_k")).select("_j", "_k", ((F.col("_s1") - F.col("_s0")) / (F.col("_w1") - F.col("_w0"))).alias("_m"))
    most = p.select("_i").join(F.broadcast(means), (F.col("_j") <= F.col("_i")) & (F.col("_k") >= F.col("_i"))).groupBy("_i", "_j").agg(F.max("_m").alias("_m"))
    fitted = most.groupBy("_i").agg(F.min("_m").alias(value))
    return points.drop(value).join(fitted, F.col(order) == F.col("_i")).drop("_i")


def pooled(points: list[tuple[float, float]]) -> list[float]:
    """Isotonic regression by pooling adjacent violators: values with weights, in order, made non-increasing."""
    blocks: list[list[float]] = []
    for value, weight in points:
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            v, w, n = blocks.pop()
            u, x, m = blocks.pop()
            blocks.append([(u * x + v * w) / (x + w) if x + w else 0.0, x + w, m + n])
    return [b[0] for b in blocks for _ in range(int(b[2]))]
