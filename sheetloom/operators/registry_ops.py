"""Proposals, policies, templates, labels and review queues: listings, versions, resolutions and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import within


def listed(rows: DataFrame, *order: Column, limit: int = 50, most: int = 200, **equal) -> DataFrame:
    """Rows that equal the values given (None: any), in an order, at most `limit`, which is kept from 1 to `most`."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(*order).limit(max(1, min(limit, most)))


def activated(versions: DataFrame, version: int, key: str = "version") -> DataFrame:
    """All versions inactive but one."""
    return versions.withColumn("active", F.col(key) == version)


def resolved_template(sheets: DataFrame, aliases: DataFrame, default: str) -> DataFrame:
    """sheets (sheet_id, label, stored, scrap) with template: stored name, the template of scrap rows, the exact alias of
    the label, the longest alias (of three characters or more) within it, or the default; and why."""
    exact = aliases.select(F.col("alias").alias("label"), F.col("template").alias("_exact")).dropDuplicates(["label"])
    met = within(aliases, "alias", sheets, "label", 3).join(aliases, "alias")
    longest = met.groupBy("label").agg(F.max_by("template", F.struct(F.length("alias"), F.col("alias"))).alias("_longest"))
    j = sheets.join(exact, "label", "left").join(longest, "label", "left")
    why = F.when(F.col("stored").isNotNull(), "stored").when(F.col("scrap"), "scrap").when(F.col("_exact").isNotNull(), "alias").when(F.col("_longest").isNotNull(), "contained").otherwise("default")
    return j.withColumn("why", why).withColumn("template", F.when(F.col("why") == "scrap", "scrap").otherwise(F.coalesce("stored", "_exact", "_longest", F.lit(default)))).drop("_exact", "_longest")


def alias_conflicts(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(candidate, alias, kind): labels that are equal or of which one holds the other."""
    both = within(candidates, "candidate", existing, "alias").select("candidate", "alias").unionByName(within(existing, "alias", candidates, "candidate").select("candidate", "alias"))
    return both.distinct().withColumn("kind", F.when(F.col("candidate") == F.col("alias"), "exact").otherwise("contains"))


def site_of(sheets: DataFrame, templates: DataFrame, head: str = "HQ") -> DataFrame:
    """The sheet's own stamp, its template's site, or the head office."""
    return sheets.join(templates.select("template", F.col("site").alias("_site")), "template", "left").withColumn("site", F.coalesce("site", "_site", F.lit(head))).drop("_site")


def first_seen(files: DataFrame, keep: int = 20) -> DataFrame:
    """When each content was first seen, of the newest few."""
    return files.groupBy("sha").agg(F.min("mtime").alias("first_seen")).orderBy(F.desc("first_seen"), "sha").limit(keep)


def review_queue(cells: DataFrame, per_document: int = 3, low: float = 0.35, high: float = 0.75) -> DataFrame:
    """Cells of middling confidence (from low, below high) in which what was written and what is proposed differ and
    neither is empty; the few of each document with the highest priority: weight * (1 - confidence). Cells without a
    confidence are none of these."""
    written, proposed = (F.coalesce(F.trim(c), F.lit("")) for c in ("written", "proposed"))
    grey = (F.col("confidence") >= low) & (F.col("confidence") < high) & (written != "") & (proposed != "") & (written != proposed)
    c = cells.where(grey).withColumn("priority", F.round(F.col("weight") * (1 - F.col("confidence")), 6))
    place = F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.desc("priority"), "path"))
    return c.withColumn("place", place).where(F.col("place") <= per_document)


def policy_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change) of what differs between two versions."""
    j = old.select(key, F.col(value).alias("before")).join(new.select(key, F.col(value).alias("after")), key, "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return j.withColumn("change", change).where(F.col("change").isNotNull())


def merged_weights(base: DataFrame, overlay: DataFrame, key: list[str], value: str) -> DataFrame:
    """All weights of both; the overlay's win."""
    o = overlay.select(*key, F.col(value).alias("_o"))
    return base.join(o, key, "full").select(*key, F.coalesce("_o", value).alias(value))


def stale(parameters: DataFrame, as_of: str, warn: int = 30, old: int = 60) -> DataFrame:
    age = F.datediff(F.lit(as_of).cast("date"), "fitted")
    return parameters.withColumn("age", age.cast("bigint")).withColumn("state", F.when(age >= old, "stale").when(age >= warn, "aging").otherwise("fresh"))


def file_names(sheets: DataFrame, *keys: str) -> DataFrame:
    """A name for each sheet, numbered from the second of those that would have the same."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("sheet_id"))
    name = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    return sheets.withColumn("name", F.when(n == 1, name).otherwise(F.concat(name, F.lit("_"), n.cast("string"))))


def coverage(cells: DataFrame, by: str, kinds: tuple[str, ...]) -> DataFrame:
    """Cells of each kind by a dimension, and the share of NA."""
    out = cells.groupBy(by).pivot("status", list(kinds)).count().na.fill(0)
    total = reduce(lambda a, b: a + b, [F.col(k) for k in kinds])
    return out.withColumn("na_share", F.round(F.col("NA") / total, 6))


def gate(cells: DataFrame, blind: Column, tolerance: float = 0.0) -> DataFrame:
    """One row: accuracy of two runs over all cells and over the blind ones, and whether the new one may pass."""
    rate = lambda ok, where: F.round(F.avg(F.when(where, F.col(ok).cast("double"))), 6)
    out = cells.agg(rate("old_ok", F.lit(True)).alias("old"), rate("new_ok", F.lit(True)).alias("new"), rate("old_ok", blind).alias("old_blind"), rate("new_ok", blind).alias("new_blind"))
    return out.withColumn("passes", (F.col("new") >= F.col("old") - tolerance) & (F.col("new_blind") >= F.col("old_blind") - tolerance))


def grid_fit(pairs: DataFrame, temperatures: list[float]) -> DataFrame:
    """The temperature with the least Brier score over (bits, y): every pair is taken once for each of the few."""
    t = F.explode(F.array(*map(F.lit, temperatures))).alias("t")
    p = 1 / (1 + F.pow(F.lit(2.0), -F.col("bits") / F.col("t")))
    scored = pairs.select("bits", "y", t).groupBy("t").agg(F.round(F.avg((p - F.col("y")) ** 2), 9).alias("brier"))
    return scored.orderBy("brier", "t").limit(1)


def labelled(rows: DataFrame, cap: int) -> DataFrame:
    """rows (row_id, written, found, truth) as sets for evaluation, at most `cap` of each by id: good, corrected, shifted, outside."""
    kind = F.when(F.col("truth").isNull(), "outside").when(F.col("written") == F.col("truth"), "good").when(F.col("found") == F.col("truth"), "corrected").otherwise("shifted")
    r = rows.withColumn("kind", kind)
    return r.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("row_id"))).where(F.col("n") <= cap).drop("n")


def most_used_priority(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group in an order, numbered."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)
