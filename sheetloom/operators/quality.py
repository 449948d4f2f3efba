"""Quality of extraction and linkage, what corrections teach, and how well probabilities are calibrated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs below which no decomposition is given.
LEAST_PAIRS = 500


def ok_rate(match: Column, miss: Column) -> Column:
    """Matches among what can be compared; null where nothing can."""
    return F.when(match + miss > 0, F.round(match / (match + miss), 6))


def cross_check(cells: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    out = cells.groupBy(*keys).agg(n("MATCH").alias("n_match"), n("NO_MATCH").alias("n_miss"), n("NA").alias("n_na"))
    return out.withColumn("rate", ok_rate(F.col("n_match"), F.col("n_miss")))


def attractors(edit: DataFrame, populations: DataFrame, scope: str, levels: tuple[tuple[str, float], ...] = (("high", 0.2), ("medium", 0.05)), least: int = 5) -> DataFrame:
    """Where corrections gather: of each value of a scope how many corrections and sheets, their share of the
    population (scope, population), how severe that is, and the five pairs corrected most often."""
    e = edit.where("source = 'human'")
    pair = F.concat_ws(">", F.coalesce("old_value", F.lit("")), F.coalesce("new_value", F.lit("")))
    pairs = e.groupBy(scope, pair.alias("pair")).agg(F.count("*").alias("n"))
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("n"), "pair"))).where("place <= 5")
    best = best.groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "pair"))), lambda x: x["pair"]), ",").alias("top_pairs"))
    total = e.groupBy(scope).agg(F.count("*").alias("n"), F.count_distinct("sheet_id").alias("n_sheets"))
    rate = F.when(F.col("population") > 0, F.round(F.col("n_sheets") / F.col("population"), 6))
    severity = F.when(F.col("n") < least, "low")
    for name, floor in levels:
        severity = severity.when(rate >= floor, name)
    return total.join(populations, scope, "left").join(best, scope).withColumns({"rate": rate, "severity": severity.otherwise("low")})


def extraction_metrics(cells: DataFrame) -> DataFrame:
    """One row over compared cells (sheet, field, expected, actual, critical): accuracy by field, by critical fields, by
    whole sheets, and the share of cells made up."""
    same = F.lower(F.trim(F.coalesce("expected", F.lit("")))) == F.lower(F.trim(F.coalesce("actual", F.lit(""))))
    exact = F.trim(F.coalesce("expected", F.lit(""))) == F.trim(F.coalesce("actual", F.lit("")))
    invented = (F.trim(F.coalesce("expected", F.lit(""))) == "") & (F.trim(F.coalesce("actual", F.lit(""))) != "")
    c = cells.withColumns({"same": same, "exact": exact, "invented": invented})
    by_sheet = c.groupBy("sheet").agg(F.count("*").alias("n"), F.count_if("same").alias("ok"), F.count_if("exact").alias("ok_exact"), F.count_if("invented").alias("made"), F.count_if("critical").alias("crit"), F.count_if(F.col("critical") & F.col("same")).alias("crit_ok"))
    share = lambda a, b: F.when(F.sum(b) > 0, F.round(F.sum(a) / F.sum(b), 6))
    return by_sheet.agg(
        F.sum("n").alias("n"),
        share("ok", "n").alias("accuracy"),
        share("ok_exact", "n").alias("exact_accuracy"),
        share("crit_ok", "crit").alias("critical_accuracy"),
        share("made", "n").alias("invented_rate"),
        F.round(F.avg((F.col("ok") == F.col("n")).cast("double")), 6).alias("perfect_sheets"),
    )


def worst(cells: DataFrame, n: int, band: Column, *order: Column) -> DataFrame:
    """The first n by band, then by an order."""
    return cells.withColumn("band", band).where(F.col("band").isNotNull()).orderBy("band", *order).limit(n)


def alias_rules(edit: DataFrame, least: int = 2) -> DataFrame:
    """Corrections of one written form to one value that several edits agree on, with the edits' ids."""
    e = edit.where("source = 'human'").select(F.expr("substring_index(field_path, '.', -1)").alias("kind"), F.upper(F.trim("old_value")).alias("old"), F.trim("new_value").alias("new"), "id")
    return e.where("old != '' and new != '' and old != upper(new)").groupBy("kind", "old", "new").agg(F.count("*").alias("support"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where(F.col("support") >= least)


def case_rules(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Corrections that change the case only; in conflict where a form is corrected to several."""
    c = pairs.where("upper(old_value) = upper(new_value) and old_value != new_value")
    c = c.groupBy(F.upper("new_value").alias("key"), "new_value").agg(F.count("*").alias("support"))
    return c.withColumn("conflict", F.count("*").over(Window.partitionBy("key")) > 1).where(F.col("support") >= least)


def confusion(pairs: DataFrame, floor: int = 2, most: int = 5) -> DataFrame:
    """pairs (gold, ocr) counted; each gold's most frequent confusions and their share of all of it."""
    n = pairs.groupBy("gold", "ocr").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("gold")))
    n = n.where((F.col("gold") != F.col("ocr")) & (F.col("n") >= floor))
    place = F.row_number().over(Window.partitionBy("gold").orderBy(F.desc("n"), "ocr"))
    return n.withColumn("place", place).where(F.col("place") <= most).withColumn("p", F.round(F.col("n") / F.col("total"), 6)).drop("total")


def observed_values(cells: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """Values (field, value) seen on several sheets that aren't known."""
    seen = cells.groupBy("field", "value").agg(F.count_distinct("sheet_id").alias("n_sheets")).where(F.col("n_sheets") >= least)
    return seen.join(known, ["field", "value"], "left_anti")


def few_shot(docs: DataFrame, group: str, spread: str, score: str, key: str, n: int = 3) -> DataFrame:
    """The n best of each group, one of each `spread` first: rank within the spread, then the score."""
    d = docs.withColumn("_own", F.row_number().over(Window.partitionBy(group, spread).orderBy(F.desc(score), key)))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_own", F.desc(score), key))).where(F.col("place") <= n).drop("_own")


def bands(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percentiles 5, 50 and 95 (linear between neighbours), least, most and number."""
    p = [F.round(F.percentile(value, q), 4).alias(name) for q, name in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))]
    return rows.groupBy(*keys).agg(*p, F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def ranked_bands(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Greatest, upper median s[n // 2] and nearest rank s[int(.95 (n - 1))] of sorted values, by counting positions."""
    w = Window.partitionBy(*keys).orderBy(value)
    r = rows.select(*keys, value).withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col(value)))
    return r.groupBy(*keys).agg(F.max(value).alias("most"), at(F.floor(F.col("_n") / 2)).alias("median"), at(F.floor(F.lit(0.95) * (F.col("_n") - 1))).alias("p95"), F.count("*").alias("n"))


def consistency(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose rows have several values of a column that should be one."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in columns]).where(" or ".join(f"n_{c} > 1" for c in columns))


def murphy(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """One row: Brier score and its reliability, resolution and uncertainty over equal bins of p; nulls under
    LEAST_PAIRS pairs. Two sums: by bin, then over the bins."""
    place = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins))
    b = pairs.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum((F.col("p") - F.col("y")) ** 2).alias("se"))
    t = b.agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "sp", "sy")).alias("bins"), F.sum("sy").alias("sy"), F.sum("se").alias("se"))
    base = F.col("sy") / F.col("n")
    total = lambda f: F.aggregate("bins", F.lit(0.0), lambda acc, x: acc + f(x)) / F.col("n")
    enough = F.col("n") >= LEAST_PAIRS
    given = lambda c: F.when(enough, F.round(c, 6))
    return t.select(
        "n",
        given(F.col("se") / F.col("n")).alias("brier"),
        given(total(lambda x: x["n"] * (x["sp"] / x["n"] - x["sy"] / x["n"]) ** 2)).alias("reliability"),
        given(total(lambda x: x["n"] * (x["sy"] / x["n"] - base) ** 2)).alias("resolution"),
        given(base * (1 - base)).alias("uncertainty"),
    )


def entropy(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """Of each key's weights the entropy as a share of the greatest possible, and the sum of squared shares."""
    r = rows.where(F.col(weight) > 0).withColumn("_p", F.col(weight) / F.sum(weight).over(Window.partitionBy(key)))
    out = r.groupBy(key).agg(F.count("*").alias("n"), (-F.sum(F.col("_p") * F.log2("_p"))).alias("h"), F.round(F.sum(F.col("_p") ** 2), 6).alias("hhi"))
    return out.select(key, "n", F.when(F.col("n") > 1, F.round(F.col("h") / F.log2("n"), 6)).otherwise(0.0).alias("entropy"), "hhi")


def agreement(rows: DataFrame, declared: str, actual: str, order: str) -> DataFrame:
    """How often a declared value is the actual one, and how often it is the next row's, the last row's next being the
    first: what chance would give. The wrap-around needs one row only, so no window over all rows."""
    ids = rows.select(order, actual)
    # the next row by rank: ranks are dense here because the order column is numbered beforehand
    shifted = ids.select((F.col(order) - 1).alias(order), F.col(actual).alias("_next"))
    n = rows.agg(F.max(order).alias("_last"), F.min_by(actual, order).alias("_first"))
    r = rows.join(shifted, order, "left").crossJoin(F.broadcast(n))
    by_chance = F.col(declared) == F.when(F.col(order) == F.col("_last"), F.col("_first")).otherwise(F.col("_next"))
    return r.agg(F.round(F.avg((F.col(declared) == F.col(actual)).cast("double")), 6).alias("m"), F.round(F.avg(by_chance.cast("double")), 6).alias("u"))


def need_attention(cells: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Mean cells in need of attention by arm (baseline, candidate), and whether the candidate's is not worse by more than a share."""
    by_sheet = cells.groupBy("arm", "sheet_id").agg(F.count_if(F.col("status") == "NO_MATCH").alias("n"))
    out = by_sheet.groupBy().agg(F.round(F.avg(F.when(F.col("arm") == "baseline", F.col("n"))), 6).alias("baseline"), F.round(F.avg(F.when(F.col("arm") == "candidate", F.col("n"))), 6).alias("candidate"))
    return out.withColumn("passes", F.col("candidate") <= F.col("baseline") * (1 + threshold))
