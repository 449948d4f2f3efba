"""Runs held against the truth and against each other: accuracy, causes, contracts, template audits, training sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY, MEASURES = ("of", "ov", "cliente"), ("comp_mm", "larg_mm", "lbase", "ltopo", "esp", "dbase", "dtopo")
#: Fields that references can tell of, and sources whose values no reference has confirmed.
CROSSABLE = ("of", "ov", "cliente", "modelo", "lote", *MEASURES)
UNCONFIRMED = ("ocr_raw", "ocr_candidate")


def share(part: Column, whole: Column) -> Column:
    """Per cent, two places; 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole * 100.0, 2)).otherwise(0.0)


def linkage_metrics(cases: DataFrame, *keys: str) -> DataFrame:
    """Over cells (field, raw, truth, output, status, source, reachable: a reference has the truth), for each key: how many
    were right as read, were corrected, spoilt, or changed to another wrong value; of the fields that references tell of
    the accuracy, that where the truth can be reached, and how many outputs no reference confirms."""
    norm = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    c = cases.withColumns({"raw_ok": norm("raw") == norm("truth"), "out_ok": norm("output") == norm("truth"), "kept": norm("output") == norm("raw"), "cross": F.col("field").isin(*CROSSABLE)})
    n = F.count_if
    out = c.groupBy(*keys).agg(
        F.count("*").alias("evaluated"),
        n("raw_ok").alias("raw_ok"),
        n("out_ok").alias("output_ok"),
        n(~F.col("raw_ok") & F.col("out_ok")).alias("corrected"),
        n(F.col("raw_ok") & ~F.col("out_ok")).alias("regressed"),
        n(~F.col("raw_ok") & ~F.col("out_ok") & ~F.col("kept")).alias("changed_other_wrong"),
        n((F.col("status") == "NO_MATCH") & F.col("out_ok")).alias("no_match_but_right"),
        n("cross").alias("crossable"),
        n(F.col("cross") & F.col("out_ok")).alias("crossable_ok"),
        n(F.col("cross") & F.col("reachable")).alias("reachable"),
        n(F.col("cross") & F.col("reachable") & F.col("out_ok")).alias("reachable_ok"),
        n(contract_violation(F.col("field"), F.col("output"), F.col("source"))).alias("violations"),
    )
    wrong = F.col("evaluated") - F.col("raw_ok")
    return out.withColumns({"accuracy": share(F.col("output_ok"), F.col("evaluated")), "correction_rate": share(F.col("corrected"), wrong), "preserve_rate": share(F.col("raw_ok") - F.col("regressed"), F.col("raw_ok")), "reachable_accuracy": share(F.col("reachable_ok"), F.col("reachable"))})


def contract_violation(field: Column, output: Column, source: Column) -> Column:
    """A value of a field that references tell of, though none has confirmed it."""
    return F.coalesce(field.isin(*CROSSABLE) & (F.trim(output) != "") & source.isin(*UNCONFIRMED), F.lit(False))


def category(status: Column, kind: Column) -> Column:
    """MATCH, MATCH_RULE, NO_MATCH or NA."""
    s = F.upper(F.coalesce(status, F.lit("NA")))
    return F.when((s == "MATCH") & F.coalesce(kind.startswith("MATCH_REGRA"), F.lit(False)), "MATCH_RULE").when(s.isin("MATCH", "NO_MATCH"), s).otherwise("NA")


def unjudged(cells: DataFrame) -> DataFrame:
    """(sheet_id, row_index, fields): rows with anything written whose cells nothing was said of, and these cells. cells:
    sheet_id, row_index, field, value, category."""
    g = cells.groupBy("sheet_id", "row_index").agg(F.max(F.coalesce(F.trim("value") != "", F.lit(False))).alias("filled"), F.array_sort(F.collect_set(F.when(F.col("category") == "NA", F.col("field")))).alias("fields"))
    return g.where(F.col("filled") & (F.size("fields") > 0)).select("sheet_id", "row_index", F.concat_ws(",", "fields").alias("fields"))


def causes(misses: DataFrame, rate: float, delta: float) -> DataFrame:
    """Of misses (sheet_id, error_class, root_cause, field, value, reason, ref, repeats) by class and cause: how many, how many
    different ones, what each makes of all, of all cells (their number follows from the rate of errors) and of a
    difference between two runs, and how often they came again."""
    same = F.struct("sheet_id", "field", "value", "reason", "ref")
    once = misses.groupBy("error_class", "root_cause", same.alias("s")).agg(F.count("*").alias("n"), F.greatest(F.max("repeats") - 1, F.lit(0)).alias("again"))
    g = once.groupBy("error_class", "root_cause").agg(F.sum("n").alias("occurrences"), F.count("*").alias("unique_causes"), F.sum("again").alias("repeat_extra"))
    g = g.crossJoin(F.broadcast(misses.agg(F.count("*").alias("_all"))))  # one row
    cells = F.col("_all") / F.lit(rate)
    return g.withColumns({"share": share(F.col("occurrences"), F.col("_all")), "impact": share(F.col("occurrences"), cells), "share_of_delta": share(F.col("occurrences"), cells * delta)}).drop("_all")


def sheet_impact(misses: DataFrame, sheets: DataFrame) -> DataFrame:
    """sheets (sheet_id, n_match, n_miss) with the rate of errors and the most frequent class and cause of the misses."""

    def top(c: str) -> DataFrame:
        n = misses.groupBy("sheet_id", c).agg(F.count("*").alias("n"))
        return n.groupBy("sheet_id").agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(f"top_{c}"), *([F.sum("n").alias("classified")] if c == "error_class" else []))

    out = sheets.join(top("error_class"), "sheet_id", "left").join(top("root_cause"), "sheet_id", "left")
    return out.withColumn("error_rate", share(F.col("n_miss"), F.col("n_match") + F.col("n_miss"))).na.fill("", ["top_error_class", "top_root_cause"]).na.fill(0, ["classified"])


def severity(field: Column, declared: Column) -> Column:
    """0 identity, 1 measure, 2 other, 3 declared columns."""
    return F.when(declared, 3).when(field.isin(*IDENTITY), 0).when(field.isin(*MEASURES), 1).otherwise(2)


def shadow_diff(production: DataFrame, shadow: DataFrame) -> DataFrame:
    """(sheet_id, row_index, field, kind, severity, value, shadow_value, before, after) of cells (sheet_id, row_index, field,
    value, ref, status, source) of two runs: a diff where values differ, case aside, a flip where only the status does,
    else same; for declared columns the reference's values are compared. Cells empty on both sides, and rows beyond the
    shorter run's, don't count."""
    keys = ["sheet_id", "row_index", "field"]
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("value", "ref", "status", "source")])
    rows = production.select("sheet_id", "row_index").distinct().join(shadow.select("sheet_id", "row_index").distinct(), ["sheet_id", "row_index"])
    j = side(production, "p").join(side(shadow, "s"), keys, "full").join(rows, ["sheet_id", "row_index"])
    declared = F.coalesce(F.col("p_source") == "declared_plan", F.lit(False)) | F.coalesce(F.col("s_source") == "declared_plan", F.lit(False))
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    p = F.coalesce(F.when(declared, text("p_ref")).otherwise(F.coalesce(text("p_value"), text("p_ref"))), F.lit(""))
    s = F.coalesce(F.when(declared, text("s_ref")).otherwise(text("s_value")), F.lit(""))
    status = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.when(F.upper(p) != F.upper(s), "diff").when(status("p_status") != status("s_status"), "flip").otherwise("same")
    out = j.select(*keys, kind.alias("kind"), severity(F.col("field"), declared).alias("severity"), p.alias("value"), s.alias("shadow_value"), status("p_status").alias("before"), status("s_status").alias("after"))
    return out.where("value != '' or shadow_value != ''")


def shadowed(rows: DataFrame, production, shadow) -> DataFrame:
    """The same rows decided by two functions, held against each other; both give the cells that shadow_diff takes."""
    return shadow_diff(production(rows), shadow(rows))


def agreement(diff: DataFrame) -> DataFrame:
    """(kind, what, n, share): all cells, those that differ by field, and flips of status by what to what."""
    what = F.when(F.col("kind") == "diff", F.col("field")).when(F.col("kind") == "flip", F.concat_ws(">", "before", "after")).otherwise("")
    g = diff.groupBy("kind", what.alias("what")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(diff.agg(F.count("*").alias("_all")))).select("kind", "what", "n", share(F.col("n"), F.col("_all")).alias("share"))  # one row


def template_audit(sheets: DataFrame, target: str) -> DataFrame:
    """sheets (detected, by, by_code_alone, structure: whether rows look like the target's, weakly) with status, proposed and
    reason. What a detector says of label or code goes before the rows' structure, and that before a code that
    contradicts the label or weak signs, which only make it ambiguous."""
    hit = F.col("detected") == target
    rules = [
        (hit & (F.col("by") == "code"), "flip_code", F.lit("detector:code")),
        (hit, "flip_label", F.concat(F.lit("detector:"), "by")),
        (F.col("structure") == "strong", "flip_structure", F.lit("rows")),
        (F.col("by_code_alone") == target, "ambiguous", F.lit("code against label")),
        (F.col("structure") == "weak", "ambiguous", F.lit("weak rows")),
    ]
    pick = lambda i, last: reduce(lambda acc, r: F.when(F.coalesce(r[0], F.lit(False)), r[i] if isinstance(r[i], Column) else F.lit(r[i])).otherwise(acc), reversed(rules), last)
    return sheets.withColumns({"status": pick(1, F.lit("no_flip")), "reason": pick(2, F.concat(F.lit("detector:"), "by"))}).withColumn("proposed", F.when(F.col("status") != "no_flip", F.lit(target)).otherwise(""))


def row_signs(rows: str = "rows") -> dict[str, Column]:
    """Of an array of rows (of, modelo, other): how many are filled, how many name a product (an order number of six digits or
    a model of four characters), whether the page is surely a front (two that do), and whether it looks like none (two
    filled, none that does)."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    filled = F.size(F.filter(rows, lambda r: (text(r["of"]) != "") | (text(r["modelo"]) != "") | (text(r["other"]) != "")))
    named = F.size(F.filter(rows, lambda r: text(r["of"]).rlike("^[0-9]{6}$") | (F.length(text(r["modelo"])) >= 4)))
    return {"filled": filled, "named": named, "front": named >= 2, "no_product": (filled >= 2) & (named == 0)}


def training_set(raw: DataFrame, edits: DataFrame, held_out: int, seed: str = "1") -> tuple[DataFrame, DataFrame]:
    """Cells (sheet_id, path, value) as they should be read: raw with each path's last human edit, of the sheets that have one;
    and (sheet_id, part): the first so many sheets by a hash, at most half of all, are the exam, the rest to learn from."""
    human = edits.where("source = 'human'").groupBy("sheet_id", "path").agg(F.max_by("new_value", "id").alias("_new"))
    sheets = human.select("sheet_id").distinct().join(raw.select("sheet_id").distinct(), "sheet_id", "left_semi")
    target = raw.join(sheets, "sheet_id", "left_semi").join(human, ["sheet_id", "path"], "full").join(sheets, "sheet_id", "left_semi").select("sheet_id", "path", F.coalesce("_new", "value").alias("value"))
    order = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("sheet_id").cast("string")).cast("binary"))
    first = sheets.withColumn("_h", order).orderBy("_h", "sheet_id").limit(held_out).withColumn("_n", F.row_number().over(Window.orderBy("_h", "sheet_id")))  # at most held_out rows
    first = first.crossJoin(F.broadcast(sheets.agg(F.count("*").alias("_all")))).where(F.col("_n") <= F.floor(F.col("_all") / 2)).select("sheet_id", F.lit("exam").alias("_part"))
    return target, sheets.join(first, "sheet_id", "left").select("sheet_id", F.coalesce("_part", F.lit("train")).alias("part"))
