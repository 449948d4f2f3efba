"""Evaluation over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from .registry import query
from .tables import EDIT, FACT, SHEET, edits, facts, read, sheets

FIELDS = ("of", "cliente", "esp", "pri", "lote")
CASES = f"""c AS (SELECT l_orderkey AS sheet_id, l_linenumber AS row_index, ({list(FIELDS)})[l_partkey % 5 + 1] AS field, CAST(l_partkey % 4 AS VARCHAR) AS raw, CAST(l_suppkey % 3 AS VARCHAR) AS truth, CASE WHEN l_quantity > 30 THEN CAST(l_suppkey % 3 AS VARCHAR) WHEN l_quantity > 10 THEN CAST(l_partkey % 4 AS VARCHAR) ELSE 'x' END AS output,
 CASE WHEN l_linenumber % 3 = 0 THEN 'NO_MATCH' WHEN l_linenumber % 3 = 1 THEN 'MATCH' ELSE 'NA' END AS status, CASE WHEN l_linenumber % 2 = 0 THEN 'ocr_raw' ELSE 'plan' END AS source, l_suppkey % 3 <> 1 AS reachable FROM lineitem),
 f AS (SELECT *, raw = truth AS r, output = truth AS o, output = raw AS k, field IN ('of', 'cliente', 'esp', 'lote') AS x FROM c)"""
METRICS = """COUNT(*) AS evaluated, COUNT(*) FILTER (r) AS raw_ok, COUNT(*) FILTER (o) AS output_ok, COUNT(*) FILTER (NOT r AND o) AS corrected, COUNT(*) FILTER (r AND NOT o) AS regressed, COUNT(*) FILTER (NOT r AND NOT o AND NOT k) AS changed_other_wrong, COUNT(*) FILTER (status = 'NO_MATCH' AND o) AS no_match_but_right,
 COUNT(*) FILTER (x) AS crossable, COUNT(*) FILTER (x AND o) AS crossable_ok, COUNT(*) FILTER (x AND reachable) AS reachable, COUNT(*) FILTER (x AND reachable AND o) AS reachable_ok, COUNT(*) FILTER (x AND source = 'ocr_raw') AS violations,
 ROUND(COUNT(*) FILTER (o) / COUNT(*) * 100, 2) AS accuracy, CASE WHEN COUNT(*) FILTER (NOT r) > 0 THEN ROUND(COUNT(*) FILTER (NOT r AND o) / COUNT(*) FILTER (NOT r) * 100, 2) ELSE 0 END AS correction_rate, CASE WHEN COUNT(*) FILTER (r) > 0 THEN ROUND(COUNT(*) FILTER (r AND o) / COUNT(*) FILTER (r) * 100, 2) ELSE 0 END AS preserve_rate,
 CASE WHEN COUNT(*) FILTER (x AND reachable) > 0 THEN ROUND(COUNT(*) FILTER (x AND reachable AND o) / COUNT(*) FILTER (x AND reachable) * 100, 2) ELSE 0::DOUBLE END AS reachable_accuracy"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    part, supp, line, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity")
    raw, truth = (part % 4).cast("string"), (supp % 3).cast("string")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sheet_id"),
        line.alias("row_index"),
        F.get(F.array(*map(F.lit, FIELDS)), (part % 5).cast("int")).alias("field"),
        raw.alias("raw"),
        truth.alias("truth"),
        F.when(q > 30, truth).when(q > 10, raw).otherwise("x").alias("output"),
        F.when(line % 3 == 0, "NO_MATCH").when(line % 3 == 1, "MATCH").otherwise("NA").alias("status"),
        F.when(line % 2 == 0, "ocr_raw").otherwise("plan").alias("source"),
        (supp % 3 != 1).alias("reachable"),
    )


@query("a29_linkage_metrics", f"WITH {CASES} SELECT {METRICS} FROM f")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.linkage_metrics(cases(spark, d))


@query("a29_by_field", f"WITH {CASES} SELECT field, {METRICS} FROM f GROUP BY field")
def a29_field(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.linkage_metrics(cases(spark, d), "field")


MISSES = "m AS (SELECT sheet_id, CASE WHEN source = 'plan' THEN 'reference' ELSE 'reading' END AS error_class, 'cause ' || raw AS root_cause, field, output AS value, source AS reason, truth AS ref, row_index AS repeats FROM c WHERE status = 'NO_MATCH')"


def misses(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("source") == "plan", "reference").otherwise("reading")
    return cases(spark, d).where("status = 'NO_MATCH'").select("sheet_id", kind.alias("error_class"), F.concat(F.lit("cause "), "raw").alias("root_cause"), "field", F.col("output").alias("value"), F.col("source").alias("reason"), F.col("truth").alias("ref"), F.col("row_index").alias("repeats"))


@query("a48_causes", f"WITH {CASES}, {MISSES}, o AS (SELECT error_class, root_cause, COUNT(*) AS n, GREATEST(MAX(repeats) - 1, 0) AS again FROM m GROUP BY error_class, root_cause, sheet_id, field, value, reason, ref), g AS (SELECT error_class, root_cause, CAST(SUM(n) AS BIGINT) AS occurrences, COUNT(*) AS unique_causes, CAST(SUM(again) AS BIGINT) AS repeat_extra FROM o GROUP BY ALL), a AS (SELECT COUNT(*) AS a FROM m) SELECT g.*, ROUND(occurrences / a * 100, 2) AS share, ROUND(occurrences / (a / 0.13::DOUBLE) * 100, 2) AS impact, ROUND(occurrences / (a / 0.13::DOUBLE * 0.05::DOUBLE) * 100, 2) AS share_of_delta FROM g, a")
def a48(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.causes(misses(spark, d), 0.13, 0.05)


@query("a48_sheet_impact", f"WITH {CASES}, {MISSES}, s AS (SELECT sheet_id, COUNT(*) FILTER (status = 'MATCH') AS n_match, COUNT(*) FILTER (status = 'NO_MATCH') AS n_miss FROM c GROUP BY 1), t AS (SELECT sheet_id, error_class, COUNT(*) AS n FROM m GROUP BY ALL), u AS (SELECT sheet_id, root_cause, COUNT(*) AS n FROM m GROUP BY ALL) SELECT s.*, COALESCE((SELECT error_class FROM t WHERE t.sheet_id = s.sheet_id ORDER BY n DESC, error_class LIMIT 1), '') AS top_error_class, COALESCE((SELECT root_cause FROM u WHERE u.sheet_id = s.sheet_id ORDER BY n DESC, root_cause LIMIT 1), '') AS top_root_cause, n_miss AS classified, CASE WHEN n_match + n_miss > 0 THEN ROUND(n_miss / (n_match + n_miss) * 100, 2) ELSE 0::DOUBLE END AS error_rate FROM s")
def a48_sheets(spark: SparkSession, d: str) -> DataFrame:
    s = cases(spark, d).groupBy("sheet_id").agg(F.count_if(F.col("status") == "MATCH").alias("n_match"), F.count_if(F.col("status") == "NO_MATCH").alias("n_miss"))
    return evaluation.sheet_impact(misses(spark, d), s)


RUNS = """k AS (SELECT DISTINCT sheet_id, row_index, field FROM c), p AS (SELECT *, CASE WHEN (sheet_id + row_index) % 4 = 0 THEN '' ELSE 'v' || sheet_id % 3 END AS value, 'r' || row_index % 2 AS ref, CASE WHEN sheet_id % 2 = 0 THEN 'MATCH' ELSE 'NA' END AS status, CASE WHEN field = 'pri' THEN 'declared_plan' ELSE 'plan' END AS source FROM k),
 s AS (SELECT sheet_id, row_index, field, CASE WHEN (sheet_id + row_index) % 6 = 0 THEN '' ELSE 'V' || sheet_id % 4 END AS value, 'r' || row_index % 3 AS ref, CASE WHEN sheet_id % 3 = 0 THEN 'MATCH' ELSE 'NA' END AS status, source FROM p WHERE row_index < 6),
 b AS (SELECT p.sheet_id, p.row_index, p.field, p.source = 'declared_plan' AS dec, p.value AS pv, p.ref AS pr, s.value AS sv, s.ref AS sr, p.status AS before, s.status AS after FROM p JOIN s USING (sheet_id, row_index, field)),
 v AS (SELECT *, CASE WHEN dec THEN pr WHEN pv <> '' THEN pv ELSE pr END AS value, CASE WHEN dec THEN sr ELSE sv END AS shadow_value FROM b),
 diff AS (SELECT sheet_id, row_index, field, CASE WHEN upper(value) <> upper(shadow_value) THEN 'diff' WHEN before <> after THEN 'flip' ELSE 'same' END AS kind, CASE WHEN dec THEN 3 WHEN field IN ('of', 'cliente') THEN 0 WHEN field = 'esp' THEN 1 ELSE 2 END AS severity, value, shadow_value, before, after FROM v WHERE value <> '' OR shadow_value <> '')"""


def runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = cases(spark, d).select("sheet_id", "row_index", "field").distinct()
    sheet, row = F.col("sheet_id"), F.col("row_index")
    text = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    source = F.when(F.col("field") == "pri", "declared_plan").otherwise("plan").alias("source")
    p = k.select("*", F.when((sheet + row) % 4 == 0, "").otherwise(text("v", sheet % 3)).alias("value"), text("r", row % 2).alias("ref"), F.when(sheet % 2 == 0, "MATCH").otherwise("NA").alias("status"), source)
    s = k.where("row_index < 6").select("*", F.when((sheet + row) % 6 == 0, "").otherwise(text("V", sheet % 4)).alias("value"), text("r", row % 3).alias("ref"), F.when(sheet % 3 == 0, "MATCH").otherwise("NA").alias("status"), source)
    return p, s


@query("l19_shadow_diff", f"WITH {CASES}, {RUNS} SELECT * FROM diff")
def l19(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.shadow_diff(*runs(spark, d))


@query("z56_agreement", f"WITH {CASES}, {RUNS} SELECT kind, CASE kind WHEN 'diff' THEN field WHEN 'flip' THEN before || '>' || after ELSE '' END AS what, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM diff) * 100, 2) AS share FROM diff GROUP BY ALL")
def z56(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.agreement(evaluation.shadow_diff(*runs(spark, d)))


@query("z53_categories", "SELECT CASE WHEN p_size % 4 = 0 AND p_size % 3 = 0 THEN 'MATCH_RULE' WHEN p_size % 4 = 0 THEN 'MATCH' WHEN p_size % 4 = 1 THEN 'NO_MATCH' ELSE 'NA' END AS category, COUNT(*) AS n FROM part GROUP BY 1")
def z53(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    status = F.when(size % 4 == 0, "match").when(size % 4 == 1, "NO_MATCH").when(size % 4 == 2, "odd")
    c = evaluation.category(status, F.when(size % 3 == 0, "MATCH_REGRA_FORCADO"))
    return read(spark, d, "part").groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("z53_unjudged", f"WITH {CASES}, g AS (SELECT sheet_id, row_index, bool_or(output <> 'x') AS filled, list_sort(list(DISTINCT field) FILTER (status = 'NA')) AS f FROM c GROUP BY ALL) SELECT sheet_id, row_index, array_to_string(f, ',') AS fields FROM g WHERE filled AND len(f) > 0")
def z53_unjudged(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).withColumns({"value": F.when(F.col("output") != "x", F.col("output")).otherwise(" "), "category": evaluation.category(F.col("status"), F.lit(None).cast("string"))})
    return evaluation.unjudged(c)


@query("z54_template_audit", f"WITH {SHEET}, s AS (SELECT sheet_id, CASE WHEN custkey % 5 = 0 THEN 'fin' ELSE 'base' END AS detected, CASE WHEN custkey % 2 = 0 THEN 'code' ELSE 'label' END AS by_, CASE WHEN custkey % 7 = 0 THEN 'fin' ELSE 'base' END AS code, CASE custkey % 9 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' ELSE 'none' END AS structure FROM sheet), a AS (SELECT *, CASE WHEN detected = 'fin' AND by_ = 'code' THEN 'flip_code' WHEN detected = 'fin' THEN 'flip_label' WHEN structure = 'strong' THEN 'flip_structure' WHEN code = 'fin' OR structure = 'weak' THEN 'ambiguous' ELSE 'no_flip' END AS status FROM s) SELECT sheet_id, status, CASE WHEN status <> 'no_flip' THEN 'fin' ELSE '' END AS proposed, CASE WHEN status IN ('flip_code', 'flip_label', 'no_flip') THEN 'detector:' || by_ WHEN status = 'flip_structure' THEN 'rows' WHEN code = 'fin' THEN 'code against label' ELSE 'weak rows' END AS reason FROM a")
def z54(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("custkey")
    s = sheets(spark, d).select("sheet_id", F.when(c % 5 == 0, "fin").otherwise("base").alias("detected"), F.when(c % 2 == 0, "code").otherwise("label").alias("by"), F.when(c % 7 == 0, "fin").otherwise("base").alias("by_code_alone"), F.when(c % 9 == 0, "strong").when(c % 9 == 1, "weak").otherwise("none").alias("structure"))
    return evaluation.template_audit(s, "fin").select("sheet_id", "status", "proposed", "reason")


@query("z58_row_signs", f"WITH {FACT}, r AS (SELECT sheet_id, of % 3 <> 0 OR of % 5 = 0 OR of % 7 = 0 AS filled, of % 3 = 1 OR of % 5 = 0 AS named FROM fact) SELECT sheet_id, COUNT(*) FILTER (filled) AS filled, COUNT(*) FILTER (named) AS named, COUNT(*) FILTER (named) >= 2 AS front, COUNT(*) FILTER (filled) >= 2 AND COUNT(*) FILTER (named) = 0 AS no_product FROM r GROUP BY sheet_id")
def z58(spark: SparkSession, d: str) -> DataFrame:
    of = F.col("of")
    row = F.struct(F.when(of % 3 == 1, F.lpad(of.cast("string"), 6, "1")).when(of % 3 == 2, "12").alias("of"), F.when(of % 5 == 0, "ABCD").otherwise(" ").alias("modelo"), F.when(of % 7 == 0, "x").alias("other"))
    g = facts(spark, d).groupBy("sheet_id").agg(F.collect_list(row).alias("rows"))
    return g.select("sheet_id", *[(c.cast("long") if n in ("filled", "named") else c).alias(n) for n, c in evaluation.row_signs().items()])


TRAIN = "raw AS (SELECT l_orderkey AS sheet_id, 'rows[' || l_linenumber % 5 || '].of' AS path, MIN(CAST(l_partkey AS VARCHAR)) AS value FROM lineitem GROUP BY ALL), h AS (SELECT sheet_id, field_path AS path, arg_max(new_value, id) AS v FROM edit WHERE source = 'human' GROUP BY ALL), n AS (SELECT DISTINCT sheet_id FROM h WHERE sheet_id IN (SELECT sheet_id FROM raw))"


def trainable(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet_id"), F.concat(F.lit("rows["), (F.col("l_linenumber") % 5).cast("string"), F.lit("].of")).alias("path")).agg(F.min(F.col("l_partkey").cast("string")).alias("value"))
    return evaluation.training_set(raw, edits(spark, d).withColumnRenamed("field_path", "path"), 40)


@query("z57_training_cells", f"WITH {EDIT}, {TRAIN} SELECT sheet_id, path, COALESCE(v, value) AS value FROM (SELECT * FROM raw WHERE sheet_id IN (SELECT sheet_id FROM n)) FULL JOIN (SELECT * FROM h WHERE sheet_id IN (SELECT sheet_id FROM n)) USING (sheet_id, path)")
def z57(spark: SparkSession, d: str) -> DataFrame:
    return trainable(spark, d)[0]


@query("z57_training_split", f"WITH {EDIT}, {TRAIN}, o AS (SELECT sheet_id, row_number() OVER (ORDER BY md5('1:' || sheet_id), sheet_id) AS i, COUNT(*) OVER () AS c FROM n) SELECT sheet_id, CASE WHEN i <= LEAST(40, c // 2) THEN 'exam' ELSE 'train' END AS part FROM o")
def z57_split(spark: SparkSession, d: str) -> DataFrame:
    return trainable(spark, d)[1]
