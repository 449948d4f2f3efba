"""Quality, learning and calibration over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, workorders
from .registry import query
from .tables import EDIT, FACT, SHEET, edits, facts, read, sheets

CELL = f"{FACT}, cell AS (SELECT sheet_id, segmento, operador, setor, CASE qtd % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'MATCH' WHEN 2 THEN 'NO_MATCH' ELSE 'NA' END AS status FROM fact)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    rest = F.col("qtd") % 4
    return facts(spark, d).withColumn("status", F.when(rest < 2, "MATCH").when(rest == 2, "NO_MATCH").otherwise("NA"))


@query("a24_cross_check", f"WITH {CELL}, g AS (SELECT operador, COUNT(*) FILTER (status = 'MATCH') AS n_match, COUNT(*) FILTER (status = 'NO_MATCH') AS n_miss, COUNT(*) FILTER (status = 'NA') AS n_na FROM cell GROUP BY operador) SELECT *, CASE WHEN n_match + n_miss > 0 THEN ROUND(n_match / (n_match + n_miss), 6) END AS rate FROM g")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return quality.cross_check(cells(spark, d), ["operador"])


@query("a25_by_field_status", f"WITH {CELL} SELECT segmento, COUNT(*) FILTER (status = 'MATCH') AS \"MATCH\", COUNT(*) FILTER (status = 'NO_MATCH') AS \"NO_MATCH\", COUNT(*) FILTER (status = 'NA') AS \"NA\" FROM cell GROUP BY segmento")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("segmento").pivot("status", ["MATCH", "NO_MATCH", "NA"]).count()


@query(
    "a26_attractors",
    f"""WITH {EDIT}, e AS (SELECT *, string_split(field_path, '.')[-1] AS field FROM edit WHERE source = 'human'), p AS (SELECT string_split(field_path, '.')[-1] AS field, COUNT(DISTINCT sheet_id) AS population FROM edit GROUP BY 1),
 pr AS (SELECT field, old_value || '>' || new_value AS pair, COUNT(*) AS n FROM e GROUP BY ALL), b AS (SELECT field, string_agg(pair, ',' ORDER BY n DESC, pair) AS top_pairs FROM (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, pair) <= 5) GROUP BY field),
 g AS (SELECT field, COUNT(*) AS n, COUNT(DISTINCT sheet_id) AS n_sheets FROM e GROUP BY field)
 SELECT field, n, n_sheets, population, top_pairs, ROUND(n_sheets / population, 6) AS rate, CASE WHEN n < 5 THEN 'low' WHEN ROUND(n_sheets / population, 6) >= 0.2 THEN 'high' WHEN ROUND(n_sheets / population, 6) >= 0.05 THEN 'medium' ELSE 'low' END AS severity FROM g JOIN p USING (field) JOIN b USING (field)""",
)
def a26(spark: SparkSession, d: str) -> DataFrame:
    e = edits(spark, d).withColumn("field", F.substring_index("field_path", ".", -1))
    return quality.attractors(e, e.groupBy("field").agg(F.count_distinct("sheet_id").alias("population")), "field")


@query(
    "a28_extraction_metrics",
    """WITH c AS (SELECT conv_id AS sheet, role AS expected, CASE WHEN turn % 4 = 0 THEN upper(role) WHEN turn % 4 = 1 THEN role WHEN turn % 4 = 2 THEN 'x' ELSE ' ' || role END AS actual, turn % 2 = 0 AS critical FROM conversations),
 s AS (SELECT *, lower(trim(expected)) = lower(trim(actual)) AS same, trim(expected) = trim(actual) AS exact FROM c), b AS (SELECT sheet, COUNT(*) AS n, COUNT(*) FILTER (same) AS ok, COUNT(*) FILTER (exact) AS oke, COUNT(*) FILTER (critical) AS crit, COUNT(*) FILTER (critical AND same) AS crit_ok FROM s GROUP BY sheet)
 SELECT CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(ok) / SUM(n), 6) AS accuracy, ROUND(SUM(oke) / SUM(n), 6) AS exact_accuracy, ROUND(SUM(crit_ok) / SUM(crit), 6) AS critical_accuracy, CAST(0 AS DOUBLE) AS invented_rate, ROUND(AVG(CAST(ok = n AS INTEGER)), 6) AS perfect_sheets FROM b""",
)
def a28(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn") % 4
    actual = F.when(turn == 0, F.upper("role")).when(turn == 1, F.col("role")).when(turn == 2, "x").otherwise(F.concat(F.lit(" "), F.col("role")))
    return quality.extraction_metrics(read(spark, d, "conversations").select(F.col("conv_id").alias("sheet"), F.col("role").alias("expected"), actual.alias("actual"), (F.col("turn") % 2 == 0).alias("critical")))


@query("t4_worst_errors", f"WITH {CELL}, b AS (SELECT sheet_id, operador, CASE WHEN status = 'NO_MATCH' AND setor LIKE '1%' THEN 0 WHEN status = 'NO_MATCH' THEN 1 END AS band FROM cell) SELECT DISTINCT sheet_id, operador, band FROM (SELECT * FROM b WHERE band IS NOT NULL ORDER BY band, sheet_id, operador LIMIT 50)")
def t4(spark: SparkSession, d: str) -> DataFrame:
    band = F.when((F.col("status") == "NO_MATCH") & F.col("setor").startswith("1"), 0).when(F.col("status") == "NO_MATCH", 1)
    return quality.worst(cells(spark, d), 50, band, F.col("sheet_id"), F.col("operador")).select("sheet_id", "operador", "band").distinct()


@query("a31_alias_rules", f"WITH {EDIT}, e AS (SELECT string_split(field_path, '.')[-1] AS kind, upper(trim(old_value)) AS old, trim(new_value) AS new, id FROM edit WHERE source = 'human') SELECT kind, old, new, COUNT(*) AS support, MIN(id) AS first_id, MAX(id) AS last_id FROM e WHERE old <> '' AND new <> '' AND old <> upper(new) GROUP BY ALL HAVING COUNT(*) >= 2")
def a31(spark: SparkSession, d: str) -> DataFrame:
    return quality.alias_rules(edits(spark, d))


@query("a32_case_rules", "WITH p AS (SELECT p_type AS old_value, CASE WHEN p_size % 3 = 0 THEN lower(p_type) ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS new_value FROM part), c AS (SELECT upper(new_value) AS key, new_value, COUNT(*) AS support FROM p WHERE upper(old_value) = upper(new_value) AND old_value <> new_value GROUP BY ALL) SELECT *, COUNT(*) OVER (PARTITION BY key) > 1 AS conflict FROM c WHERE support >= 2")
def a32(spark: SparkSession, d: str) -> DataFrame:
    new = F.when(F.col("p_size") % 3 == 0, F.lower("p_type")).otherwise(F.initcap(F.lower("p_type")))
    return quality.case_rules(read(spark, d, "part").select(F.col("p_type").alias("old_value"), new.alias("new_value")))


@query(
    "a37_confusion",
    "WITH p AS (SELECT event_type AS gold, CASE WHEN event_id % 3 = 0 THEN event_type ELSE substr('abcdefghij', CAST(user_id % 10 + 1 AS INTEGER), 1) END AS ocr FROM events), n AS (SELECT gold, ocr, COUNT(*) AS n FROM p GROUP BY ALL), t AS (SELECT *, SUM(n) OVER (PARTITION BY gold) AS total FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY n DESC, ocr) AS place FROM t WHERE gold <> ocr AND n >= 2) SELECT gold, ocr, n, place, ROUND(n / total, 6) AS p FROM r WHERE place <= 5",
)
def a37(spark: SparkSession, d: str) -> DataFrame:
    ocr = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.substring(F.lit("abcdefghij"), (F.col("user_id") % 10 + 1).cast("int"), F.lit(1)))
    return quality.confusion(read(spark, d, "events").select(F.col("event_type").alias("gold"), ocr.alias("ocr")))


@query("a34_observed_values", f"WITH {FACT}, s AS (SELECT 'modelo' AS field, modelo AS value, COUNT(DISTINCT sheet_id) AS n_sheets FROM fact GROUP BY modelo HAVING COUNT(DISTINCT sheet_id) >= 2) SELECT * FROM s WHERE value NOT IN (SELECT p_brand || ' ' || p_type FROM part WHERE p_size < 25)")
def a34(spark: SparkSession, d: str) -> DataFrame:
    c = facts(spark, d).select(F.lit("modelo").alias("field"), F.col("modelo").alias("value"), "sheet_id")
    known = read(spark, d, "part").where("p_size < 25").select(F.lit("modelo").alias("field"), F.concat_ws(" ", "p_brand", "p_type").alias("value")).distinct()
    return quality.observed_values(c, known)


@query("a35_few_shot", "WITH r AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS own FROM customer) SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY own, c_acctbal DESC, c_custkey) AS place FROM r QUALIFY place <= 3")
def a35(spark: SparkSession, d: str) -> DataFrame:
    return quality.few_shot(read(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_acctbal", "c_custkey").select("c_custkey", "c_mktsegment", "place")


@query("a36_corrections_per_sheet", f"WITH {SHEET}, {EDIT}, n AS (SELECT sheet_id FROM sheet WHERE status = 'validated' ORDER BY sheet_id LIMIT 50) SELECT COUNT(DISTINCT n.sheet_id) AS sheets, COUNT(id) AS edits, ROUND(COUNT(id) / COUNT(DISTINCT n.sheet_id), 6) AS mean FROM n LEFT JOIN (SELECT * FROM edit WHERE source = 'human') USING (sheet_id)")
def a36(spark: SparkSession, d: str) -> DataFrame:
    n = sheets(spark, d).where("status = 'validated'").orderBy("sheet_id").limit(50).select("sheet_id")
    j = n.join(edits(spark, d).where("source = 'human'"), "sheet_id", "left")
    return j.agg(F.count_distinct("sheet_id").alias("sheets"), F.count("id").alias("edits"), F.round(F.count("id") / F.count_distinct("sheet_id"), 6).alias("mean"))


@query("a38_bands", f"WITH {FACT} SELECT operador, ROUND(quantile_cont(CAST(qtd AS DOUBLE), 0.05), 4) AS p5, ROUND(quantile_cont(CAST(qtd AS DOUBLE), 0.5), 4) AS p50, ROUND(quantile_cont(CAST(qtd AS DOUBLE), 0.95), 4) AS p95, MIN(qtd) AS least, MAX(qtd) AS most, COUNT(qtd) AS n FROM fact GROUP BY operador")
def a38(spark: SparkSession, d: str) -> DataFrame:
    return quality.bands(facts(spark, d), ["operador"], "qtd")


@query("a40_ranked_bands", f"WITH {FACT}, s AS (SELECT operador, list_sort(list(qtd)) AS s, COUNT(*) AS n FROM fact GROUP BY operador) SELECT operador, s[n] AS most, s[n // 2 + 1] AS median, s[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1] AS p95, n FROM s")
def a40(spark: SparkSession, d: str) -> DataFrame:
    return quality.ranked_bands(facts(spark, d), ["operador"], "qtd")


@query("a41_first_value", f"WITH {FACT} SELECT of, arg_min(cliente, (sheet_id, row_index, cliente)) AS cliente FROM fact GROUP BY of")
def a41(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).groupBy("of").agg(F.min_by("cliente", F.struct("sheet_id", "row_index", "cliente")).alias("cliente"))


@query("a42_inconsistent", f"WITH {FACT} SELECT sheet_id, COUNT(*) AS n, COUNT(DISTINCT modelo) AS n_modelo, COUNT(DISTINCT larg) AS n_larg FROM fact GROUP BY sheet_id HAVING COUNT(DISTINCT modelo) > 1 OR COUNT(DISTINCT larg) > 1")
def a42(spark: SparkSession, d: str) -> DataFrame:
    return quality.consistency(facts(spark, d), "sheet_id", ["modelo", "larg"])


@query("a43_lexicon", "SELECT substr(p_name, 1, 5) AS prefix, COUNT(DISTINCT p_name) AS n FROM part GROUP BY 1")
def a43(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy(F.substring("p_name", 1, 5).alias("prefix")).agg(F.count_distinct("p_name").alias("n"))


@query("a45_entropy", f"WITH {FACT}, w AS (SELECT operador, segmento, CAST(SUM(qtd) AS DOUBLE) AS w FROM fact GROUP BY ALL), p AS (SELECT operador, w / SUM(w) OVER (PARTITION BY operador) AS p FROM w WHERE w > 0) SELECT operador, COUNT(*) AS n, CASE WHEN COUNT(*) > 1 THEN ROUND(-SUM(p * log2(p)) / log2(COUNT(*)), 6) ELSE 0 END AS entropy, ROUND(SUM(p * p), 6) AS hhi FROM p GROUP BY operador")
def a45(spark: SparkSession, d: str) -> DataFrame:
    w = facts(spark, d).groupBy("operador", "segmento").agg(F.sum("qtd").cast("double").alias("w"))
    return quality.entropy(w, "operador", "w")


@query(
    "a46_murphy",
    """WITH p AS (SELECT LEAST(0.999, value / 200) AS p, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS y FROM events), b AS (SELECT LEAST(9, floor(p * 10)) AS bin, COUNT(*) AS n, SUM(p) AS sp, SUM(y) AS sy, SUM((p - y) * (p - y)) AS se FROM p GROUP BY 1), t AS (SELECT SUM(n) AS n, CAST(SUM(sy) AS DOUBLE) / SUM(n) AS base, SUM(se) AS se FROM b)
 SELECT CAST(t.n AS BIGINT) AS n, ROUND(CAST(t.se AS DOUBLE) / t.n, 6) AS brier, ROUND((SELECT SUM(b.n * pow(CAST(b.sp AS DOUBLE) / b.n - CAST(b.sy AS DOUBLE) / b.n, 2)) FROM b) / t.n, 6) AS reliability, ROUND((SELECT SUM(b.n * pow(CAST(b.sy AS DOUBLE) / b.n - t.base, 2)) FROM b) / t.n, 6) AS resolution, ROUND(t.base * (1 - t.base), 6) AS uncertainty FROM t""",
)
def a46(spark: SparkSession, d: str) -> DataFrame:
    return quality.murphy(read(spark, d, "events").select(F.least(F.lit(0.999), F.col("value") / 200).alias("p"), (F.col("event_type") == "error").cast("double").alias("y")))


@query("a49_gate", f"WITH {CELL}, s AS (SELECT CASE WHEN sheet_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS arm, sheet_id, COUNT(*) FILTER (status = 'NO_MATCH') AS n FROM cell GROUP BY ALL), g AS (SELECT ROUND(AVG(n) FILTER (arm = 'baseline'), 6) AS baseline, ROUND(AVG(n) FILTER (arm = 'candidate'), 6) AS candidate FROM s) SELECT *, candidate <= baseline * 1.05 AS passes FROM g")
def a49(spark: SparkSession, d: str) -> DataFrame:
    return quality.need_attention(cells(spark, d).withColumn("arm", F.when(F.col("sheet_id") % 2 == 0, "baseline").otherwise("candidate")))


@query("a52_declared", "WITH r AS (SELECT p_partkey AS k, p_size % 3 AS declared, p_size % 2 AS actual, COALESCE(lead(p_size % 2) OVER (ORDER BY p_partkey), first_value(p_size % 2) OVER (ORDER BY p_partkey)) AS nxt FROM part) SELECT ROUND(AVG(CAST(declared = actual AS INTEGER)), 6) AS m, ROUND(AVG(CAST(declared = nxt AS INTEGER)), 6) AS u FROM r")
def a52(spark: SparkSession, d: str) -> DataFrame:
    return quality.agreement(read(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 3).alias("declared"), (F.col("p_size") % 2).alias("actual")), "declared", "actual", "k")


@query("w10_margin", f"WITH {FACT}, s AS (SELECT sheet_id, operador, CAST(SUM(qtd) AS BIGINT) AS score FROM fact GROUP BY ALL), w AS (SELECT sheet_id, arg_max(operador, (score, -CAST(substr(operador, 10) AS INTEGER))) AS winner, MAX(score) AS score FROM s GROUP BY sheet_id), r AS (SELECT w.sheet_id, w.winner, w.score, MAX(s.score) FILTER (s.operador <> w.winner) AS rival FROM w JOIN s USING (sheet_id) GROUP BY ALL) SELECT *, score - rival AS margin FROM r")
def w10(spark: SparkSession, d: str) -> DataFrame:
    s = facts(spark, d).groupBy("sheet_id", "operador").agg(F.sum("qtd").alias("score"))
    return workorders.margin(s, "sheet_id", "operador", "score")


@query("m11_collision_probability", f"WITH {FACT}, n AS (SELECT cliente, CAST(COUNT(*) AS DOUBLE) AS n FROM fact GROUP BY 1) SELECT ROUND(SUM(n * n) / (SUM(n) * SUM(n)), 9) AS p FROM n")
def m11(spark: SparkSession, d: str) -> DataFrame:
    n = facts(spark, d).groupBy("cliente").agg(F.count("*").cast("double").alias("n"))
    return n.agg(F.round(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 9).alias("p"))


SUBSTITUTED = f"{EDIT}, p AS (SELECT DISTINCT substr(new_value, 1, 1) || 'x' AS e, old_value || 'x' AS f FROM edit), c AS (SELECT e, f, unnest(range(1, length(e) + 1)) AS i FROM p), n AS (SELECT substr(e, CAST(i AS INTEGER), 1) AS gold, substr(f, CAST(i AS INTEGER), 1) AS ocr, COUNT(*) AS n FROM c GROUP BY ALL)"


def short(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of two characters with the same last one, whose alignment is plain."""
    first = F.concat(F.substring("new_value", 1, 1), F.lit("x"))
    return edits(spark, d).select(first.alias("new_value"), F.concat("old_value", F.lit("x")).alias("old_value"))


@query("a33_confusions", f"WITH {SUBSTITUTED}, t AS (SELECT gold, SUM(n) AS total FROM n GROUP BY gold) SELECT gold, ocr, CAST(n AS BIGINT) AS n, ROUND(n / total, 6) AS weight FROM n JOIN t USING (gold) WHERE gold <> ocr AND n >= 1")
def a33(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import channel

    return channel.confusions(channel.substitutions(short(spark, d)), least=1)


@query("m12_costs", f"WITH {SUBSTITUTED}, t AS (SELECT gold, SUM(n) AS total FROM n GROUP BY gold) SELECT gold, ocr, ROUND(GREATEST(3.0::DOUBLE, LEAST(10.0::DOUBLE, -log2((n + 0.5::DOUBLE) / (total + 18)))), 6) AS bits FROM n JOIN t USING (gold) WHERE gold <> ocr")
def m12(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import channel

    return channel.costs(channel.substitutions(short(spark, d)))
