"""Listings, versions, resolutions, audits and remaining predicates over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import registry_ops as ops
from .registry import query
from .tables import AS_OF, EDIT, FACT, SHEET, edits, facts, read, sheets


@query("z4_listed", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 200")
def z4(spark: SparkSession, d: str) -> DataFrame:
    return ops.listed(read(spark, d, "customer"), F.desc("c_acctbal"), F.col("c_custkey"), limit=500, c_mktsegment="BUILDING", c_nationkey=None).select("c_custkey", "c_acctbal")


@query("z5_quarantine_first", f"WITH {SHEET} SELECT sheet_id, status FROM sheet ORDER BY (status = 'pending') DESC, total DESC, sheet_id LIMIT 30")
def z5(spark: SparkSession, d: str) -> DataFrame:
    return ops.listed(sheets(spark, d), (F.col("status") == "pending").desc(), F.desc("total"), F.col("sheet_id"), limit=30).select("sheet_id", "status")


@query("z6_status_counts", f"WITH {SHEET} SELECT status, COUNT(*) AS n FROM sheet GROUP BY status")
def z6(spark: SparkSession, d: str) -> DataFrame:
    return sheets(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("z8_activated", "SELECT r_regionkey AS version, r_regionkey = 3 AS active FROM region")
def z8(spark: SparkSession, d: str) -> DataFrame:
    return ops.activated(read(spark, d, "region").select(F.col("r_regionkey").alias("version")), 3)


ALIASES = "alias AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS alias, upper(split_part(p_name, ' ', 1)) AS template FROM part UNION SELECT DISTINCT p_name, 'FULL' FROM part WHERE p_size < 10)"


@query(
    "z9_templates",
    f"""WITH {ALIASES}, s AS (SELECT p_partkey AS sheet_id, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' x' WHEN p_partkey % 5 = 1 THEN 'none' ELSE p_name END AS label, CASE WHEN p_partkey % 7 = 0 THEN 'kept' END AS stored, p_partkey % 11 = 0 AS scrap FROM part),
 e AS (SELECT alias AS label, MIN(template) AS t FROM alias GROUP BY 1), l AS (SELECT label, arg_max(template, (length(alias), alias)) AS t FROM (SELECT DISTINCT label FROM s) x JOIN alias ON contains(label, alias) AND length(alias) >= 3 GROUP BY label)
 SELECT sheet_id, CASE WHEN stored IS NOT NULL THEN stored WHEN scrap THEN 'scrap' ELSE COALESCE(e.t, l.t, 'base') END AS template, CASE WHEN stored IS NOT NULL THEN 'stored' WHEN scrap THEN 'scrap' WHEN e.t IS NOT NULL THEN 'alias' WHEN l.t IS NOT NULL THEN 'contained' ELSE 'default' END AS why FROM s LEFT JOIN e USING (label) LEFT JOIN l USING (label)""",
)
def z9(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    word = F.get(F.split("p_name", " "), F.lit(0))
    aliases = p.select(word.alias("alias"), F.upper(word).alias("template")).union(p.where("p_size < 10").select("p_name", F.lit("FULL"))).distinct()
    k = F.col("p_partkey")
    label = F.when(k % 5 == 0, F.concat("p_name", F.lit(" x"))).when(k % 5 == 1, "none").otherwise(F.col("p_name"))
    s = p.select(k.alias("sheet_id"), label.alias("label"), F.when(k % 7 == 0, "kept").alias("stored"), (k % 11 == 0).alias("scrap"))
    return ops.resolved_template(s, aliases, "base").select("sheet_id", "template", "why")


@query("z15_site", f"WITH {SHEET} SELECT sheet_id, COALESCE(CASE WHEN sheet_id % 3 = 0 THEN 'own' END, CASE WHEN setor < '3' THEN 'site ' || substr(setor, 1, 1) END, 'HQ') AS site FROM sheet")
def z15(spark: SparkSession, d: str) -> DataFrame:
    s = sheets(spark, d).select("sheet_id", F.col("setor").alias("template"), F.when(F.col("sheet_id") % 3 == 0, "own").alias("site"))
    t = s.select("template").distinct().where("template < '3'").select("template", F.concat(F.lit("site "), F.substring("template", 1, 1)).alias("site"))
    return ops.site_of(s, t).select("sheet_id", "site")


@query("z16_first_seen", "SELECT event_type || user_id AS sha, MIN(epoch_us(ts)) AS first_seen FROM events GROUP BY 1 ORDER BY first_seen DESC, sha LIMIT 20")
def z16(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return ops.first_seen(e.select(F.concat("event_type", F.col("user_id").cast("string")).alias("sha"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime")))


@query("z24_alias_conflicts", "WITH a AS (SELECT DISTINCT p_name AS candidate FROM part), b AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS alias FROM part UNION SELECT DISTINCT p_name FROM part) SELECT candidate, alias, CASE WHEN candidate = alias THEN 'exact' ELSE 'contains' END AS kind FROM a JOIN b ON contains(candidate, alias) OR contains(alias, candidate)")
def z24(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    b = p.select(F.get(F.split("p_name", " "), F.lit(0)).alias("alias")).union(p.select("p_name")).distinct()
    return ops.alias_conflicts(p.select(F.col("p_name").alias("candidate")).distinct(), b)


@query("z26_review_queue", f"WITH {FACT}, c AS (SELECT sheet_id, row_index || '.' || of || '.' || suppkey || '.' || qtd || '.' || price AS path, CASE WHEN qtd % 5 <> 0 THEN qtd / 50 END AS confidence, 1.0 + row_index % 3 AS weight, CAST(qtd AS VARCHAR) AS written, CASE WHEN qtd % 3 = 0 THEN CAST(qtd AS VARCHAR) WHEN qtd % 7 <> 0 THEN 'x' ELSE '' END AS proposed FROM fact) SELECT sheet_id, path, ROUND(CAST(weight * (1 - confidence) AS DOUBLE), 6) AS priority FROM c WHERE confidence >= 0.35 AND confidence < 0.75 AND proposed <> '' AND written <> proposed QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY priority DESC, path) <= 3")
def z26(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws(".", *[F.col(c).cast("string") for c in ("row_index", "of", "suppkey", "qtd", "price")])
    qtd = F.col("qtd")
    proposed = F.when(qtd % 3 == 0, qtd.cast("string")).when(qtd % 7 != 0, "x").otherwise("")
    c = facts(spark, d).select("sheet_id", path.alias("path"), F.when(qtd % 5 != 0, qtd / 50).alias("confidence"), (1.0 + F.col("row_index") % 3).alias("weight"), qtd.cast("string").alias("written"), proposed.alias("proposed"))
    return ops.review_queue(c).select("sheet_id", "path", "priority")


@query("z28_policy_diff", "WITH a AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, p_size + p_partkey % 2 AS v FROM part WHERE p_partkey % 5 <> 0) SELECT k, a.v AS before, b.v AS after, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v")
def z28(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumnRenamed("p_partkey", "k")
    return ops.policy_diff(p.where("k % 3 != 0").select("k", F.col("p_size").cast("bigint").alias("v")), p.where("k % 5 != 0").select("k", (F.col("p_size") + F.col("k") % 2).alias("v")), "k", "v")


@query("z31_stale", f"WITH {SHEET} SELECT sheet_id, date_diff('day', iso_date, DATE '{AS_OF}') AS age, CASE WHEN date_diff('day', iso_date, DATE '{AS_OF}') >= 60 THEN 'stale' WHEN date_diff('day', iso_date, DATE '{AS_OF}') >= 30 THEN 'aging' ELSE 'fresh' END AS state FROM sheet")
def z31(spark: SparkSession, d: str) -> DataFrame:
    return ops.stale(sheets(spark, d).select("sheet_id", F.col("iso_date").alias("fitted")), AS_OF).select("sheet_id", "age", "state")


@query("z32_merged_weights", "WITH a AS (SELECT n_nationkey AS k, n_regionkey AS w FROM nation), b AS (SELECT r_regionkey + 22 AS k, 99 AS w FROM region) SELECT k, COALESCE(b.w, a.w) AS w FROM a FULL JOIN b USING (k)")
def z32(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("w"))
    return ops.merged_weights(n, read(spark, d, "region").select((F.col("r_regionkey") + 22).alias("k"), F.lit(99).alias("w")), ["k"], "w")


@query("z14_file_names", f"WITH {SHEET}, n AS (SELECT *, row_number() OVER (PARTITION BY setor, iso_date ORDER BY sheet_id) AS n FROM sheet) SELECT sheet_id, setor || '_' || iso_date || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS name FROM n")
def z14(spark: SparkSession, d: str) -> DataFrame:
    return ops.file_names(sheets(spark, d), "setor", "iso_date").select("sheet_id", "name")


@query("z50_grid_fit", "WITH p AS (SELECT value / 20 - 2 AS bits, CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM events), t AS (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.5::DOUBLE, 5.0::DOUBLE]) AS t) SELECT t, ROUND(AVG(pow(1 / (1 + pow(2.0, -bits / t)) - y, 2)), 9) AS brier FROM p, t GROUP BY t ORDER BY brier, t LIMIT 1")
def z50(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select((F.col("value") / 20 - 2).alias("bits"), (F.col("event_type") == "error").cast("double").alias("y"))
    return ops.grid_fit(e, [0.5, 1.0, 2.5, 5.0])


@query("z49_labelled", "WITH r AS (SELECT p_partkey AS row_id, p_size AS written, p_size + p_partkey % 2 AS found, CASE WHEN p_partkey % 4 <> 0 THEN p_size + p_partkey % 3 END AS truth FROM part), k AS (SELECT *, CASE WHEN truth IS NULL THEN 'outside' WHEN written = truth THEN 'good' WHEN found = truth THEN 'corrected' ELSE 'shifted' END AS kind FROM r) SELECT row_id, kind FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY row_id) <= 40")
def z49(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    r = read(spark, d, "part").select(k.alias("row_id"), size.alias("written"), (size + k % 2).alias("found"), F.when(k % 4 != 0, size + k % 3).alias("truth"))
    return ops.labelled(r, 40).select("row_id", "kind")


@query("z51_coverage", f"WITH {FACT}, c AS (SELECT setor, CASE qtd % 3 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'NO_MATCH' ELSE 'NA' END AS status FROM fact) SELECT setor, COUNT(*) FILTER (status = 'MATCH') AS \"MATCH\", COUNT(*) FILTER (status = 'NO_MATCH') AS \"NO_MATCH\", COUNT(*) FILTER (status = 'NA') AS \"NA\", ROUND(COUNT(*) FILTER (status = 'NA') / COUNT(*), 6) AS na_share FROM c GROUP BY setor")
def z51(spark: SparkSession, d: str) -> DataFrame:
    rest = F.col("qtd") % 3
    c = facts(spark, d).withColumn("status", F.when(rest == 0, "MATCH").when(rest == 1, "NO_MATCH").otherwise("NA"))
    return ops.coverage(c, "setor", ("MATCH", "NO_MATCH", "NA"))


@query("z55_gate", f"WITH {FACT}, c AS (SELECT qtd % 4 <> 0 AS old_ok, qtd % 5 <> 0 AS new_ok, sheet_id % 7 = 0 AS blind FROM fact), g AS (SELECT ROUND(AVG(CAST(old_ok AS INTEGER)), 6) AS old, ROUND(AVG(CAST(new_ok AS INTEGER)), 6) AS new, ROUND(AVG(CASE WHEN blind THEN CAST(old_ok AS INTEGER) END), 6) AS old_blind, ROUND(AVG(CASE WHEN blind THEN CAST(new_ok AS INTEGER) END), 6) AS new_blind FROM c) SELECT *, new >= old AND new_blind >= old_blind AS passes FROM g")
def z55(spark: SparkSession, d: str) -> DataFrame:
    return ops.gate(facts(spark, d).withColumns({"old_ok": F.col("qtd") % 4 != 0, "new_ok": F.col("qtd") % 5 != 0}), F.col("sheet_id") % 7 == 0)


@query("p3_between", f"WITH {SHEET} SELECT COUNT(*) AS n FROM sheet WHERE iso_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return sheets(spark, d).where(F.col("iso_date").between(F.lit("1997-01-01").cast("date"), F.lit("1997-03-31").cast("date"))).agg(F.count("*").alias("n"))


@query("p1_json_paths", "SELECT event_id, COALESCE(CAST(json_extract_string(props, '$.none') AS INTEGER), CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events")
def p1(spark: SparkSession, d: str) -> DataFrame:
    at = lambda p: F.get_json_object("props", p).cast("int")
    return read(spark, d, "events").select("event_id", F.coalesce(at("$.none"), at("$.k"), F.lit(0)).alias("k"))


@query("p7_like_prefix", f"WITH {EDIT} SELECT COUNT(*) AS n FROM edit WHERE field_path LIKE 'rows[1]%' AND edited_at >= TIMESTAMP '2024-01-10' - INTERVAL 5 DAY")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return edits(spark, d).where(F.col("field_path").startswith("rows[1]") & (F.col("edited_at") >= F.expr("timestamp '2024-01-10' - interval 5 days"))).agg(F.count("*").alias("n"))


@query("p6_filtered_listing", f"WITH {FACT} SELECT sheet_id, status FROM sheet WHERE upper(setor) = upper('1-urgent') AND iso_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND sheet_id IN (SELECT sheet_id FROM fact WHERE of BETWEEN 10 AND 60)")
def p6(spark: SparkSession, d: str) -> DataFrame:
    s = sheets(spark, d).where((text.fold(F.col("setor")) == "1-URGENT") & F.col("iso_date").between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date")))
    return s.join(facts(spark, d).where("of between 10 and 60"), "sheet_id", "left_semi").select("sheet_id", "status")


@query("p17_plan_search", "WITH x AS (SELECT p_partkey, p_name, CASE WHEN CAST(p_partkey AS VARCHAR) = 'red' THEN 0 WHEN p_name LIKE 'red%' THEN 1 WHEN p_name LIKE '%red%' THEN 2 END AS tier FROM part) SELECT p_partkey, tier FROM x WHERE tier IS NOT NULL ORDER BY tier, p_partkey LIMIT 50 OFFSET 10")
def p17(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    tier = F.when(F.col("p_partkey").cast("string") == "red", 0).when(name.startswith("red"), 1).when(name.contains("red"), 2)
    return read(spark, d, "part").withColumn("tier", tier).where("tier is not null").orderBy("tier", "p_partkey").offset(10).limit(50).select("p_partkey", "tier")


@query("p18_identifiers_in_text", "WITH t AS (SELECT conv_id, turn, CAST(unnest(regexp_extract_all(text || ' see ' || (conv_id * 13 % 100) || ' and ' || turn, '\\b[0-9]{1,6}\\b')) AS BIGINT) AS k FROM conversations) SELECT DISTINCT conv_id, turn, n_name FROM t JOIN nation ON n_nationkey = k")
def p18(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat("text", F.lit(" see "), (F.col("conv_id") * 13 % 100).cast("string"), F.lit(" and "), F.col("turn").cast("string"))
    t = read(spark, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(said, F.lit("\\b[0-9]{1,6}\\b"), F.lit(0))).alias("k")).withColumn("k", F.col("k").cast("bigint"))
    return t.join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("k")).select("conv_id", "turn", "n_name").distinct()


@query("t3_nulls_last", "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size END AS left_over FROM part ORDER BY left_over DESC NULLS LAST, p_partkey LIMIT 100")
def t3(spark: SparkSession, d: str) -> DataFrame:
    left = F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("left_over")
    return read(spark, d, "part").select("p_partkey", left).orderBy(F.col("left_over").desc_nulls_last(), "p_partkey").limit(100)


@query("t6_collation", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_type), p_partkey LIMIT 40")
def t6(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").orderBy(F.lower("p_type"), "p_partkey").limit(40).select("p_partkey", "p_name")


@query("u6_ordered_union", f"WITH {FACT} SELECT sheet_id, string_agg(segmento, ',' ORDER BY f) AS parts FROM (SELECT sheet_id, operador AS segmento, MIN((row_index, of, suppkey, qtd)) AS f FROM fact GROUP BY ALL) GROUP BY sheet_id")
def u6(spark: SparkSession, d: str) -> DataFrame:
    """The same over all facts."""
    f = facts(spark, d).groupBy("sheet_id", "operador").agg(F.min(F.struct("row_index", "of", "suppkey", "qtd")).alias("f"))
    return f.groupBy("sheet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "operador"))), lambda x: x["operador"]), ",").alias("parts"))


@query("a39_value_sets", f"WITH {FACT} SELECT of, array_to_string(list_sort(list_distinct(list(flag))), ',') AS flags, COUNT(DISTINCT larg) AS n_larg FROM fact GROUP BY of")
def a39(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).groupBy("of").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"), F.count_distinct("larg").alias("n_larg"))


@query("a44_timing_percentiles", "SELECT event_type, ROUND(quantile_cont(value, 0.5), 4) AS p50, ROUND(quantile_cont(value, 0.95), 4) AS p95, MAX(value) AS most FROM events GROUP BY 1")
def a44(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.percentile("value", 0.95), 4).alias("p95"), F.max("value").alias("most"))


@query("a47_dataset_profile", f"WITH {SHEET}, {EDIT} SELECT status, COUNT(DISTINCT sheet_id) AS sheets, COUNT(id) AS edits, CAST(COALESCE(SUM(CAST(new_value AS INTEGER)), 0) AS BIGINT) AS total FROM sheet LEFT JOIN edit USING (sheet_id) GROUP BY status")
def a47(spark: SparkSession, d: str) -> DataFrame:
    j = sheets(spark, d).join(edits(spark, d), "sheet_id", "left")
    return j.groupBy("status").agg(F.count_distinct("sheet_id").alias("sheets"), F.count("id").alias("edits"), F.coalesce(F.sum(F.col("new_value").cast("bigint")), F.lit(0)).alias("total"))


@query("a50_last_truth", f"WITH {EDIT} SELECT sheet_id, field_path, arg_max(new_value, id) AS truth FROM edit WHERE source = 'human' GROUP BY ALL")
def a50(spark: SparkSession, d: str) -> DataFrame:
    return edits(spark, d).where("source = 'human'").groupBy("sheet_id", "field_path").agg(F.max_by("new_value", "id").alias("truth"))


@query("a30_examples", f"WITH {FACT}, c AS (SELECT setor, sheet_id, of, suppkey, qtd, price FROM fact WHERE qtd % 3 = 1) SELECT setor, sheet_id, of, row_number() OVER (PARTITION BY setor ORDER BY sheet_id, of, suppkey, qtd, price) AS place FROM c QUALIFY place <= 5")
def a30(spark: SparkSession, d: str) -> DataFrame:
    c = facts(spark, d).where("qtd % 3 = 1")
    return ops.most_used_priority(c, "setor", 5, *map(F.col, ("sheet_id", "of", "suppkey", "qtd", "price"))).select("setor", "sheet_id", "of", "place")


@query("w14_group_sizes", f"WITH {FACT} SELECT sheet_id, of, COUNT(*) AS n FROM fact GROUP BY sheet_id, of HAVING COUNT(*) > 1")
def w14(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).groupBy("sheet_id", "of").agg(F.count("*").alias("n")).where("n > 1")


@query("j3_left_edits", f"WITH {SHEET}, {EDIT} SELECT id, COALESCE(status, '?') AS status FROM edit LEFT JOIN sheet USING (sheet_id) WHERE source = 'human'")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return edits(spark, d).where("source = 'human'").join(sheets(spark, d), "sheet_id", "left").select("id", F.coalesce("status", F.lit("?")).alias("status"))


@query("j4_id_range", f"WITH {SHEET}, {EDIT} SELECT setor, COUNT(*) AS n FROM edit JOIN sheet USING (sheet_id) WHERE id > 100 AND id <= 5000 GROUP BY setor")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return edits(spark, d).where("id > 100 and id <= 5000").join(sheets(spark, d), "sheet_id").groupBy("setor").agg(F.count("*").alias("n"))


@query("j10_windowed_counts", f"WITH {SHEET}, {EDIT}, n AS (SELECT sheet_id, COUNT(*) AS c FROM edit WHERE source = 'human' GROUP BY 1), s AS (SELECT sheet_id, row_number() OVER (ORDER BY sheet_id DESC) AS p FROM sheet) SELECT ROUND(AVG(COALESCE(c, 0)) FILTER (p <= 20), 6) AS recent, ROUND(AVG(COALESCE(c, 0)) FILTER (p > 20 AND p <= 120), 6) AS before FROM s LEFT JOIN n USING (sheet_id)")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """The newest of all sheets against those before them."""
    from ..operators import ordered

    n = edits(spark, d).where("source = 'human'").groupBy("sheet_id").agg(F.count("*").cast("double").alias("c"))
    return ordered.recent_against_before(sheets(spark, d).join(n, "sheet_id", "left").na.fill(0.0, ["c"]), F.desc("sheet_id"), "c")
