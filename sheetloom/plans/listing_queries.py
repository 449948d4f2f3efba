"""Look-ups and listings over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listings, workorders
from .registry import query
from .tables import EDIT, FACT, PLAN, SHEET, edits, read, sheets
from .work_queries import ORDER, REMAINING, orders


@query("s3_document", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id = 42")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return listings.document(read(spark, d, "events"), "event_id", 42, "props", "k int").select("event_id", "event_type", F.col("props.k").alias("k"))


@query("s4_listing", "SELECT event_id, json_extract_string(props, '$.k') AS k, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 100")
def s4(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("status", F.col("event_type"))
    return listings.listed_documents(e, {"k": ["$.none", "$.k"]}, "props", F.desc("ts"), F.col("event_id"), status="click").select("event_id", "k", "user_id")


@query("z2_labels", f"WITH {SHEET} SELECT DISTINCT trim(setor) AS setor FROM sheet WHERE status IN ('extracted', 'validated') AND trim(setor) <> '' ORDER BY 1")
def z2(spark: SparkSession, d: str) -> DataFrame:
    return listings.labels(sheets(spark, d).withColumn("setor", F.concat(F.lit(" "), "setor", F.lit("  "))), "setor")


@query("z3_untriaged", f"WITH {SHEET} SELECT sheet_id, status FROM sheet WHERE total > 100000 AND custkey % 2 = 0 ORDER BY sheet_id DESC LIMIT 500")
def z3(spark: SparkSession, d: str) -> DataFrame:
    s = sheets(spark, d).withColumns({"scored": F.when(F.col("total") > 100_000, "{}"), "triaged": F.when(F.col("custkey") % 2 != 0, F.col("iso_date"))})
    return listings.untriaged(s, "scored", "triaged").select("sheet_id", "status")


@query("z7_overlays", "SELECT event_id AS id FROM events WHERE value > 50 AND event_type = 'view' ORDER BY ts, event_id")
def z7(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("template"), (F.col("value") > 50).alias("active"), F.col("ts").alias("promoted_at"))
    return listings.overlays(e, "view").select("id")


@query("z10_in_use", f"WITH {SHEET} SELECT COUNT(*) AS n, COUNT(*) = 0 AS deletable FROM sheet WHERE setor = '1-URGENT'")
def z10(spark: SparkSession, d: str) -> DataFrame:
    return listings.in_use(sheets(spark, d), "1-URGENT", "setor")


@query("z29_examples", f"WITH {SHEET}, m AS (SELECT setor AS template, MIN(sheet_id) AS a, MAX(sheet_id) AS b FROM sheet GROUP BY 1), l AS (SELECT template, 0 AS place, b AS sheet_id FROM m UNION ALL SELECT template, 2, a FROM m) SELECT template, place, sheet_id, status FROM l JOIN sheet USING (sheet_id)")
def z29(spark: SparkSession, d: str) -> DataFrame:
    s = sheets(spark, d)
    lists = s.groupBy(F.col("setor").alias("template")).agg(F.array(F.max("sheet_id"), F.lit(-1).cast("bigint"), F.min("sheet_id"), F.min("sheet_id")).alias("ids"))
    return listings.examples(lists, s).select("template", "place", "sheet_id", "status")


@query("z60_uploads", "SELECT event_id AS id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50")
def z60(spark: SparkSession, d: str) -> DataFrame:
    return listings.uploads(read(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))).select("id")


@query("f3_recent_edits", f"WITH {EDIT}, n AS (SELECT MAX(edited_at) AS m FROM edit) SELECT id, field_path FROM edit, n WHERE source = 'human' AND edited_at >= m - INTERVAL 2 DAY ORDER BY edited_at DESC, id DESC LIMIT 100")
def f3(spark: SparkSession, d: str) -> DataFrame:
    e = edits(spark, d)
    now = e.agg(F.max("edited_at").cast("string")).collect()[0][0]  # one value: the day that counts as today
    return listings.recent_edits(e, now, 2).select("id", "field_path")


@query("f3_references", "SELECT COUNT(*) AS n_plan_rows, COUNT(DISTINCT p_partkey) AS n_of, COUNT(DISTINCT p_size) AS n_ov, COUNT(DISTINCT p_type) AS n_cliente, COUNT(DISTINCT p_name) AS n_modelo, (SELECT COUNT(DISTINCT s_nationkey) FROM supplier) AS n_lote FROM part")
def f3_references(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("of"), F.col("p_size").alias("ov"), F.col("p_type").alias("cliente"), F.col("p_name").alias("modelo"))
    return listings.references(p, read(spark, d, "supplier").select(F.col("s_nationkey").alias("lote")))


@query("f5_proposed", "SELECT event_id AS id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown kind' WHEN value < 20 THEN 'no payload' WHEN user_id % 2 = 0 THEN 'no reason' END AS refused, CASE WHEN event_type IN ('click', 'view') AND value >= 20 AND user_id % 2 <> 0 THEN 'quarantine' END AS status FROM events")
def f5(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("value") < 20, "text").otherwise(F.col("props")).alias("payload"), F.when(F.col("user_id") % 2 == 0, " ").otherwise("seen").alias("reason"))
    return listings.proposed(rows, ("click", "view")).select("id", "refused", "status")


@query("s9_lexicon", "SELECT upper(split_part(p_name, ' ', 1)) AS k, MIN(upper(p_brand)) AS v FROM part WHERE p_size % 3 <> 0 GROUP BY 1")
def s9(spark: SparkSession, d: str) -> DataFrame:
    word = F.get(F.split("p_name", " "), F.lit(0))
    lexicon = read(spark, d, "part").select(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("_"), word)).otherwise(F.concat(F.lit(" "), word)).alias("k"), F.lower("p_brand").alias("v"))
    return listings.normalised(lexicon, "k", "v")


@query("s17_current_results", f"WITH {SHEET} SELECT sheet_id, status FROM sheet WHERE custkey % 5 <> 0 AND custkey % 4 <> 1")
def s17(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("custkey")
    s = sheets(spark, d).select("sheet_id", "status", "custkey", F.concat(F.col("sheet_id").cast("string"), F.lit(".json")).alias("file"), F.when(c % 4 == 1, "v29").otherwise("v30").alias("engine_version"))
    return listings.current_results(s, s.where(c % 5 != 0), "v30").select("sheet_id", "status")


@query("z19_order_detail", f"WITH {FACT}, {PLAN}, {REMAINING}, {ORDER} SELECT ov, planned, produced, remaining, n_open FROM o WHERE ov = 10")
def z19(spark: SparkSession, d: str) -> DataFrame:
    return workorders.order_detail(orders(spark, d), "ov", 10).select("ov", "planned", "produced", "remaining", "n_open")
