"""Allocation, fill-down, last edits, change points and neighbours over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from .registry import query
from .tables import EDIT, FACT, PLAN, SHEET, edits, facts, plan, read, sheets


@query(
    "w4_waterfall",
    f"""WITH {PLAN}, pool AS (SELECT modelo, CAST(SUM(larg) AS DOUBLE) AS pool FROM plan GROUP BY modelo), r AS (SELECT p.*, pool, closed OR quanttrp IS NULL AS skipped,
 CASE WHEN NOT (closed OR quanttrp IS NULL) THEN quanttrp - GREATEST(produced, 0) END AS need FROM plan p JOIN pool USING (modelo)),
 t AS (SELECT *, COALESCE(SUM(GREATEST(need, 0)) OVER (PARTITION BY modelo ORDER BY plan_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
 row_number() OVER (PARTITION BY modelo ORDER BY plan_ord DESC) = 1 AND NOT bool_or(skipped) OVER (PARTITION BY modelo) AS takes_rest FROM r)
 SELECT plan_ord, CASE WHEN closed THEN 0.0 WHEN quanttrp IS NULL THEN NULL ELSE need - CASE WHEN takes_rest THEN GREATEST(pool - taken, 0) ELSE LEAST(GREATEST(need, 0), GREATEST(pool - taken, 0)) END END AS remaining FROM t""",
)
def w4(spark: SparkSession, d: str) -> DataFrame:
    p = plan(spark, d)
    pool = p.groupBy("modelo").agg(F.sum("larg").alias("pool"))
    return ordered.waterfall(p.join(pool, "modelo"), ["modelo"], "plan_ord").select("plan_ord", "remaining")


@query(
    "w1_fill_down",
    """WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '"' WHEN turn % 5 = 4 THEN '' ELSE role END AS cliente FROM conversations),
 v AS (SELECT *, CASE WHEN cliente <> '"' AND trim(cliente) <> '' THEN cliente END AS valid FROM r)
 SELECT conv_id, turn, CASE WHEN cliente = '"' THEN COALESCE(last_value(valid IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE cliente END AS cliente FROM v""",
)
def w1(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.when(turn % 3 == 1, '"').when(turn % 5 == 4, "").otherwise(F.col("role")).alias("cliente"))
    return ordered.fill_down(rows, ["cliente"], ["conv_id"], "turn")


@query("w2_last_edit", f"WITH {EDIT} SELECT sheet_id, field_path, new_value, source FROM edit QUALIFY row_number() OVER (PARTITION BY sheet_id, field_path ORDER BY id DESC) = 1")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return ordered.last_edit(edits(spark, d), ["sheet_id", "field_path"]).select("sheet_id", "field_path", "new_value", "source")


@query(
    "a51_reverted",
    f"""WITH {EDIT}, l AS (SELECT sheet_id, field_path, arg_max(source, id) AS source, arg_max(new_value, id) AS value, arg_max(new_value, id) FILTER (source = 'human') AS human_value FROM edit GROUP BY ALL)
 SELECT * FROM l WHERE source = 'system' AND human_value IS NOT NULL AND value IS DISTINCT FROM human_value""",
)
def a51(spark: SparkSession, d: str) -> DataFrame:
    return ordered.reverted(edits(spark, d), ["sheet_id", "field_path"])


@query(
    "w5_cusum",
    """WITH h AS (SELECT user_id % 8 AS line, date_trunc('hour', ts) AS hour, AVG(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY ALL),
 p AS (SELECT *, SUM(CAST(rate AS DOUBLE) - 0.25) OVER (PARTITION BY line ORDER BY hour) AS p FROM h), s AS (SELECT *, ROUND(p - LEAST(0, MIN(p) OVER (PARTITION BY line ORDER BY hour)), 9) AS s FROM p)
 SELECT line, epoch_us(hour) // 1000000 AS hour, s, COALESCE(MIN(CASE WHEN s > 1.5 THEN hour END) OVER (PARTITION BY line) = hour, FALSE) AS alarm FROM s""",
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    h = e.groupBy((F.col("user_id") % 8).alias("line"), F.date_trunc("hour", "ts").alias("hour")).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("rate"))
    out = ordered.cusum(h.withColumn("hour", F.unix_timestamp("hour")), ["line"], "hour", F.col("rate"), 0.25, 1.5)
    return out.drop("rate")


@query(
    "w6_sequential_test",
    """WITH c AS (SELECT user_id % 4 AS arm, event_id, CASE WHEN event_type = 'error' THEN ln(0.3 / 0.2) ELSE ln(0.7 / 0.8) END AS step FROM events),
 r AS (SELECT *, SUM(step) OVER (PARTITION BY arm ORDER BY event_id) AS llr FROM c),
 x AS (SELECT *, MIN(CASE WHEN llr >= ln(0.99 / 0.05) OR llr <= ln(0.01 / 0.95) THEN event_id END) OVER (PARTITION BY arm) AS crossed FROM r),
 o AS (SELECT arm, MAX(event_id) AS last, COUNT(*) AS n, ROUND(arg_max(llr, event_id), 6) AS llr FROM x WHERE crossed IS NULL OR event_id <= crossed GROUP BY arm)
 SELECT *, CASE WHEN llr >= ln(0.99 / 0.05) - 1e-6 THEN 'worse' WHEN llr <= ln(0.01 / 0.95) + 1e-6 THEN 'same' ELSE 'open' END AS decision FROM o""",
)
def w6(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "events").select((F.col("user_id") % 4).alias("arm"), "event_id", "event_type")
    step = F.when(F.col("event_type") == "error", F.log(F.lit(0.3 / 0.2))).otherwise(F.log(F.lit(0.7 / 0.8)))
    return ordered.sequential_test(cells, "arm", "event_id", step)


@query(
    "w7_adjacency_lift",
    """WITH r AS (SELECT user_id, event_id, event_type AS v, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
 n AS (SELECT event_type, COUNT(*) AS c FROM events GROUP BY 1), k AS (SELECT SUM(CAST(c AS DOUBLE) * c) / (SUM(c) * CAST(SUM(c) AS DOUBLE)) AS chance FROM n),
 a AS (SELECT COUNT(*) FILTER (v = b) AS same, COUNT(*) AS pairs FROM r WHERE b IS NOT NULL)
 SELECT same, pairs, ROUND((same + 1) / (pairs + 2), 9) AS rate, ROUND(chance, 9) AS chance, ROUND(log2((same + 1) / (pairs + 2) / chance), 6) AS bits FROM a, k""",
)
def w7(spark: SparkSession, d: str) -> DataFrame:
    return ordered.adjacency_lift(read(spark, d, "events").withColumnRenamed("event_type", "v"), ["user_id"], "event_id", "v")


@query(
    "w9_active_before",
    f"""WITH {FACT}, days AS (SELECT DISTINCT of, iso_date AS day FROM fact), e AS (SELECT DISTINCT of, iso_date AS day FROM fact WHERE status = 'validated')
 SELECT of, CAST(day AS VARCHAR) AS day, EXISTS (SELECT 1 FROM e WHERE e.of = days.of AND e.day BETWEEN days.day - 14 AND days.day - 1) AS active FROM days""",
)
def w9(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select("of", F.col("iso_date").alias("day"), "status")
    return ordered.active_before(f, f.where("status = 'validated'"), "of").withColumn("day", F.col("day").cast("string"))


@query(
    "j23_neighbours",
    "SELECT conv_id, turn, role, lag(role) OVER w AS role_before, lead(role) OVER w AS role_after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def j23(spark: SparkSession, d: str) -> DataFrame:
    return ordered.neighbours(read(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@query(
    "w12_recent_before",
    f"WITH {SHEET}, n AS (SELECT total, row_number() OVER (ORDER BY sheet_id DESC) AS n FROM sheet) SELECT ROUND(AVG(total) FILTER (n <= 20), 6) AS recent, ROUND(AVG(total) FILTER (n > 20), 6) AS before FROM n WHERE n <= 120",
)
def w12(spark: SparkSession, d: str) -> DataFrame:
    return ordered.recent_against_before(sheets(spark, d), F.desc("sheet_id"), "total")


@query(
    "w13_collisions",
    f"WITH {FACT} SELECT sheet_id, modelo, of, (SELECT COUNT(DISTINCT of) FROM fact g WHERE g.sheet_id = f.sheet_id AND g.modelo = f.modelo) > 1 AS collided FROM fact f",
)
def w13(spark: SparkSession, d: str) -> DataFrame:
    return ordered.collisions(facts(spark, d).select("sheet_id", "modelo", "of"), ["sheet_id", "modelo"], "of")


@query(
    "w15_previous_workday",
    f"""WITH {SHEET}, days AS (SELECT DISTINCT iso_date AS day FROM sheet), cal AS (SELECT DISTINCT iso_date AS day, month(iso_date) <> 12 AS working FROM sheet WHERE day(iso_date) = 1),
 back AS (SELECT day, day - CAST(i AS INTEGER) AS d FROM days, range(1, 31) t(i)), w AS (SELECT back.day, d, COALESCE(working, isodow(d) <= 5) AS works FROM back LEFT JOIN cal ON cal.day = back.d)
 SELECT CAST(day AS VARCHAR) AS day, CAST(COALESCE(MAX(d) FILTER (works), day - 1) AS VARCHAR) AS previous FROM w GROUP BY w.day""",
)
def w15(spark: SparkSession, d: str) -> DataFrame:
    s = sheets(spark, d).select(F.col("iso_date").alias("day"))
    calendar = s.where(F.dayofmonth("day") == 1).distinct().withColumn("working", F.month("day") != 12)
    out = ordered.previous_workday(s, calendar)
    return out.select(F.col("day").cast("string").alias("day"), F.col("previous").cast("string").alias("previous"))
