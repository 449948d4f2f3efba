"""Indicators over the whole fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kpis
from .registry import query
from .tables import AS_OF, EDIT, FACT, SHEET, edits, facts, read, sheets

DAY = "1998-03-02"
HOURS = "SELECT {k}, SUM(hours) AS hours FROM (SELECT DISTINCT {k}, sheet_id, hours FROM {t}) GROUP BY {k}"


def totals(keys: str, source: str = "fact", where: str = "TRUE", more: str = "") -> str:
    on = " AND ".join(f"g.{k.strip()} = h.{k.strip()}" for k in keys.split(","))
    out = ", ".join(f"CAST(g.{k.strip()} AS VARCHAR) AS {k.strip()}" for k in keys.split(","))
    return f"""WITH {FACT}, src AS (SELECT *{more} FROM {source} WHERE {where}), g AS (SELECT {keys}, CAST(SUM(qtd) AS BIGINT) AS qty, COUNT(DISTINCT sheet_id) AS n_sheets, COUNT(*) AS n_rows FROM src GROUP BY {keys}),
 h AS ({HOURS.format(k=keys, t="src")}) SELECT {out}, qty, n_sheets, n_rows, hours FROM g JOIN h ON {on}"""


def text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@query(
    "a1_day_summary",
    f"""WITH {FACT}, d AS (SELECT * FROM fact WHERE iso_date = DATE '{DAY}') SELECT CAST(COALESCE(SUM(qtd), 0) AS BIGINT) AS qty, COUNT(*) AS n_rows, COUNT(DISTINCT sheet_id) AS n_sheets,
 COUNT(DISTINCT CASE WHEN status = 'validated' THEN sheet_id END) AS n_validated, COALESCE((SELECT SUM(hours) FROM (SELECT DISTINCT sheet_id, hours FROM d)), 0) AS hours,
 COUNT(DISTINCT of) AS n_of, COUNT(DISTINCT operador) AS n_operador, COUNT(DISTINCT CASE WHEN TRIM(cliente) <> '' THEN cliente END) AS n_cliente FROM d""",
)
def a1(spark: SparkSession, d: str) -> DataFrame:
    return kpis.day_summary(facts(spark, d, "sheet_id", "qtd", "of", "operador", "cliente", "status", "iso_date", "hours"), DAY)


@query("a2_by_operador", totals("operador"))
def a2(spark: SparkSession, d: str) -> DataFrame:
    return kpis.totals_by(facts(spark, d, "sheet_id", "qtd", "operador", "hours"), "operador")


@query("a2_top_of", f"WITH {FACT} SELECT of, CAST(SUM(qtd) AS BIGINT) AS qty FROM fact GROUP BY of ORDER BY qty DESC, of LIMIT 10")
def a2_of(spark: SparkSession, d: str) -> DataFrame:
    return kpis.top(facts(spark, d, "of", "qtd").groupBy("of").agg(F.sum("qtd").alias("qty")), "qty", 10, "of")


@query("a3_daily_trend", totals("iso_date", where=f"iso_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}'"))
def a3(spark: SparkSession, d: str) -> DataFrame:
    return text(kpis.totals_by(kpis.last_days(facts(spark, d, "sheet_id", "qtd", "iso_date", "hours"), AS_OF, 30), "iso_date"), "iso_date")


@query("a4_day_operador", f"WITH {FACT} SELECT CAST(iso_date AS VARCHAR) AS iso_date, operador, CAST(SUM(qtd) AS BIGINT) AS qty FROM fact GROUP BY fact.iso_date, operador")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return text(facts(spark, d, "iso_date", "operador", "qtd").groupBy("iso_date", "operador").agg(F.sum("qtd").alias("qty")), "iso_date")


@query("a5_weekly_trend", totals("week", more=", strftime(iso_date, '%Y-W%W') AS week"))
def a5(spark: SparkSession, d: str) -> DataFrame:
    return kpis.totals_by(facts(spark, d, "sheet_id", "qtd", "iso_date", "hours").withColumn("week", kpis.week_key(F.col("iso_date"))), "week")


@query("a6_monthly_trend", totals("month", where="iso_date > DATE '1998-05-31' - INTERVAL 400 DAY", more=", strftime(iso_date, '%Y-%m') AS month"))
def a6(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d, "sheet_id", "qtd", "iso_date", "hours").where("iso_date > date_sub(date '1998-05-31', 400)")
    return kpis.totals_by(f.withColumn("month", F.date_format("iso_date", "yyyy-MM")), "month")


@query("d6_months_before", f"WITH {SHEET} SELECT status, COUNT(*) AS n FROM sheet WHERE iso_date >= make_date(1998, 2, 1) + 30 GROUP BY status")
def d6(spark: SparkSession, d: str) -> DataFrame:
    """31 March less a month rolls over to 3 March."""
    return sheets(spark, d).where(F.col("iso_date") >= kpis.months_before("1998-03-31", 1)).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "a7_workers",
    f"""WITH {FACT}, ago AS (SELECT *, date_diff('day', iso_date, DATE '{AS_OF}') AS ago FROM fact), r AS (SELECT operador, {", ".join(f"COALESCE(CAST(SUM(CASE WHEN ago = {6 - i} THEN qtd END) AS BIGINT), 0) AS d{i}" for i in range(7))} FROM ago GROUP BY operador)
 SELECT operador, COUNT(DISTINCT sheet_id) AS n_sheets, CAST(SUM(qtd) AS BIGINT) AS qty, MIN(qtd) AS least, MAX(qtd) AS most, ROUND(AVG(qtd), 6) AS mean, concat_ws(',', {", ".join(f"ANY_VALUE(d{i})" for i in range(7))}) AS recent FROM fact JOIN r USING (operador) GROUP BY operador""",
)
def a7(spark: SparkSession, d: str) -> DataFrame:
    return kpis.worker_summary(facts(spark, d, "sheet_id", "qtd", "operador", "iso_date"), AS_OF)


@query("a8_worker_models", f"WITH {FACT} SELECT modelo, CAST(SUM(qtd) AS BIGINT) AS qty, COUNT(*) AS n_rows FROM fact WHERE operador = 'Supplier#000000001' GROUP BY modelo")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return kpis.worker_detail(facts(spark, d), "Supplier#000000001")["models"]


@query("a8_worker_sheets", f"WITH {FACT} SELECT DISTINCT sheet_id, CAST(iso_date AS VARCHAR) AS iso_date, status, hours FROM fact WHERE operador = 'Supplier#000000001'")
def a8_sheets(spark: SparkSession, d: str) -> DataFrame:
    return text(kpis.worker_detail(facts(spark, d), "Supplier#000000001")["sheets"], "iso_date")


@query(
    "a9_jobs",
    f"""WITH {FACT} SELECT of, CAST(SUM(qtd) AS BIGINT) AS qty, COUNT(DISTINCT sheet_id) AS n_sheets, COUNT(DISTINCT operador) AS n_operador, MAX(cliente) AS cliente,
 string_agg(DISTINCT segmento, ',' ORDER BY segmento) AS segmentos, CAST(MAX(iso_date) AS VARCHAR) AS last_day FROM fact GROUP BY of""",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    return kpis.job_summary(facts(spark, d, "of", "sheet_id", "qtd", "operador", "cliente", "segmento", "iso_date"))


@query("a10_job_detail", f"WITH {FACT} SELECT sheet_id, operador, CAST(SUM(qtd) AS BIGINT) AS qty FROM fact WHERE of = 7 GROUP BY sheet_id, operador")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).where("of = 7").groupBy("sheet_id", "operador").agg(F.sum("qtd").alias("qty"))


@query(
    "a11_client_matrix",
    f"""WITH {FACT}, h AS ({HOURS.format(k="operador, segmento", t="fact")}), g AS (SELECT operador, segmento, CAST(SUM(qtd) AS BIGINT) AS qty, COUNT(DISTINCT sheet_id) AS n_sheets FROM fact GROUP BY ALL)
 SELECT operador, segmento, qty, n_sheets, hours, CASE WHEN hours > 0 THEN ROUND(qty / hours, 6) ELSE 0 END AS rate FROM g JOIN h USING (operador, segmento) WHERE TRIM(segmento) NOT IN ('', '/', '-')""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    return kpis.client_matrix(facts(spark, d, "sheet_id", "qtd", "operador", "segmento", "hours"))


@query(
    "a12_model_matrix",
    f"""WITH {FACT}, best AS (SELECT modelo FROM fact GROUP BY modelo ORDER BY SUM(qtd) DESC, modelo LIMIT 5)
 SELECT operador, modelo, CAST(SUM(qtd) AS BIGINT) AS qty FROM fact WHERE modelo IN (SELECT modelo FROM best) GROUP BY operador, modelo""",
)
def a12(spark: SparkSession, d: str) -> DataFrame:
    return kpis.model_matrix(facts(spark, d, "operador", "modelo", "qtd"))


@query("a13_top_clientes", f"WITH {FACT} SELECT cliente, CAST(SUM(qtd) AS BIGINT) AS qty FROM fact GROUP BY cliente ORDER BY qty DESC, cliente LIMIT 10")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return kpis.top(facts(spark, d, "cliente", "qtd").groupBy("cliente").agg(F.sum("qtd").alias("qty")), "qty", 10, "cliente")


@query("a15_lead_time", f"WITH {FACT} SELECT of, date_diff('day', MIN(iso_date), MAX(iso_date)) AS days, COUNT(DISTINCT sheet_id) AS n_sheets FROM fact GROUP BY of HAVING MAX(iso_date) > MIN(iso_date)")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return kpis.lead_time(facts(spark, d, "of", "sheet_id", "iso_date"))


@query("a16_alert_low", f"WITH {SHEET} SELECT sheet_id, total FROM (SELECT * FROM sheet ORDER BY sheet_id DESC LIMIT 100) WHERE total < 100000")
def a16_low(spark: SparkSession, d: str) -> DataFrame:
    return kpis.alerts(sheets(spark, d), edits(spark, d), floor=100_000)["low"].select("sheet_id", "total")


@query("a16_alert_edited", f"WITH {SHEET}, {EDIT} SELECT sheet_id, COUNT(id) AS n_edits FROM sheet JOIN edit USING (sheet_id) GROUP BY sheet_id HAVING COUNT(id) >= 5")
def a16_edited(spark: SparkSession, d: str) -> DataFrame:
    return kpis.alerts(sheets(spark, d), edits(spark, d))["edited"]


@query("a16_alert_fields", f"WITH {EDIT} SELECT substr(field_path, instr(field_path, '.') + 1) AS field, COUNT(*) AS n FROM edit WHERE source = 'human' GROUP BY 1 ORDER BY n DESC, field LIMIT 10")
def a16_fields(spark: SparkSession, d: str) -> DataFrame:
    return kpis.alerts(sheets(spark, d), edits(spark, d))["fields"]


@query("a16_alert_stuck", f"WITH {SHEET} SELECT sheet_id, date_diff('day', iso_date, DATE '{AS_OF}') AS age FROM sheet WHERE status = 'pending' AND date_diff('day', iso_date, DATE '{AS_OF}') > 1")
def a16_stuck(spark: SparkSession, d: str) -> DataFrame:
    return kpis.stuck(sheets(spark, d), AS_OF)


DIMENSION = "dim AS (SELECT CAST(n_nationkey % 5 + 1 AS VARCHAR) AS code, n_name AS machine, r_name AS sector FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey < 4)"


def dimension(spark: SparkSession, d: str) -> DataFrame:
    """Labels of sectors: those whose number has a machine; the others have no sector."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).where("n_nationkey < 4")
    codes = n.select((F.col("n_nationkey") % 5 + 1).cast("string").alias("code"), F.col("n_name").alias("machine"), F.col("r_name").alias("sector"))
    labels = sheets(spark, d).select(F.col("setor").alias("label")).distinct()
    return labels.join(codes, F.substring("label", 1, 1) == F.col("code")).select("label", "sector", "machine")


@query(
    "a17_sector_overview",
    f"""WITH {FACT}, {DIMENSION}, r AS (SELECT fact.*, sector, machine FROM fact JOIN dim ON code = substr(setor, 1, 1))
, h AS (SELECT DISTINCT sector, machine, sheet_id, hours FROM r)
 SELECT sector, machine, CAST(SUM(qtd) AS BIGINT) AS qty, COUNT(DISTINCT sheet_id) AS n_sheets, (SELECT SUM(hours) FROM h WHERE h.sector = r.sector AND h.machine = r.machine) AS hours, 0 AS level FROM r GROUP BY sector, machine
 UNION ALL SELECT sector, NULL, CAST(SUM(qtd) AS BIGINT), COUNT(DISTINCT sheet_id), (SELECT SUM(hours) FROM (SELECT DISTINCT sector, sheet_id, hours FROM h) x WHERE x.sector = r.sector), 1 FROM r GROUP BY sector
 UNION ALL SELECT NULL, NULL, CAST(SUM(qtd) AS BIGINT), COUNT(DISTINCT sheet_id), (SELECT SUM(hours) FROM (SELECT DISTINCT sheet_id, hours FROM h)), 3 FROM r""",
)
def a17(spark: SparkSession, d: str) -> DataFrame:
    return kpis.sector_overview(facts(spark, d, "sheet_id", "qtd", "setor", "hours"), dimension(spark, d))


for _kind, _range in (("day", ("DATE '1998-06-30'", "DATE '1998-06-30'")), ("week", ("DATE '1998-06-29'", "DATE '1998-07-05'")), ("month", ("DATE '1998-06-01'", "DATE '1998-06-30'")), ("year", ("DATE '1998-01-01'", "DATE '1998-12-31'"))):

    @query(f"d7_period_{_kind}", f"WITH {SHEET} SELECT status, COUNT(*) AS n FROM sheet WHERE iso_date BETWEEN {_range[0]} AND {_range[1]} GROUP BY status")
    def d7(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        first, last = kpis.period(AS_OF, kind)
        return sheets(spark, d).where(F.col("iso_date").between(first, last)).groupBy("status").agg(F.count("*").alias("n"))


@query("z1_labels_most_used", f"WITH {FACT} SELECT * FROM (SELECT modelo, upper(regexp_replace(modelo, '[^A-Za-z]', '', 'g')) AS key, COUNT(*) AS count FROM fact GROUP BY modelo) QUALIFY row_number() OVER (PARTITION BY key ORDER BY count DESC, modelo) = 1")
def z1(spark: SparkSession, d: str) -> DataFrame:
    return kpis.keep_most_used(facts(spark, d).select("modelo"), "modelo", F.upper(F.regexp_replace("modelo", "[^A-Za-z]", "")))
