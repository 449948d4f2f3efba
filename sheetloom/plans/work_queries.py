"""Work orders, weights, stops, areas, formulas and documents over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import documents, formula, joins, sqlguard, workorders
from .registry import query
from .tables import AS_OF, EDIT, FACT, PLAN, SHEET, edits, facts, plan, read, sheets

CUTOFF = "1998-01-01"
USED = f"used AS (SELECT of, CAST(SUM(qtd) AS BIGINT) AS used, MAX(iso_date) AS last_used FROM fact WHERE status = 'validated' AND iso_date >= DATE '{CUTOFF}' GROUP BY of)"
POOL = f"usedm AS (SELECT modelo, CAST(SUM(qtd) AS DOUBLE) AS pool FROM fact WHERE status = 'validated' AND iso_date >= DATE '{CUTOFF}' GROUP BY modelo)"
REMAINING = f"""{POOL}, r AS (SELECT p.*, COALESCE(pool, 0) AS pool, closed OR quanttrp IS NULL AS skipped, CASE WHEN NOT (closed OR quanttrp IS NULL) THEN quanttrp - GREATEST(produced, 0) END AS need FROM plan p LEFT JOIN usedm USING (modelo)),
 t AS (SELECT *, COALESCE(SUM(GREATEST(need, 0)) OVER (PARTITION BY modelo ORDER BY plan_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
 row_number() OVER (PARTITION BY modelo ORDER BY plan_ord DESC) = 1 AND NOT bool_or(skipped) OVER (PARTITION BY modelo) AS takes_rest FROM r),
 line AS (SELECT *, CASE WHEN closed THEN 0.0 WHEN quanttrp IS NULL THEN NULL ELSE need - CASE WHEN takes_rest THEN GREATEST(pool - taken, 0) ELSE LEAST(GREATEST(need, 0), GREATEST(pool - taken, 0)) END END AS remaining FROM t)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    used = workorders.consumption(facts(spark, d), CUTOFF, ["modelo"])
    return workorders.remaining(plan(spark, d), used, ["modelo"])


@query("a18_consumption", f"WITH {FACT}, {USED} SELECT of, used, CAST(last_used AS VARCHAR) AS last_used FROM used")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return workorders.consumption(facts(spark, d), CUTOFF, ["of"]).withColumn("last_used", F.col("last_used").cast("string"))


ORDER = """o AS (SELECT of % 50 AS ov, COALESCE(SUM(quanttrp), 0) AS planned, SUM(produced) AS produced, SUM(GREATEST(remaining, 0)) FILTER (remaining IS NOT NULL) AS remaining, COUNT(*) FILTER (closed) AS n_closed,
 COUNT(*) FILTER (NOT closed) AS n_open, array_to_string(list_sort(list_distinct(list(modelo)))[1:5], ',') AS models FROM line GROUP BY 1)"""


def orders(spark: SparkSession, d: str) -> DataFrame:
    return workorders.order_status(lines(spark, d).withColumn("ov", F.col("of") % 50), "ov")


@query("a19_order_status", f"WITH {FACT}, {PLAN}, {REMAINING}, {ORDER} SELECT *, CASE WHEN planned > 0 THEN ROUND(100 * LEAST(produced, planned) / planned, 6) END AS pct FROM o")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d)


@query("a20_client_status", f"WITH {FACT}, {PLAN}, {REMAINING}, {ORDER} SELECT ov % 7 AS cliente, COUNT(*) AS n_orders, SUM(planned) AS planned, SUM(produced) AS produced, SUM(remaining) AS remaining, CAST(SUM(n_open) AS BIGINT) AS n_open FROM o GROUP BY 1")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return workorders.client_status(orders(spark, d).withColumn("cliente", F.col("ov") % 7), "cliente")


@query("a21_remaining_top", f"WITH {FACT}, {PLAN}, {REMAINING}, {ORDER} SELECT ov, remaining FROM o ORDER BY remaining DESC NULLS LAST, ov LIMIT 20")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return workorders.by_remaining(orders(spark, d), "ov").limit(20).select("ov", "remaining")


@query("w9_recent_orders", f"WITH {FACT} SELECT DISTINCT of FROM fact WHERE iso_date >= DATE '{AS_OF}' - 14 AND iso_date < DATE '{AS_OF}'")
def w9_recent(spark: SparkSession, d: str) -> DataFrame:
    return workorders.recent_orders(facts(spark, d), AS_OF)


STOPS = """stop AS (SELECT user_id AS operador, event_type AS motivo, CASE event_type WHEN 'click' THEN 'sim' WHEN 'view' THEN 'nao' ELSE '?' END AS resolvido, CAST(ts AS DATE) AS iso_date,
 lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') AS inicio, lpad(CAST((hour(ts) + event_id % 16) % 24 AS VARCHAR), 2, '0') || 'h' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') AS fim FROM events),
 timed AS (SELECT *, ((CAST(substr(fim, 1, 2) AS INTEGER) - CAST(substr(inicio, 1, 2) AS INTEGER)) * 60 + 1440) % 1440 AS d FROM stop), m AS (SELECT *, CASE WHEN d <= 720 THEN d END AS minutes FROM timed)"""


def stops(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    clock = lambda h, sep: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(sep), F.lpad(F.minute("ts").cast("string"), 2, "0"))
    s = e.select(
        F.col("user_id").alias("operador"),
        F.col("event_type").alias("motivo"),
        F.when(F.col("event_type") == "click", "sim").when(F.col("event_type") == "view", "nao").otherwise("?").alias("resolvido"),
        F.to_date("ts").alias("iso_date"),
        clock(F.hour("ts"), ":").alias("inicio"),
        clock((F.hour("ts") + F.col("event_id") % 16) % 24, "h").alias("fim"),
    )
    return s.withColumn("minutes", dates.minutes_between(dates.clock_strict(F.col("inicio")), dates.clock_strict(F.col("fim"))))


@query("a22_downtime_operador", f"WITH {STOPS} SELECT operador, CAST(COALESCE(SUM(minutes), 0) AS BIGINT) AS minutes, COUNT(*) AS n FROM m GROUP BY operador")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return workorders.downtime(stops(spark, d))["operador"]


@query("a22_downtime_resolvido", f"WITH {STOPS} SELECT CASE resolvido WHEN 'sim' THEN TRUE WHEN 'nao' THEN FALSE END AS resolvido, CAST(COALESCE(SUM(minutes), 0) AS BIGINT) AS minutes, COUNT(*) AS n FROM m GROUP BY 1")
def a22_resolved(spark: SparkSession, d: str) -> DataFrame:
    return workorders.downtime(stops(spark, d).withColumn("resolvido", dates.yes_no(F.col("resolvido"))))["resolvido"]


@query("a22_downtime_motivo", f"WITH {STOPS} SELECT motivo, COUNT(*) AS n FROM m GROUP BY motivo")
def a22_reason(spark: SparkSession, d: str) -> DataFrame:
    return workorders.downtime(stops(spark, d))["motivo"]


@query("a23_area", f"WITH {SHEET}, m AS (SELECT l_orderkey AS sheet_id, SUM(l_quantity / 4) AS m2, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity / 4 <= 10 GROUP BY 1) SELECT setor, COUNT(*) AS n_sheets, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n_rows, ROUND(COALESCE(SUM(m2), 0), 6) AS m2 FROM sheet LEFT JOIN m USING (sheet_id) GROUP BY setor")
def a23(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace((F.col("l_quantity") / 4).cast("string"), F.lit("."), F.lit(","))
    rows = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("sheet_id"), dates.square_metres(F.concat(text, F.lit(" m2"))).alias("m2")).where("m2 <= 10")
    return workorders.area(sheets(spark, d), rows, "setor")


@query(
    "m5_row_weights",
    """WITH r AS (SELECT l_partkey AS of, l_quantity AS qtd, l_linenumber % 2 = 0 AS direct, CASE WHEN l_linenumber % 4 = 0 OR p_size % 2 <> 0 THEN l_quantity * 100 ELSE p_size * 100.0::DOUBLE END AS comp, 100.0::DOUBLE + l_linenumber * 10 AS lb, 90.0::DOUBLE + l_linenumber * 10 AS lt, p_size / 4 AS esp, CASE WHEN p_size % 3 = 0 THEN p_size * 20.0::DOUBLE ELSE 1000.0::DOUBLE END AS larg,
 CASE WHEN p_size % 5 = 0 THEN p_size / 10 END AS unit, CASE WHEN p_size % 7 = 0 THEN 2 END AS pieces, p_size % 2 = 0 OR p_size % 3 = 0 AS found FROM lineitem JOIN part ON p_partkey = l_partkey),
 g AS (SELECT *, CASE WHEN qtd > 0 AND esp >= 0.5 AND esp <= 30 AND comp > 0 AND comp <= 20000 THEN qtd * ((lb + lt) / 2 * comp * esp * 7.85e-6::DOUBLE) ELSE 0 END AS geo, COALESCE(pieces, CASE WHEN larg > lb * 3 + lt * 3 THEN 6 WHEN larg > lb * 3 + lt * 2 THEN 5 WHEN larg > lb * 2 + lt * 2 THEN 4 WHEN larg > lb * 2 + lt THEN 3 WHEN larg > lb + lt THEN 2 WHEN larg > lb THEN 1 END) AS n FROM r),
 h AS (SELECT *, CASE WHEN direct AND geo > 0 THEN geo WHEN unit > 0 THEN qtd * unit WHEN geo > 0 THEN geo END AS produced, CASE WHEN direct AND comp > 0 AND comp <= 20000 AND larg BETWEEN 200 AND 3000 AND esp BETWEEN 0.5 AND 30 AND n > 0 THEN CAST(ceil(qtd / n) AS INTEGER) END AS slices FROM g),
 w AS (SELECT *, slices * larg * comp * esp * 7.85e-6::DOUBLE AS consumed FROM h)
 SELECT of, CAST(SUM(slices) AS BIGINT) AS n_slices, CAST(SUM(CAST(ROUND(produced * 1000) AS BIGINT)) AS BIGINT) AS produced_g, CAST(SUM(CAST(ROUND(consumed * 1000) AS BIGINT)) AS BIGINT) AS consumed_g, CAST(SUM(CAST(ROUND(GREATEST(0, consumed - produced) * 1000) AS BIGINT)) FILTER (consumed IS NOT NULL AND produced IS NOT NULL) AS BIGINT) AS wasted_g,
 COUNT(*) FILTER (produced IS NOT NULL AND NOT (direct AND geo > 0) AND unit > 0) AS n_by_plan, COUNT(*) FILTER (slices IS NOT NULL AND found) AS n_found FROM w GROUP BY of""",
)
def m5(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    none, size, line = F.lit(None).cast("double"), F.col("p_size"), F.col("l_linenumber")
    rows = li.select(
        F.col("l_partkey").alias("of"),
        F.col("l_quantity").alias("qtd"),
        (F.col("l_quantity") * 100).alias("comp"),
        (100.0 + line * 10).alias("lbase"),
        (90.0 + line * 10).alias("ltopo"),
        F.lit(2.5).alias("esp"),
        F.lit(1000.0).alias("larg"),
        F.when(size % 2 == 0, size * 100.0).alias("plan_comp"),
        none.alias("plan_lbase"),
        none.alias("plan_ltopo"),
        (size / 4).alias("plan_esp"),
        F.when(size % 5 == 0, size / 10).alias("plan_unit_kg"),
        F.when(size % 7 == 0, 2.0).alias("plan_pieces"),
        (size % 2 == 0).alias("in_plan"),
        none.alias("lot_esp"),
        F.when(size % 3 == 0, size * 20.0).alias("lot_larg"),
        (size % 3 == 0).alias("in_lot"),
        (line % 2 == 0).alias("direct"),
        F.when(line % 4 == 0, F.array(F.lit("comp_mm"))).otherwise(F.array().cast("array<string>")).alias("human"),
    )
    grams = lambda c: F.sum(F.round(F.col(c) * 1000).cast("bigint")).alias(c.replace("_kg", "_g"))
    return workorders.row_weights(rows).groupBy("of").agg(F.sum("n_slices").alias("n_slices"), grams("produced_kg"), grams("consumed_kg"), grams("wasted_kg"), F.count_if(F.col("produced_source") == "plan").alias("n_by_plan"), F.count_if(F.col("consumption_source") == "plan_lot").alias("n_found"))


@query(
    "m16_tolerances",
    """SELECT p_partkey, concat_ws(',', CASE WHEN abs(p_size - 25) > 10 THEN 'larg' END, CASE WHEN abs(p_retailprice - 1000) > 50 THEN 'comp' END) AS notes, CASE WHEN abs(p_size - 25) > 10 OR abs(p_retailprice - 1000) > 50 THEN 'differs' ELSE 'fits' END AS status FROM part""",
)
def m16(spark: SparkSession, d: str) -> DataFrame:
    p = plan(spark, d).withColumns({"ref_larg": F.lit(25.0), "ref_comp": F.lit(1000.0)})
    return workorders.within_tolerance(p, {"larg": ("ref_larg", 10), "comp": ("ref_comp", 50)}).select(F.col("of").alias("p_partkey"), "notes", "status")


@query(
    "m1_formula",
    f"WITH {FACT}, g AS (SELECT operador, CAST(SUM(qtd) AS DOUBLE) AS qtd, (SELECT SUM(hours) FROM (SELECT DISTINCT sheet_id, hours FROM fact f WHERE f.operador = fact.operador)) AS horas FROM fact GROUP BY operador) SELECT operador, ROUND(qtd / horas, 6) AS rate, CASE WHEN horas - 4 <> 0 THEN ROUND(GREATEST(qtd, horas) / (horas - 4), 6) END AS peak, CAST(NULL AS DOUBLE) AS none FROM g",
)
def m1(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import kpis

    g = kpis.totals_by(facts(spark, d), "operador")
    names = {"qtd": F.col("qty"), "horas": F.col("hours"), "zero": F.lit(0)}
    show = lambda f: F.round(formula.compiled(f, names), 6)
    return g.select("operador", show("qtd / horas").alias("rate"), show("max(qtd, horas) / (horas - 4)").alias("peak"), show("min(qtd / zero, horas)").alias("none"))


@query("f2_guarded_sql", f"WITH {SHEET} SELECT status, COUNT(*) AS n FROM sheet GROUP BY status")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return sqlguard.asked(spark, "SELECT status, COUNT(*) AS n FROM sheets GROUP BY status ORDER BY status LIMIT 10", {"sheets": sheets(spark, d)})


DOC = """{{"header": {{"operador": "{0}", "data": "{1}"}}, "rows": {2}, "footer": {{"horas_trabalhadas": "{3}"}}}}"""


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Sheets as JSON documents, their rows folded in order."""
    li = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    empty = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_partkey").cast("string"))
    row = F.struct(empty.alias("of"), F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("qtd"))
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", row.alias("row"))
    g = li.groupBy("o_orderkey", "o_orderdate").agg(F.array_sort(F.collect_list(key)).alias("k"))
    header = F.struct(F.concat(F.lit("W"), (F.col("o_orderkey") % 9).cast("string")).alias("operador"), F.date_format("o_orderdate", "d-M-yyyy").alias("data"))
    footer = F.struct(F.concat((F.col("o_orderkey") % 12).cast("string"), F.lit(":30")).alias("horas_trabalhadas"))
    doc = F.to_json(F.struct(header.alias("header"), F.transform("k", lambda x: x["row"]).alias("rows"), footer.alias("footer")))
    return g.select(F.col("o_orderkey").alias("sheet_id"), doc.alias("doc"))


@query(
    "k2_row_facts",
    """SELECT l_orderkey AS sheet_id, COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS qtd, MIN('W' || (l_orderkey % 9)) AS operador, MIN(strftime(o_orderdate, '%Y-%m-%d')) AS iso_date, MIN(CAST(l_orderkey % 12 + 0.5 AS DOUBLE)) AS hours FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber % 3 <> 0 GROUP BY 1""",
)
def k2(spark: SparkSession, d: str) -> DataFrame:
    """Documents to facts and back to sums: blank rows are dropped, numbers, dates and hours read from text."""
    f = documents.row_facts(documents.parsed(nested(spark, d)))
    return f.groupBy("sheet_id").agg(F.count("*").alias("n"), F.sum("qtd").alias("qtd"), F.min("operador").alias("operador"), F.min("sheet_iso_date").alias("iso_date"), F.min("sheet_hours").alias("hours"))


@query("p12_cells", "SELECT 'rows' AS section, 'of' AS field, COUNT(*) AS n, COUNT(*) FILTER (l_linenumber % 3 <> 0) AS filled FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 'header', 'operador', COUNT(DISTINCT l_orderkey), COUNT(DISTINCT l_orderkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def p12(spark: SparkSession, d: str) -> DataFrame:
    c = documents.cells(documents.parsed(nested(spark, d))).where("field in ('of', 'operador')")
    return c.groupBy("section", "field").agg(F.count("*").alias("n"), F.count_if(F.trim("value") != "").alias("filled"))


@query("r4_replay", f"WITH {EDIT}, base AS (SELECT DISTINCT sheet_id, field_path AS path, '-' AS value FROM edit), n AS (SELECT sheet_id, field_path AS path, arg_max(new_value, id) AS v FROM edit WHERE source IN ('human', 'wizard') GROUP BY ALL) SELECT sheet_id, path, COALESCE(v, value) AS value FROM base LEFT JOIN n USING (sheet_id, path)")
def r4(spark: SparkSession, d: str) -> DataFrame:
    """The edits of all sheets replayed."""
    e = edits(spark, d).withColumnRenamed("field_path", "path")
    return documents.replayed(e.select("sheet_id", "path", F.lit("-").alias("value")).distinct(), e)


@query("l18_written_back", f"WITH {EDIT}, p AS (SELECT sheet_id, field_path, arg_max(source, id) AS s FROM edit GROUP BY ALL), a AS (SELECT DISTINCT sheet_id, field_path FROM edit) SELECT a.* FROM a JOIN p USING (sheet_id, field_path) WHERE s NOT IN ('human', 'wizard')")
def l18(spark: SparkSession, d: str) -> DataFrame:
    e = edits(spark, d)
    return documents.written_back(e.select("sheet_id", "field_path").distinct(), e)


@query("k3_upsert", "WITH o AS (SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'open' ELSE 'rejected' END AS status, p_size AS evidence FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey AS key, 'fresh' AS status, p_size + 100 AS evidence FROM part WHERE p_partkey % 5 = 0) SELECT key, CASE WHEN o.status IN ('accepted', 'rejected') THEN o.status ELSE COALESCE(n.status, o.status) END AS status, COALESCE(n.evidence, o.evidence) AS evidence FROM o FULL JOIN n USING (key)")
def k3(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumnRenamed("p_partkey", "key")
    status = F.when(F.col("key") % 3 == 0, "accepted").when(F.col("key") % 3 == 1, "open").otherwise("rejected")
    return documents.upserted(p.where("key % 2 = 0").select("key", status.alias("status"), F.col("p_size").alias("evidence")), p.where("key % 5 = 0").select("key", F.lit("fresh").alias("status"), (F.col("p_size") + 100).alias("evidence")), "key")


@query("k5_cascade_delete", "SELECT COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS qtd FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def k5(spark: SparkSession, d: str) -> DataFrame:
    gone = sheets(spark, d).where("status = 'pending'").select(F.col("sheet_id").alias("l_orderkey"))
    return documents.without(read(spark, d, "lineitem"), gone, "l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("qtd"))


KERNEL = "CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'rejected' WHEN 'purchase' THEN 'promoted' WHEN 'signup' THEN 'rolled_back' ELSE 'other' END"


def log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "accepted", "view", "rejected", "purchase", "promoted", "signup", "rolled_back", "error", "other")]), F.col("event_type"))
    return read(spark, d, "events").select(F.col("event_id").alias("version"), kind.alias("type"), F.col("ts").alias("at"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("payload"))


@query("r2_event_fold", f"WITH e AS (SELECT event_id, {KERNEL} AS t, 'v' || user_id AS p FROM events) SELECT MAX(event_id) AS version, COUNT(*) FILTER (t = 'accepted') AS n_accepted, COUNT(*) FILTER (t = 'rejected') AS n_rejected, arg_max(p, event_id) FILTER (t IN ('promoted', 'rolled_back')) AS active FROM e")
def r2(spark: SparkSession, d: str) -> DataFrame:
    return documents.folded(log(spark, d))


@query("r2_event_replay", f"WITH e AS (SELECT event_id, {KERNEL} AS t, 'v' || user_id AS p FROM events WHERE event_id > 500) SELECT MAX(event_id) AS version, COUNT(*) FILTER (t = 'accepted') AS n_accepted, COUNT(*) FILTER (t = 'rejected') AS n_rejected, arg_max(p, event_id) FILTER (t IN ('promoted', 'rolled_back')) AS active FROM e")
def r2_replay(spark: SparkSession, d: str) -> DataFrame:
    return documents.folded(log(spark, d).where("version > 500"))


@query("r9_watermark", f"WITH {SHEET} SELECT MAX(sheet_id) AS newest, COUNT(*) FILTER (sheet_id > 100) AS n_new FROM sheet")
def r9(spark: SparkSession, d: str) -> DataFrame:
    return sheets(spark, d).agg(F.max("sheet_id").alias("newest"), F.count_if(F.col("sheet_id") > 100).alias("n_new"))


@query("d_date_readers", """WITH t AS (SELECT o_orderkey AS k, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders) SELECT k, printf('%04d-%02d-%02d', y, m, d) AS parts, printf('%04d-%02d-%02d', CASE WHEN y % 100 < 100 THEN 2000 + y % 100 END, m, d) AS short, printf('%04d-%02d-%02d', y, m, d) AS numeric, CAST(NULL AS VARCHAR) AS swapped FROM t""")
def d_readers(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    t = lambda f: F.date_format("o_orderdate", f)
    return o.select(
        F.col("o_orderkey").alias("k"),
        dates.date_parts(t("d . M . yyyy")).alias("parts"),
        dates.date_parts(t("dd/MM/yy")).alias("short"),
        dates.date_numeric(F.concat(t("d-M-yyyy"), F.lit("."))).alias("numeric"),
        dates.date_numeric(F.concat(t("d"), F.lit("-13-"), t("yyyy"))).alias("swapped"),
    )


@query("j26_tiers_by_name", "WITH e AS (SELECT s_suppkey AS cod, upper(s_name) AS sname FROM supplier), u AS (SELECT sname, MIN(cod) AS cod FROM e GROUP BY sname HAVING COUNT(DISTINCT cod) = 1) SELECT DISTINCT s_name AS key, u.cod AS value, CASE WHEN u.cod IS NOT NULL THEN 1 END AS tier FROM supplier LEFT JOIN u ON u.sname = s_name")
def j26(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    unique = s.groupBy(F.upper("s_name").alias("key")).agg(F.min("s_suppkey").alias("value"), F.count_distinct("s_suppkey").alias("n")).where("n = 1").select("key", "value")
    return joins.first_of(s.select(F.col("s_name").alias("key")).distinct(), "key", unique)
