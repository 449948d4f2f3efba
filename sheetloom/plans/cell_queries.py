"""Decisions cell by cell over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import cells, joins, linkage
from .linkage_queries import BARE, BASE, PLAN, POOL, linked, tables
from .registry import query
from .tables import LIKE, SHEET, plan, read, sheets

SAMPLES = ("A", "12", "P.3", "REP C12", "123456", "9:30", "24:00", "24:01", "9 05", "25:10", "830", "2460", "8,5 h", "-1", "3,25", "M032", "m1", "X", "x", "Sim", "não", "31-12-2025", "30/02/2024", "2024.2.9", "1-2-24", "cesta 4", "", " 7 ", "12345")
CHOSEN = f"(SELECT p_partkey AS k, trim(({list(SAMPLES)})[p_partkey % {len(SAMPLES)} + 1]) AS t FROM part)"


def sampled(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("k"), F.get(F.array(*map(F.lit, SAMPLES)), (k % len(SAMPLES)).cast("int")).alias("t"))


@query(
    "x20_forms",
    f"""WITH s AS {CHOSEN}, n AS (SELECT *, TRY_CAST(replace(t, ',', '.') AS DOUBLE) AS n, trim(regexp_replace(t, '[hH]+$', '')) AS b FROM s)
 SELECT k, t <> '' AND NOT regexp_matches(t, '^\\d{{6}}$') AND regexp_matches(upper(t), '^([A-Z]|[A-Z]?\\d{{1,3}}|P\\.?\\d|REP\\.?\\s?C?\\d+)$') AS priority, regexp_matches(t, '^\\d{{1,4}}$') AS count, regexp_matches(t, '^\\d{{1,5}}$') AS operator, regexp_matches(upper(t), '^M\\d{{3}}$') AS machine, COALESCE(n >= 0, FALSE) AS amount, upper(t) = 'X' AS mark, regexp_matches(t, '\\d') AS digit,
 regexp_matches(t, '^0*(\\d|1\\d|2[0-3])[: ]0*(\\d|[1-5]\\d)$') AS time, upper(strip_accents(t)) IN ('SIM', 'S', 'NAO', 'N', 'YES', 'Y', 'NO') AS yes_no,
 CASE WHEN contains(b, ':') OR contains(b, ' ') THEN regexp_matches(b, '^0*(\\d|1\\d|2[0-3])[: ]0*(\\d|[1-5]\\d)$') OR regexp_matches(b, '^0*24[: ]0+$') ELSE regexp_matches(b, '^(\\d|[01]\\d|2[0-3])[0-5]\\d$') OR b = '2400' OR COALESCE(TRY_CAST(replace(b, ',', '.') AS DOUBLE) BETWEEN 0 AND 24, FALSE) END AS hours,
 try_strptime(t, ['%d-%m-%Y', '%d/%m/%Y', '%d.%m.%Y', '%Y-%m-%d', '%Y/%m/%d', '%Y.%m.%d']) IS NOT NULL AND regexp_matches(t, '\\d{{4}}') AS date FROM n""",
)
def x20(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("priority", "count", "operator", "machine", "amount", "mark", "digit", "time", "yes_no", "hours", "date")
    return sampled(spark, d).select("k", *[text.fits(kind, F.col("t")).alias(kind) for kind in kinds])


@query(
    "l14_local_rules",
    f"""WITH s AS (SELECT *, k % 2 = 0 AS w FROM {CHOSEN}), f AS (SELECT *, regexp_matches(t, '^\\d{{1,4}}$') AS count, upper(t) = 'X' AS mark FROM s)
 SELECT k, CASE WHEN t = '' THEN CASE WHEN w THEN 'confirmed' ELSE 'NA' END WHEN count OR w THEN 'confirmed' ELSE 'very_different' END AS qtd, CASE WHEN t = '' THEN CASE WHEN w THEN 'RULE' END WHEN count THEN 'RULE' WHEN w THEN 'RULE_FORCED' END AS qtd_kind, CASE WHEN t = '' THEN CASE WHEN w THEN 'confirmed' ELSE 'NA' END WHEN mark THEN 'confirmed' ELSE 'very_different' END AS fecho FROM f""",
)
def l14(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("k") % 2 == 0
    s = sampled(spark, d).select("k", cells.local("qtd", F.col("t"), w).alias("q"), cells.local("fecho", F.col("t"), w).alias("f"))
    return s.select("k", F.col("q.status").alias("qtd"), F.col("q.kind").alias("qtd_kind"), F.col("f.status").alias("fecho"))


LETTERS = "FSBOD"


@query(
    "x7_digit_choices",
    "WITH m AS (SELECT unnest(['F', 'S', 'B', 'O', 'D']) AS l, unnest([['F', '6', '8', '5', '7', 'E'], ['S', '5', '8', '2'], ['B', '8', '6', '3'], ['O', '0', 'D', 'Q'], ['D', '0', 'O', 'B']]) AS o), p AS (SELECT p_partkey AS k, substr('FSBOD', p_partkey % 5 + 1, 1) AS a, substr('FSBOD', p_size % 5 + 1, 1) AS b FROM part) SELECT k, string_agg(v, ',' ORDER BY v) AS choices FROM (SELECT k, '26' || x || '1' || y || (k % 10) AS v FROM p JOIN m ma ON ma.l = a JOIN m mb ON mb.l = b, unnest(ma.o) u(x), unnest(mb.o) v(y) WHERE len(ma.o) * len(mb.o) <= 32) GROUP BY k",
)
def x7(spark: SparkSession, d: str) -> DataFrame:
    p, k = read(spark, d, "part"), F.col("p_partkey")
    a, b = (F.substring(F.lit(LETTERS), (n % 5 + 1).cast("int"), F.lit(1)) for n in (k, F.col("p_size")))
    c = p.select(k.alias("k"), text.digit_choices(F.concat(F.lit("26"), a, F.lit("1"), b, (k % 10).cast("string")), 64).alias("c"))
    return c.where(F.size("c") <= 32).select("k", F.array_join(F.array_sort("c"), ",").alias("choices"))


TOOLS = ("oct.", "Cóni", "13.7", "13 , 7", "12", "abc", "", " - ", "TORRES", "1234,5")


@query("x21_tools", f"WITH s AS (SELECT p_partkey AS k, trim(({list(TOOLS)})[p_partkey % 10 + 1]) AS t FROM part), c AS (SELECT *, regexp_replace(upper(strip_accents(t)), '[^A-Z0-9]', '', 'g') AS c FROM s) SELECT k, CASE WHEN regexp_matches(t, '^\\d{{1,3}}\\s*[.,]\\s*\\d{{1,2}}$') THEN regexp_replace(t, '^(\\d+)\\s*[.,]\\s*(\\d+)$', '\\1,\\2') WHEN c = '' OR regexp_matches(c, '^\\d+$') OR c IN ('CONI', 'TORRES', 'OCT', 'CIL', 'CIO', 'CIB') THEN c END AS tool FROM c")
def x21(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("k"), text.tool(F.get(F.array(*map(F.lit, TOOLS)), (k % 10).cast("int"))).alias("tool"))


@query("m14_personnel_number", "SELECT c_custkey, CASE WHEN n > 0 AND n < 10000 THEN '1000' || lpad(CAST(n AS VARCHAR), 4, '0') WHEN n > 0 THEN CAST(n AS VARCHAR) END AS pernr FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 10000000 + c_custkey WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 11 <> 0 THEN c_custkey % 5000 END AS n FROM customer)")
def m14(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, (10_000_000 + k).cast("string")).when(k % 7 == 0, "000").when(k % 11 != 0, F.concat(F.lit("0"), (k % 5000).cast("string"))).otherwise("x")
    return read(spark, d, "customer").select("c_custkey", text.personnel_number(code).alias("pernr"))


@query("z42_formatted", "SELECT p_partkey, replace(regexp_replace(regexp_replace(printf('%.4f', p_size / 8), '0+$', ''), '\\.$', ''), '.', ',') AS esp, CAST(CAST(round_even(p_size / 2, 0) AS BIGINT) AS VARCHAR) AS larg, p_type AS cliente FROM part")
def z42(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", text.formatted("esp", F.replace((size / 8).cast("string"), F.lit("."), F.lit(","))).alias("esp"), text.formatted("larg_mm", (size / 2).cast("string")).alias("larg"), text.formatted("cliente", F.concat(F.lit(" "), "p_type")).alias("cliente"))


MODEL = f"length(w) >= 4 AND (contains(upper(p_name), upper(w)) OR contains({BARE.format('p_name')}, {BARE.format('w')}))"


@query("z33_model_likeness", f"WITH v AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '-') ELSE split_part(p_name, ' ', 2) || p_brand END AS w, p_name FROM part) SELECT p_partkey, GREATEST({LIKE.format(a='w', b='p_name')}, {LIKE.format(a=BARE.format('w'), b=BARE.format('p_name'))}) AS score, {MODEL} AS names FROM v")
def z33(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of written model codes and designations (Z33), and whether one names the other."""
    words = F.split("p_name", " ")
    w = F.when(F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.concat(words[1], "p_brand"))
    return read(spark, d, "part").select("p_partkey", similarity.model_likeness(w, F.col("p_name")).alias("score"), text.names_model(w, F.col("p_name")).alias("names"))


@query("z34_names_model", f"WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) || split_part(p_name, ' ', 2) AS w FROM part), n AS (SELECT DISTINCT p_name FROM part) SELECT w, COUNT(*) AS n FROM w, n WHERE {MODEL} GROUP BY w")
def z34(spark: SparkSession, d: str) -> DataFrame:
    """How many designations each written code names: both by letters and digits alone, one within the other."""
    p, words = read(spark, d, "part"), F.split("p_name", " ")
    w = p.select(F.concat(words[0], words[1]).alias("w")).distinct().withColumn("part", text.compact_model(F.col("w")))
    n = p.select("p_name").distinct().withColumn("whole", text.compact_model(F.col("p_name")))
    met = joins.within(w, "part", n, "whole", 4).join(w, "part").join(n, "whole")
    return met.where(text.names_model(F.col("w"), F.col("p_name"))).groupBy("w").agg(F.count("*").alias("n"))


@query("z44_points_elsewhere", f"WITH {PLAN}, x AS (SELECT row_id, r.of AS w, CASE WHEN row_id % 7 = 0 THEN replace(p.of, '0', 'O') ELSE p.of END AS p FROM r JOIN p ON plan_ord = row_id) SELECT row_id, w <> '' AND w IN (SELECT of FROM p) AND NOT (w = p OR (length(regexp_replace(p, '[^0O]', '', 'g')) <= 3 AND replace(p, 'O', '0') = w)) AS elsewhere FROM x")
def z44(spark: SparkSession, d: str) -> DataFrame:
    rows, plan_rows, _ = tables(spark, d)
    k = F.col("row_id")
    proposed = plan_rows.select(F.col("plan_ord").alias("row_id"), F.col("of").alias("p"))
    x = rows.select("row_id", F.col("of").alias("written")).join(proposed, "row_id").select("row_id", "written", F.when(k % 7 == 0, F.translate("p", "0", "O")).otherwise(F.col("p")).alias("proposed"))
    return cells.points_elsewhere(x, plan_rows, "of").select("row_id", "elsewhere")


@query("z45_declared", f"WITH x AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 3 = 0 THEN lower(p_type) ELSE p_brand END AS a, p_type AS b, CASE WHEN p_size % 4 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS n FROM part) SELECT k, CASE WHEN a = '' THEN 'NA' WHEN upper(a) = upper(b) OR {LIKE.format(a='a', b='b')} >= 55 THEN 'confirmed' ELSE 'very_different' END AS as_text, CASE WHEN TRY_CAST(n AS DOUBLE) IS NULL THEN 'NA' WHEN abs(k % 50 - CAST(n AS DOUBLE)) <= 10 THEN 'confirmed' ELSE 'very_different' END AS as_number FROM x")
def z45(spark: SparkSession, d: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey")
    a = F.when(size % 5 == 0, "").when(size % 3 == 0, F.lower("p_type")).otherwise(F.col("p_brand"))
    n = F.when(size % 4 == 0, "n/a").otherwise(size.cast("string"))
    x = read(spark, d, "part").select(k.alias("k"), cells.declared(a, F.col("p_type"), "text").alias("t"), cells.declared((k % 50).cast("string"), n, "num", 10.0).alias("n"))
    return x.select("k", F.col("t.status").alias("as_text"), F.col("n.status").alias("as_number"))


@query("z46_reference_pool", "SELECT 'of' AS field, TRUE AS available, 'plan' AS source UNION ALL SELECT 'lote', TRUE, 'stock' UNION ALL SELECT 'esp', FALSE, 'plan' UNION ALL SELECT 'comp_mm', TRUE, 'plan'")
def z46(spark: SparkSession, d: str) -> DataFrame:
    p = plan(spark, d).withColumn("esp", F.lit(None).cast("double"))
    return cells.reference_pool(p, read(spark, d, "supplier"), {"of": "of", "lote": "lot", "esp": "esp", "comp_mm": "comp"})


@query(
    "z47_lots",
    """WITH s AS (SELECT 'M99B' || lpad(CAST(p_partkey % 40 AS VARCHAR), 4, '0') AS lote, MIN(p_size) * 20 AS larg, MIN(p_size) / 4 AS esp FROM part WHERE p_size > 3 GROUP BY 1),
 r AS (SELECT p_partkey AS row_id, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'm' WHEN 2 THEN 'H' ELSE 'X' END || '99B' || lpad(CAST(p_partkey % 43 AS VARCHAR), 4, '0') AS lote, p_size * 5 + 50 AS larg, CASE WHEN p_size % 2 = 0 THEN p_size / 4 END AS esp FROM part),
 j AS (SELECT r.*, s.lote AS lot, s.larg AS sl, s.esp AS se, abs(r.larg - s.larg) > 50 AS wide, COALESCE(abs(r.esp - s.esp) > 0.5, FALSE) AS thick FROM r LEFT JOIN s ON s.lote = CASE WHEN r.lote LIKE '99B%' THEN 'M' || r.lote WHEN r.lote LIKE 'm%' THEN upper(r.lote) WHEN r.lote LIKE 'H%' THEN 'M' || substr(r.lote, 2) END),
 h AS (SELECT *, CASE WHEN lot IS NULL THEN 'none' WHEN lote NOT LIKE 'H%' THEN 'exact' WHEN wide OR thick THEN 'rejected' ELSE 'corrected' END AS how FROM j)
 SELECT row_id, how, lot, CASE WHEN lot IS NULL THEN '' ELSE concat_ws(',', CASE WHEN wide THEN 'larg_mm' END, CASE WHEN thick THEN 'esp' END) END AS divergences, CASE WHEN how IN ('exact', 'corrected') THEN sl END AS stock_larg FROM h""",
)
def z47(spark: SparkSession, d: str) -> DataFrame:
    p, k, size = read(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    name = lambda n: F.concat(F.lit("99B"), F.lpad((k % n).cast("string"), 4, "0"))
    stock = p.where("p_size > 3").groupBy(F.concat(F.lit("M"), name(40)).alias("lote")).agg((F.min("p_size") * 20).alias("larg"), (F.min("p_size") / 4).alias("esp"))
    prefix = F.when(k % 4 == 0, "").when(k % 4 == 1, "m").when(k % 4 == 2, "H").otherwise("X")
    rows = p.select(k.alias("row_id"), F.concat(prefix, name(43)).alias("lote"), (size * 5 + 50).alias("larg"), F.when(size % 2 == 0, F.array(size / 4)).otherwise(F.array().cast("array<double>")).alias("esp"))
    return cells.lots(rows, stock).select("row_id", "how", "lot", "divergences", "stock_larg")


def finished_sql(a: str, b: str, far: str) -> str:
    return f"CASE WHEN {a} <> '' AND {a} = {b} THEN 'confirmed' WHEN {a} = '' OR lower({a}) = lower({b}) THEN 'snapped' WHEN {far} THEN 'very_different' ELSE 'snapped' END"


DECIDED = """CASE WHEN NOT hw AND (NOT hr OR p = '') THEN CASE WHEN t = '' THEN 'NA' ELSE 'very_different' END WHEN p = '' THEN 'confirmed' WHEN hw AND {sibling} THEN 'very_different' WHEN hw AND amb AND likely < 1 THEN 'very_different' WHEN hw AND t <> '' AND {conflict} THEN 'very_different' ELSE {finished} END"""
VALUE = "CASE WHEN NOT hw AND (NOT hr OR p = '') THEN t WHEN p = '' THEN {t} ELSE {p} END"
FLAGS = "p_size % 5 <> 0 AS hw, p_size % 11 <> 0 AS hr, p_size % 13 = 0 AS amb, p_size % 17 = 0 AS other, p_size % 19 = 0 AS sib, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.4 END AS likely"


@query(
    "l13_decided",
    f"""WITH c AS (SELECT 'cliente' AS field, p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 3 = 0 THEN lower(p_type) WHEN p_size % 4 = 0 THEN p_type ELSE p_brand END AS t, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_type END AS p, {FLAGS} FROM part),
 o AS (SELECT 'of' AS field, p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(100000 + p_partkey * (p_size % 3) AS VARCHAR) END AS t, CASE WHEN p_size % 9 = 0 THEN '' ELSE CAST(100000 + p_partkey AS VARCHAR) END AS p, {FLAGS} FROM part),
 m AS (SELECT 'comp_mm' AS field, p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_partkey * 3 AS VARCHAR) || ',5' END AS t, CASE WHEN p_size % 9 = 0 THEN '' ELSE CAST(p_partkey * 3 + p_size * 8 AS VARCHAR) || '.25' END AS p, {FLAGS} FROM part),
 n AS (SELECT *, CASE WHEN t <> '' THEN CAST(CAST(round_even(CAST(replace(t, ',', '.') AS DOUBLE), 0) AS BIGINT) AS VARCHAR) ELSE '' END AS a, CASE WHEN p <> '' THEN CAST(CAST(round_even(CAST(p AS DOUBLE), 0) AS BIGINT) AS VARCHAR) ELSE '' END AS b FROM m)
 SELECT field, k, {DECIDED.format(sibling="FALSE", conflict="FALSE", finished=finished_sql("t", "p", LIKE.format(a="t", b="p") + " < 50"))} AS status, {VALUE.format(t="t", p="p")} AS value FROM c
 UNION ALL SELECT field, k, {DECIDED.format(sibling="FALSE", conflict="other", finished=finished_sql("t", "p", LIKE.format(a="t", b="p") + " < 50"))}, {VALUE.format(t="t", p="p")} FROM o
 UNION ALL SELECT field, k, {DECIDED.format(sibling="FALSE", conflict="FALSE", finished=finished_sql("a", "b", "abs(CAST(replace(t, ',', '.') AS DOUBLE) - CAST(p AS DOUBLE)) > 200"))}, {VALUE.format(t="a", p="b")} FROM n""",
)
def l13(spark: SparkSession, d: str) -> DataFrame:
    p, k, size = read(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    blank = lambda n, c: F.when(size % n == 0, "").otherwise(c)
    fields = {
        "cliente": (blank(7, F.when(size % 3 == 0, F.lower("p_type")).when(size % 4 == 0, F.col("p_type")).otherwise(F.col("p_brand"))), blank(9, F.col("p_type"))),
        "of": (blank(7, (100_000 + k * (size % 3)).cast("string")), blank(9, (100_000 + k).cast("string"))),
        "comp_mm": (blank(7, F.concat((k * 3).cast("string"), F.lit(",5"))), blank(9, F.concat((k * 3 + size * 8).cast("string"), F.lit(".25")))),
    }
    flag = lambda n: size % n == 0
    likely = F.when(size % 2 == 0, 1.0).otherwise(0.4)
    held = [F.struct(F.lit(f).alias("field"), cells.decided(f, t, v, ~flag(5), ~flag(11), flag(13), flag(17), flag(19), likely).alias("cell")) for f, (t, v) in fields.items()]
    return p.select(k.alias("k"), F.inline(F.array(*held))).select("field", "k", "cell.status", "cell.value")


@query(
    "l16_row_cells",
    f"""{BASE}, b AS (SELECT row_id, plan_ord FROM ranked WHERE place = 1), c AS (SELECT row_id, r.of AS t1, COALESCE(p.of, '') AS p1, r.cliente AS t2, COALESCE(p.cliente, '') AS p2, b.plan_ord IS NOT NULL AS hw FROM r LEFT JOIN b USING (row_id) LEFT JOIN p USING (plan_ord))
 SELECT row_id, {" , ".join(f"CASE WHEN NOT hw THEN CASE WHEN t{i} = '' THEN 'NA' ELSE 'very_different' END ELSE {finished_sql(f't{i}', f'p{i}', LIKE.format(a=f't{i}', b=f'p{i}') + ' < 50')} END AS {f}" for i, f in ((1, "of"), (2, "cliente")))} FROM c""",
)
def l16(spark: SparkSession, d: str) -> DataFrame:
    """A whole row: its winner, and each field's cell by it."""
    rows, plan_rows, _ = tables(spark, d)
    best = linked(spark, d).best().select("row_id", "plan_ord").join(plan_rows.select("plan_ord", F.col("of").alias("p_of"), F.col("cliente").alias("p_cliente")), "plan_ord")
    j = rows.join(best, "row_id", "left")
    won, yes, no = F.col("plan_ord").isNotNull(), F.lit(True), F.lit(False)
    return j.select("row_id", *[cells.decided(f, F.col(f), F.col(f"p_{f}"), won, yes, no, no, no, F.lit(1.0))["status"].alias(f) for f in ("of", "cliente")])


@query("l15_footer_total", f"WITH {SHEET}, s AS (SELECT l_orderkey AS sheet_id, SUM(CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_quantity AS BIGINT) END) AS s FROM lineitem GROUP BY 1) SELECT sheet_id, CASE WHEN sheet_id % 4 = 0 THEN '12' ELSE CAST(CAST(s AS BIGINT) AS VARCHAR) END AS total, sheet_id % 4 <> 0 AND s IS NOT NULL AS derived FROM sheet LEFT JOIN s USING (sheet_id)")
def l15_footer(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet_id"), F.when(F.col("l_linenumber") % 3 == 0, "x").otherwise(F.col("l_quantity").cast("string")).alias("qtd"))
    return cells.footer_total(rows, sheets(spark, d).select("sheet_id", F.when(F.col("sheet_id") % 4 == 0, "12").otherwise(" ").alias("total")))


@query(
    "l15_heads",
    f"""WITH {SHEET}, h AS (SELECT sheet_id, custkey % 150 AS code, CASE WHEN custkey % 5 = 0 THEN 'nobody' ELSE 'Supplier#' || lpad(CAST(custkey % 150 AS VARCHAR), 9, '0') END AS name, 'm0' || lpad(CAST(custkey % 40 AS VARCHAR), 2, '0') AS machine, CASE WHEN custkey % 6 = 0 THEN '31-02-2025' ELSE strftime(iso_date, '%d-%m-%Y') END AS date FROM sheet)
 SELECT sheet_id, CASE WHEN s_suppkey IS NULL THEN 'very_different' WHEN upper(name) = upper(s_name) THEN 'confirmed' ELSE 'snapped' END AS operator_status, CASE WHEN CAST(substr(machine, 2) AS INTEGER) IN (SELECT n_nationkey FROM nation) THEN 'confirmed' ELSE 'very_different' END AS machine_status, CASE WHEN date = '31-02-2025' THEN 'very_different' ELSE 'confirmed' END AS date_status FROM h LEFT JOIN supplier ON s_suppkey = code""",
)
def l15_heads(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("custkey")
    s = sheets(spark, d).select(
        "sheet_id",
        F.concat(F.lit("1000"), F.lpad((c % 150).cast("string"), 4, "0")).alias("code"),
        F.when(c % 5 == 0, "nobody").otherwise(F.concat(F.lit("Supplier#"), F.lpad((c % 150).cast("string"), 9, "0"))).alias("name"),
        F.concat(F.lit("m0"), F.lpad((c % 40).cast("string"), 2, "0")).alias("machine"),
        F.when(c % 6 == 0, "31-02-2025").otherwise(F.date_format("iso_date", "dd-MM-yyyy")).alias("date"),
    )
    people = read(spark, d, "supplier").select(F.concat(F.lit("1000"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("pernr"), F.col("s_name").alias("name"))
    machines = read(spark, d, "nation").select(F.concat(F.lit("M0"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("machine"))
    return cells.heads(s, people, machines)


@query("l23_learnt_case", "WITH r AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '*' END AS s, lower(p_type) AS f, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'all ' || p_type END AS c FROM part) SELECT p_partkey AS row_id, COALESCE(a.c, b.c) AS canonical FROM part LEFT JOIN r a ON a.s = p_brand AND a.f = lower(p_type) LEFT JOIN r b ON b.s = '*' AND b.f = lower(p_type)")
def l23(spark: SparkSession, d: str) -> DataFrame:
    p, even = read(spark, d, "part"), F.col("p_size") % 2 == 0
    rules = p.select(F.when(even, F.col("p_brand")).otherwise("*").alias("scope"), F.lit("cliente").alias("field"), F.lower("p_type").alias("folded"), F.when(even, F.col("p_type")).otherwise(F.concat(F.lit("all "), "p_type")).alias("canonical")).distinct()
    rows = p.select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("template"), F.lit("cliente").alias("field"), F.concat(F.lit(" "), F.upper("p_type")).alias("value"))
    return cells.learnt_case(rows, rules).select("row_id", "canonical")


DIFFER = "len(list_filter(range(1, length(core) + 1), lambda i: substr(core, i, 1) <> substr(token, i, 1)))"
PAIRS = [*cells.GLYPHS, *[g[::-1] for g in cells.GLYPHS]]
CODES = f"""tok AS (SELECT t AS token, COUNT(*) AS n FROM (SELECT unnest(string_split(upper(p_name), ' ')) AS t FROM part) GROUP BY 1), cor AS (SELECT DISTINCT CASE WHEN length(token) % 2 = 0 THEN replace(token, 'E', 'F') ELSE token || 'S' END AS core FROM tok),
 met AS (SELECT core, token, n, 10.0::DOUBLE * levenshtein(token, core) AS c, length(core) = length(token) AND {DIFFER} = 1 AS one, (list_filter([substr(core, i, 1) || substr(token, i, 1) for i in range(1, length(core) + 1)], lambda x: substr(x, 1, 1) <> substr(x, 2, 1)))[1] AS pair FROM cor, tok WHERE abs(length(core) - length(token)) <= 2 AND (substr(core, 1, 2) = substr(token, 1, 2) OR right(core, 2) = right(token, 2))),
 cost AS (SELECT core, token, n, CASE WHEN c > 7 AND one AND pair IN {tuple(PAIRS)} THEN 7.0::DOUBLE ELSE c END AS cost FROM met)"""


def codes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tokens = read(spark, d, "part").select(F.explode(F.split(F.upper("p_name"), " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    cores = tokens.select(F.when(F.length("token") % 2 == 0, F.replace("token", F.lit("E"), F.lit("F"))).otherwise(F.concat("token", F.lit("S"))).alias("core")).distinct()
    return cores, tokens


def ten_an_edit(a, b):
    return F.levenshtein(a, b) * 10.0


@query("z36_code_bits", f"WITH {CODES}, k AS (SELECT * FROM cost WHERE cost <= 25), u AS (SELECT *, (SUM(pow(2.0, -cost) * n) OVER (PARTITION BY core) + 1.0) / GREATEST((SELECT COUNT(*) FROM part), 1000) AS u FROM k) SELECT core, token, ROUND(GREATEST(LEAST(log2(0.524::DOUBLE) - cost - log2(u), 15.0::DOUBLE), -1.1::DOUBLE), 6) AS bits FROM u")
def z36(spark: SparkSession, d: str) -> DataFrame:
    cores, tokens = codes(spark, d)
    return cells.code_bits(cores, tokens, read(spark, d, "part").count(), ten_an_edit)


@query("z37_glyph_cost", f"WITH {CODES} SELECT core, token, cost FROM cost")
def z37(spark: SparkSession, d: str) -> DataFrame:
    cores, tokens = codes(spark, d)
    met = cells.neighbours(cores, tokens.select("token"))
    return met.withColumn("cost", cells.glyph_cost(F.col("token"), F.col("core"), ten_an_edit(F.col("token"), F.col("core"))))


@query("z35_channel_likeness", f"WITH {CODES} SELECT core, ROUND(MAX(CASE WHEN 1 - cost / 25 > 0 THEN LEAST(0.8::DOUBLE, 0.55::DOUBLE + LEAST(0.25::DOUBLE, 1 - cost / 25)) ELSE 0 END), 6) AS likeness FROM cost GROUP BY core")
def z35(spark: SparkSession, d: str) -> DataFrame:
    cores, tokens = codes(spark, d)
    met = cells.neighbours(cores, tokens.select("token"))
    cost = cells.glyph_cost(F.col("token"), F.col("core"), ten_an_edit(F.col("token"), F.col("core")))
    return met.groupBy("core").agg(F.round(F.max(cells.channel_likeness(cost)), 6).alias("likeness"))


@query("z38_joint_support", f"WITH {PLAN}, {POOL}, j AS (SELECT row_id, plan_ord, r.of = p.of AS a, r.ov = p.ov AS b, r.cliente = p.cliente AS c FROM pool JOIN r USING (row_id) JOIN p USING (plan_ord)) SELECT row_id, plan_ord, ROUND(log2(CASE WHEN a AND b AND c THEN 0.219::DOUBLE WHEN a AND b THEN 0.411::DOUBLE WHEN a AND c THEN 0.276::DOUBLE WHEN b AND c THEN 0.258::DOUBLE WHEN a THEN 0.694::DOUBLE WHEN b THEN 0.469::DOUBLE WHEN c THEN 0.387::DOUBLE END / GREATEST(3.0 / 1000, CASE WHEN a THEN 0.0002::DOUBLE ELSE 1 END * CASE WHEN b THEN 0.00068::DOUBLE ELSE 1 END * CASE WHEN c THEN 0.02264::DOUBLE ELSE 1 END)), 6) AS bits FROM j")
def z38(spark: SparkSession, d: str) -> DataFrame:
    rows, plan_rows, pool = tables(spark, d)
    j = pool.join(rows.alias("r"), "row_id").join(plan_rows.alias("p"), "plan_ord")
    agreeing = [(f, F.coalesce(F.col(f"r.{f}") == F.col(f"p.{f}"), F.lit(False))) for f in ("of", "ov", "cliente")]
    return j.select("row_id", "plan_ord", F.round(cells.joint_support(agreeing, F.lit(3.0), F.lit(1000)), 6).alias("bits"))


M = {"of": 0.693, "cliente": 0.562}


@query(
    "z39_row_denominator",
    f"""WITH {PLAN}, u AS (SELECT row_id, plan_ord FROM r JOIN p ON r.of = p.of AND r.of <> '' UNION SELECT row_id, plan_ord FROM r JOIN p USING (cliente)), t AS (SELECT row_id, SUM(CASE WHEN r.of = '' THEN 1 WHEN r.of = p.of THEN 0.693::DOUBLE ELSE (1 - 0.693::DOUBLE) * 0.0002::DOUBLE END * CASE WHEN r.cliente = p.cliente THEN 0.562::DOUBLE ELSE (1 - 0.562::DOUBLE) * 0.02264::DOUBLE END) AS t FROM u JOIN r USING (row_id) JOIN p USING (plan_ord) GROUP BY 1)
 SELECT row_id, ROUND(log2(GREATEST(COALESCE(t, 0) / GREATEST((SELECT COUNT(*) FROM p), 1000), CASE WHEN of <> '' THEN 0.693::DOUBLE * 0.0002::DOUBLE ELSE 1 END * 0.562::DOUBLE * 0.02264::DOUBLE, 1e-30::DOUBLE)), 6) AS bits FROM r LEFT JOIN t USING (row_id)""",
)
def z39(spark: SparkSession, d: str) -> DataFrame:
    rows, plan_rows, _ = tables(spark, d)
    return cells.row_denominator(rows, plan_rows, M)


@query(
    "l20_cascade",
    f"""WITH w AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2) WHEN 2 THEN replace(p_type, 'N', '') ELSE replace(p_type, 'E', '3') END AS w FROM part), b AS (SELECT DISTINCT p_type AS v FROM part),
 e AS (SELECT w, MIN(v) AS v, 'exact' AS tier FROM w JOIN b ON upper(w) = upper(v) GROUP BY w), r1 AS (SELECT w FROM w WHERE w NOT IN (SELECT w FROM e)),
 u AS (SELECT w, MIN(v) AS v, 'unique' AS tier FROM r1 JOIN b ON (length(w) >= 3 AND contains(v, w)) OR (length(v) >= 3 AND contains(w, v)) GROUP BY w HAVING COUNT(DISTINCT v) = 1), r2 AS (SELECT w FROM r1 WHERE w NOT IN (SELECT w FROM u)),
 d AS (SELECT w, MIN(v) AS v, 'edit' AS tier FROM r2 JOIN b ON levenshtein(w, v) = 1 GROUP BY w HAVING COUNT(DISTINCT v) = 1), r3 AS (SELECT w FROM r2 WHERE w NOT IN (SELECT w FROM d)),
 l AS (SELECT w, v, 'like' AS tier FROM (SELECT w, v, {LIKE.format(a="w", b="v")} AS s FROM r3, b) WHERE s >= 80 QUALIFY row_number() OVER (PARTITION BY w ORDER BY s DESC, v) = 1) SELECT * FROM e UNION ALL SELECT * FROM u UNION ALL SELECT * FROM d UNION ALL SELECT * FROM l""",
)
def l20(spark: SparkSession, d: str) -> DataFrame:
    p, size, words = read(spark, d, "part"), F.col("p_size"), F.split("p_type", " ")
    w = F.when(size % 4 == 0, F.col("p_type")).when(size % 4 == 1, F.concat_ws(" ", F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit("")))).when(size % 4 == 2, F.replace("p_type", F.lit("N"), F.lit(""))).otherwise(F.replace("p_type", F.lit("E"), F.lit("3")))
    return joins.cascade(p.select(w.alias("w")), p.select(F.col("p_type").alias("v")), "w", "v", similarity.likeness, 80.0)


def words_read(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select("p_partkey", F.col("p_name").alias("a"), F.when(F.col("p_size") % 2 == 0, F.translate("p_name", "aeo", "430")).otherwise(F.concat("p_type", F.lit(" - "), F.split("p_name", " ")[0])).alias("b")).distinct()


@query("x13_replaced_letters")
def x13(spark: SparkSession, d: str) -> DataFrame:
    """Which characters stand for which where stretches were replaced; by matching blocks, which SQL has no words for."""
    return words_read(spark, d).select(F.explode(similarity.replaced_letters(F.col("a"), F.col("b"))).alias("p")).groupBy("p.expected", "p.found").agg(F.count("*").alias("n"))


@query("x17_relatedness")
def x17(spark: SparkSession, d: str) -> DataFrame:
    """How much final values have to do with what was written, in classes; by matching blocks, too."""
    r = words_read(spark, d).withColumn("r", similarity.relatedness(F.col("a"), F.col("b")))
    return r.groupBy(F.when(F.col("r") >= 0.70, "fine").when(F.col("r") >= 0.45, "doubtful").otherwise("unrelated").alias("class")).agg(F.count("*").alias("n"))


@query("x10_confused_edits", "WITH v AS (SELECT DISTINCT p_name AS a, replace(replace(p_name, 'a', '4'), 'e', '3') AS b FROM part) SELECT a, CASE WHEN a = b THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * (length(a) - length(replace(a, 'a', ''))) + 1.0 * (length(a) - length(replace(a, 'e', ''))) END AS distance FROM v")
def x10(spark: SparkSession, d: str) -> DataFrame:
    distance = similarity.confused_edits({"a": {"4": 0.5}, "e": {"3": 0.05}})
    v = read(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    return v.select("a", distance(F.col("a"), F.translate("a", "ae", "43")).alias("distance"))
