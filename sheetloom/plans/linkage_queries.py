"""Linkage over the whole part table: rows as written against the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity
from ..operators import joins, linkage
from .registry import query
from .tables import LIKE, read

W = "CASE WHEN {c} / {n} >= {m} THEN 1.0::DOUBLE ELSE GREATEST(1.0::DOUBLE, LEAST(14.0::DOUBLE, log2({m} / ({c} / {n})))) END"
SIM = f"CASE WHEN {{a}} <> '' AND {{b}} <> '' THEN ({LIKE}) / 100.0 END"
NUM = "COALESCE(CASE WHEN {s} >= 1 THEN {w} WHEN {s} >= 0.9 THEN 0.5 * {w} WHEN {s} >= 0.8 THEN 0.3 * {w} WHEN {s} <= 0.3 THEN {d} ELSE 0 END, 0)"
NAME = "COALESCE(CASE WHEN {s} >= 1 THEN {w} WHEN {s} >= 0.55 THEN {s} * {w} WHEN {s} <= 0.3 THEN {d} ELSE 0 END, 0)"
DIM = "COALESCE(LEAST(13.0::DOUBLE, -log2(GREATEST(nd / n, 0.116::DOUBLE))), 0)"

PLAN = """p AS (SELECT p_partkey AS plan_ord, CAST(100000 + p_partkey // 2 AS VARCHAR) AS of, CAST(p_size AS VARCHAR) AS ov, p_type AS cliente, p_name AS modelo, CAST(p_size % 7 AS DOUBLE) AS comp FROM part),
 r AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN CAST(100001 + p_partkey // 2 AS VARCHAR) ELSE CAST(100000 + p_partkey // 2 AS VARCHAR) END AS of, CAST(p_size AS VARCHAR) AS ov,
 CASE WHEN p_partkey % 3 = 0 THEN 'LARGE' ELSE p_type END AS cliente, p_name AS modelo, CAST(p_partkey % 7 AS DOUBLE) AS comp FROM part)"""
POOL = "pool AS (SELECT row_id, plan_ord FROM r JOIN p USING (of) UNION SELECT row_id, plan_ord FROM r JOIN p ON r.ov = p.ov AND r.modelo = p.modelo)"
SCORED = f"""n AS (SELECT GREATEST(COUNT(*), 1000)::DOUBLE AS n FROM p), w AS (SELECT p.*, n, {", ".join(W.format(c=f"COUNT(*) OVER (PARTITION BY {f})", n="n", m=m) + f" AS w_{f}" for f, m in linkage.M.items())}, COUNT(*) OVER (PARTITION BY comp) AS nd FROM p, n),
 j AS (SELECT pool.row_id, pool.plan_ord, w.of AS eof, w.modelo AS emodelo, r.comp AS rc, w.comp AS ec, n, nd, w_of, w_ov, w_cliente, w_modelo, r.of IN (SELECT of FROM p) AS valid, {", ".join(SIM.format(a=f"r.{f}", b=f"w.{f}") + f" AS s_{f}" for f in linkage.IDENTITY)} FROM pool JOIN r USING (row_id) JOIN w ON w.plan_ord = pool.plan_ord),
 scored AS (SELECT row_id, plan_ord, eof AS of, emodelo AS modelo, ROUND({NUM.format(s="s_of", w="w_of", d=-1.7)} + {NUM.format(s="s_ov", w="w_ov", d=-0.9)} + {NAME.format(s="s_cliente", w="w_cliente", d=-1.2)} + {NAME.format(s="s_modelo", w="w_modelo", d=-1.1)}
 + CASE WHEN valid AND s_of < 0.9 THEN -3.3 ELSE 0 END + CASE WHEN rc = ec THEN {DIM} ELSE 0 END + CASE WHEN rc <> ec THEN -2.5 ELSE 0 END, 6) AS bits,
 {" + ".join(f"COALESCE(CAST(s_{f} >= 0.55 AS INTEGER), 0)" for f in linkage.IDENTITY)} + CAST(rc = ec AS INTEGER) AS agree, ROUND({" + ".join(f"COALESCE(s_{f}, 0)" for f in linkage.IDENTITY)}, 6) AS raw, COALESCE(s_of >= 1, FALSE) OR COALESCE(s_ov >= 1, FALSE) AS exact FROM j),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY bits DESC, agree DESC, raw DESC, exact DESC, plan_ord) AS place FROM scored)"""
BASE = f"WITH {PLAN}, {POOL}, {SCORED}"


#: Fields that make an entry a row's candidate.
BY = [["of"], ["ov", "modelo"]]


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = read(spark, d, "part")
    k = F.col("p_partkey")
    of = lambda x: (F.lit(x) + F.floor(k / 2)).cast("string")
    plan = part.select(k.alias("plan_ord"), of(100_000).alias("of"), F.col("p_size").cast("string").alias("ov"), F.col("p_type").alias("cliente"), F.col("p_name").alias("modelo"), (F.col("p_size") % 7).cast("double").alias("comp"))
    rows = part.select(
        k.alias("row_id"),
        F.when(k % 4 == 0, "").when(k % 5 == 0, of(100_001)).otherwise(of(100_000)).alias("of"),
        F.col("p_size").cast("string").alias("ov"),
        F.when(k % 3 == 0, "LARGE").otherwise(F.col("p_type")).alias("cliente"),
        F.col("p_name").alias("modelo"),
        (k % 7).cast("double").alias("comp"),
    )
    return rows, plan, linkage.candidates(rows, plan, BY)


def linked(spark: SparkSession, d: str) -> linkage.Linked:
    rows, plan, _ = tables(spark, d)
    return linkage.Linked(rows, plan, BY, ("comp",))


@query("l2_candidates", f"WITH {PLAN}, {POOL} SELECT * FROM pool")
def l2(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d)[2]


@query("l5_bits", f"{BASE} SELECT row_id, plan_ord, bits, agree, raw, exact FROM scored")
def l5(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d).pairs().drop("modelo")


@query(
    "l7_winners",
    f"""{BASE}, b AS (SELECT row_id, plan_ord, of, modelo, bits FROM ranked WHERE place = 1), o AS (SELECT x.row_id, MAX(x.bits) FILTER (x.of <> b.of) AS rival, MAX(x.bits) FILTER (x.of = b.of AND x.modelo <> b.modelo) AS sibling, COUNT(*) FILTER (x.of <> b.of AND x.bits >= b.bits - 1) AS rivals FROM ranked x JOIN b USING (row_id) WHERE place > 1 GROUP BY x.row_id)
 SELECT row_id, plan_ord, of, bits, ROUND(bits - rival, 6) AS margin, ROUND(bits - sibling, 6) AS sibling_margin, COALESCE(rivals, 0) AS rivals, CASE WHEN rival IS NULL OR ROUND(bits - rival, 6) >= 4 THEN 'strong' ELSE 'weak_guess' END AS mode FROM b LEFT JOIN o USING (row_id)""",
)
def l7(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d).winners()


@query(
    "l8_posterior",
    f"""{BASE}, s AS (SELECT *, MAX(bits) OVER (PARTITION BY row_id) AS mx, MAX(CASE WHEN place = 1 THEN of END) OVER (PARTITION BY row_id) AS wof FROM ranked),
 g AS (SELECT row_id, mx, SUM(pow(2.0, (bits - mx) / 2.5)) AS z, SUM(CASE WHEN of = wof THEN pow(2.0, (bits - mx) / 2.5) END) AS own, COUNT(*) AS k FROM s GROUP BY ALL), t AS (SELECT *, 0.059::DOUBLE / 0.941::DOUBLE * pow(2.0, (2.0 - mx) / 2.5) AS nul, GREATEST((SELECT COUNT(*) FROM p) - k, 0) * pow(2.0, (-8.0 - mx) / 2.5) AS rest FROM g)
 SELECT row_id, ROUND(own / (z + nul + rest), 9) AS p_of, ROUND(nul / (z + nul + rest), 9) AS p_null FROM t""",
)
def l8(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d).posterior(read(spark, d, "part").count()).select("row_id", "p_of", "p_null")


@query("l12_cells", f"""{BASE}, b AS (SELECT row_id, of FROM ranked WHERE place = 1), c AS (SELECT row_id, r.of AS a, b.of AS x, {SIM.format(a="r.of", b="b.of")} AS s FROM r LEFT JOIN b USING (row_id))
 SELECT row_id, CASE WHEN x IS NULL AND a = '' THEN 'NA' WHEN x IS NULL THEN 'very_different' WHEN a = '' THEN 'snapped' WHEN a = x THEN 'confirmed' WHEN s < 0.5 THEN 'very_different' ELSE 'snapped' END AS status FROM c""")
def l12(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _ = tables(spark, d)
    best = linked(spark, d).best().select("row_id", F.col("of").alias("proposed"))
    return rows.join(best, "row_id", "left").select("row_id", linkage.cell(F.col("of"), F.col("proposed")).alias("status"))


@query("l1_hypotheses", f"WITH {PLAN}, h AS (SELECT row_id, CASE WHEN row_id % 6 = 0 THEN '' ELSE of END AS of, CASE WHEN row_id % 6 = 0 THEN 'x ' || CAST(100000 + row_id // 2 AS VARCHAR) ELSE cliente END AS cliente FROM r) SELECT row_id, 'H0' AS label, of, 0.0::DOUBLE AS cost FROM h UNION ALL SELECT row_id, 'cliente_embedded', regexp_extract(cliente, '(\\d{{5,6}})', 1), 0.79::DOUBLE FROM h WHERE row_id % 6 = 0")
def l1(spark: SparkSession, d: str) -> DataFrame:
    rows, plan, _ = tables(spark, d)
    sixth = F.col("row_id") % 6 == 0
    rows = rows.select("row_id", F.when(sixth, "").otherwise(F.col("of")).alias("of"), F.when(sixth, F.concat(F.lit("x "), (F.lit(100_000) + F.floor(F.col("row_id") / 2)).cast("string"))).otherwise(F.col("cliente")).alias("cliente"))
    return linkage.hypotheses(rows, plan)


@query(
    "w11_marginals",
    f"""{BASE}, s AS (SELECT *, MAX(bits) OVER (PARTITION BY row_id) AS mx, MAX(CASE WHEN place = 1 THEN modelo END) OVER (PARTITION BY row_id) AS wm FROM ranked),
 g AS (SELECT row_id, mx, SUM(pow(2.0, (bits - mx) / 2.5)) AS z, SUM(CASE WHEN modelo = wm THEN pow(2.0, (bits - mx) / 2.5) END) AS own, COUNT(*) AS k FROM s GROUP BY ALL), t AS (SELECT *, 0.059::DOUBLE / 0.941::DOUBLE * pow(2.0, (2.0 - mx) / 2.5) AS nul, GREATEST((SELECT COUNT(*) FROM p) - k, 0) * pow(2.0, (-8.0 - mx) / 2.5) AS rest FROM g)
 SELECT row_id, ROUND(own / (z + nul + rest), 9) AS p_modelo FROM t""",
)
def w11(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d).posterior(read(spark, d, "part").count()).select("row_id", "p_modelo")


#: Rows as written, with measures; the order number with a letter O for each zero of every tenth, the thickness of every
#: other without its comma.
WRITTEN = """w AS (SELECT row_id, CASE WHEN row_id % 10 = 3 THEN replace(of, '0', 'O') ELSE of END AS of, ov, cliente, CASE WHEN row_id % 4 = 1 THEN upper(split_part(modelo, ' ', 1)) ELSE modelo END AS modelo,
 p_retailprice + (row_id % 4) * 20 AS comp, p_size + (row_id % 3) * 6 AS larg, p_size + (row_id % 2) * 11 AS lbase, CASE WHEN row_id % 2 = 0 THEN p_size / 10.0 ELSE p_size END::DOUBLE AS esp FROM r JOIN part ON p_partkey = row_id),
 q AS (SELECT p.* EXCLUDE (comp), p_retailprice AS comp, p_size AS larg, p_size AS lbase, (p_size / 10.0)::DOUBLE AS esp, p_size % 3 AS material FROM p JOIN part ON p_partkey = plan_ord)"""
BARE = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"
SCORE = f"""CAST(w.of <> '' AND (w.of = q.of OR (length(regexp_replace(w.of, '[^0O]', '', 'g')) <= 3 AND replace(w.of, 'O', '0') = replace(q.of, 'O', '0'))) AS INTEGER) + CAST(w.ov = q.ov AS INTEGER) + CAST({BARE.format("w.cliente")} = {BARE.format("q.cliente")} AS INTEGER)
 + CAST(length(w.modelo) >= 4 AND (contains(upper(q.modelo), upper(w.modelo)) OR contains({BARE.format("q.modelo")}, {BARE.format("w.modelo")})) AS INTEGER)
 + CAST(abs(w.comp - q.comp) <= 50 AS INTEGER) + CAST(abs(w.larg - q.larg) <= 10 AS INTEGER) + CAST(abs(w.lbase - q.lbase) <= 10 AS INTEGER)
 + CAST(abs(w.esp - q.esp) <= 0.05 OR (w.esp >= 10 AND w.esp = floor(w.esp) AND w.esp / 10 BETWEEN 0.5 AND 15 AND abs(w.esp / 10 - q.esp) <= 0.05) AS INTEGER)"""


def measured(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows as written, with k_<column>, by which they are met with entries; and entries, as e_<column>."""
    rows, plan, _ = tables(spark, d)
    part = read(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    k, size = F.col("row_id"), F.col("p_size")
    w = rows.drop("comp").join(part, F.col("p_partkey") == k).select(
        "row_id",
        F.when(k % 10 == 3, F.translate("of", "0", "O")).otherwise(F.col("of")).alias("of"),
        "ov",
        "cliente",
        F.when(k % 4 == 1, F.upper(F.get(F.split("modelo", " "), F.lit(0)))).otherwise(F.col("modelo")).alias("modelo"),
        (F.col("p_retailprice") + k % 4 * 20).alias("comp"),
        (size + k % 3 * 6).alias("larg"),
        (size + k % 2 * 11).alias("lbase"),
        F.when(k % 2 == 0, size / 10).otherwise(size).cast("double").alias("esp"),
        *[F.col(f).alias(f"k_{f}") for f in ("of", "ov", "modelo")],
    )
    q = plan.drop("comp").join(part, F.col("p_partkey") == F.col("plan_ord")).select("plan_ord", "of", "ov", "cliente", "modelo", F.col("p_retailprice").alias("comp"), size.alias("larg"), size.alias("lbase"), (size / 10).alias("esp"), (size % 3).cast("string").alias("material"), size.alias("size"))
    return w, q.select("plan_ord", *[F.col(c).alias(f"e_{c}") for c in q.columns[1:]])


FIELDS = ("of", "ov", "cliente", "modelo", "comp", "larg", "lbase", "esp")


def agreeing(spark: SparkSession, d: str, fields: list[str], held: list[Column]) -> tuple[DataFrame, DataFrame, Column, DataFrame]:
    """Pairs equal in the order number alone, with score; rows met with kinds of entries (equal in all that is compared but the
    order number, and in `fields`), with score so far; what the order number r_of adds for m_of; and entries with m_of."""
    w, q = measured(spark, d)
    r, e = {f: F.col(f) for f in FIELDS}, {f: F.col(f"e_{f}") for f in FIELDS}
    r["esp"] = similarity.number_variants(F.col("esp"))
    left, right = linkage.match_sides(r, e)
    rows = w.select("row_id", *[c for c in w.columns if c.startswith("k_")], *[c.alias(f"r_{f}") for f, c in left.items()])
    entries = q.withColumns({"m_of": right["of"], "part": F.floor(F.monotonically_increasing_id() / (1 << 18))})
    ready = lambda df: df.withColumns({f"m_{f}": c for f, c in right.items() if f != "of"})
    points = lambda *names: linkage.match_points({f: F.col(f"r_{f}") for f in names}, {f: F.col(f"m_{f}") for f in names})
    single, kinds = linkage.met_by_kinds(rows, entries, "of", ["ov", "modelo"], [*[f"e_{f}" for f in FIELDS[1:]], *fields], held, ready)
    return single.withColumn("score", points(*FIELDS)), kinds.withColumn("score", points(*FIELDS[1:])), points("of"), entries


@query("l21_match_score", f"WITH {PLAN}, {POOL}, {WRITTEN} SELECT row_id, plan_ord, {SCORE} AS score FROM pool JOIN w USING (row_id) JOIN q USING (plan_ord)")
def l21(spark: SparkSession, d: str) -> DataFrame:
    # a kind's entries are held by the quarter million, so that none is too large for an array
    many = [F.collect_list(F.struct("plan_ord", "m_of")).alias("held")]
    single, kinds, more, _ = agreeing(spark, d, ["part"], many)
    pairs = kinds.select("row_id", "score", "r_of", F.inline("held")).select("row_id", "plan_ord", (F.col("score") + more).alias("score"))
    return single.select("row_id", "plan_ord", "score").unionByName(pairs)


@query("l11_work_complete", f"WITH {PLAN}, {POOL}, {WRITTEN}, s AS (SELECT row_id, {SCORE} AS score, p_size % 5 >= 3 AS phase_full FROM pool JOIN w USING (row_id) JOIN q USING (plan_ord) JOIN part ON p_partkey = plan_ord) SELECT row_id, COALESCE(bool_and(phase_full) FILTER (score >= 1), FALSE) AS complete FROM s GROUP BY row_id")
def l11(spark: SparkSession, d: str) -> DataFrame:
    full = linkage.phase_full(F.lit(3.0), (F.col("e_size") % 5).cast("double"))
    single, kinds, _, entries = agreeing(spark, d, [], [F.bool_and(full).alias("phase_full")])
    # entries of the same sales order and model that have the order number only: those may agree in nothing else
    alike = kinds.where("score = 0").select("row_id", "k_ov", "k_modelo", F.explode("r_of").alias("_of")).distinct()
    rest = alike.join(entries, (F.col("_of") == F.col("m_of")) & (F.col("k_ov") == F.col("e_ov")) & (F.col("k_modelo") == F.col("e_modelo"))).where("m_of != ''")
    of_pair = lambda df, score, own: df.select("row_id", score.alias("score"), own.alias("phase_full"))
    pool = of_pair(single, F.col("score"), full).unionByName(of_pair(kinds, F.col("score"), F.col("phase_full"))).unionByName(of_pair(rest, F.lit(1), full))
    return linkage.work_complete(pool)


DIGITS = "len(list_filter(range(1, length({0}) + 1), lambda i: substr({0}, i, 1) <> substr({1}, i, 1)))"


@query(
    "l22_halves_score",
    f"""WITH {PLAN}, {POOL}, {WRITTEN}, s AS (SELECT row_id, CASE WHEN upper(w.cliente) = upper(q.cliente) THEN 1.0 WHEN len(list_intersect(list_filter(string_split(upper(w.cliente), ' '), lambda x: length(x) >= 3), list_filter(string_split(upper(q.cliente), ' '), lambda x: length(x) >= 3))) > 0 THEN 0.5 ELSE 0 END
 + CASE WHEN w.ov = q.ov THEN 1.0 WHEN length(w.ov) = length(q.ov) AND {DIGITS.format("w.ov", "q.ov")} BETWEEN 1 AND 2 THEN 0.5 ELSE 0 END
 + CASE WHEN length(w.modelo) >= 4 AND contains(upper(q.modelo), upper(w.modelo)) THEN 1.0 WHEN len(list_intersect(regexp_extract_all(upper(w.modelo), '[A-Z0-9]{{4,}}'), regexp_extract_all(upper(q.modelo), '[A-Z0-9]{{4,}}'))) > 0 THEN 0.5 ELSE 0 END
 + CAST(abs(w.comp - q.comp) <= 100 AS INTEGER) + CAST(abs(w.lbase - q.lbase) <= 30 AS INTEGER) + CAST(abs(w.esp - q.esp) <= 0.05 AS INTEGER) + CAST(abs(w.larg - q.larg) <= 20 AS INTEGER) + CAST(w.row_id % 3 = q.material AS INTEGER) AS s FROM pool JOIN w USING (row_id) JOIN q USING (plan_ord))
 SELECT row_id, MAX(s)::DOUBLE AS score FROM s GROUP BY row_id""",
)
def l22(spark: SparkSession, d: str) -> DataFrame:
    w, q = measured(spark, d)
    fields = ("ov", "cliente", "modelo", "comp", "lbase", "esp", "larg")
    none = F.lit(None).cast("double")
    r = {f: F.col(f) for f in fields} | {"ltopo": none, "material": (F.col("row_id") % 3).cast("string")}
    e = {f: F.col(f"e_{f}") for f in (*fields, "material")} | {"ltopo": none}
    left, right = linkage.halves_sides(r, e)
    rows = w.select("row_id", *[c for c in w.columns if c.startswith("k_")], *[c.alias(f"r_{f}") for f, c in left.items()])
    ready = lambda df: df.withColumns({f"m_{f}": c for f, c in right.items()})
    single, kinds = linkage.met_by_kinds(rows, q, "of", ["ov", "modelo"], [f"e_{f}" for f in (*fields, "material")], [F.count("*").alias("n")], ready)
    score = linkage.halves_points({f: F.col(f"r_{f}") for f in left}, {f: F.col(f"m_{f}") for f in right})
    return single.select("row_id", score.alias("s")).unionByName(kinds.where("n > 0").select("row_id", score.alias("s"))).groupBy("row_id").agg(F.max("s").alias("score"))


@query(
    "l17_declared_votes",
    f"""WITH {PLAN}, {POOL}, n AS (SELECT GREATEST(COUNT(*), 1000)::DOUBLE AS n FROM p), c AS (SELECT upper(cliente) AS c, COUNT(*) AS k FROM p GROUP BY 1), v AS (SELECT comp, (SELECT COUNT(*) FROM p y WHERE abs(y.comp - x.comp) <= 1.0) AS k FROM (SELECT DISTINCT comp FROM r) x)
 SELECT row_id, plan_ord, ROUND(LEAST(CASE WHEN upper(r.cliente) = upper(p.cliente) THEN GREATEST(0.0::DOUBLE, log2(0.8::DOUBLE / (c.k / n))) ELSE 0.0::DOUBLE END + CASE WHEN abs(r.comp - p.comp) <= 1.0 THEN GREATEST(0.0::DOUBLE, log2(0.6::DOUBLE / (v.k / n))) ELSE 0.0::DOUBLE END, 4.0::DOUBLE), 6) AS bonus
 FROM pool JOIN r USING (row_id) JOIN p USING (plan_ord) CROSS JOIN n LEFT JOIN c ON c.c = upper(r.cliente) LEFT JOIN v ON v.comp = r.comp""",
)
def l17(spark: SparkSession, d: str) -> DataFrame:
    rows, plan, pool = tables(spark, d)
    return linkage.declared_votes(pool, rows, plan, {"cliente": ("cliente", None, 0.8), "comp": ("comp", 1.0, 0.6)})


@query(
    "l2_texts_like",
    f"""WITH v AS (SELECT DISTINCT 'cliente' AS field, CASE WHEN p_partkey % 3 = 0 THEN replace(p_type, 'E', '') ELSE p_type END AS written FROM part UNION SELECT DISTINCT 'ov', CAST(p_size AS VARCHAR) || '7' FROM part),
 k AS (SELECT DISTINCT 'cliente' AS field, p_type AS known FROM part UNION SELECT DISTINCT 'ov', CAST(p_size * 11 AS VARCHAR) FROM part), s AS (SELECT field, written, known, {LIKE.format(a="written", b="known")} AS score FROM v JOIN k USING (field))
 SELECT field, written, known, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY field, written ORDER BY score DESC, known) <= 10""",
)
def l2_texts(spark: SparkSession, d: str) -> DataFrame:
    """The ten known values most like each written one, field by field."""
    p = read(spark, d, "part")
    written = {"cliente": F.when(F.col("p_partkey") % 3 == 0, F.replace("p_type", F.lit("E"), F.lit(""))).otherwise(F.col("p_type")), "ov": F.concat(F.col("p_size").cast("string"), F.lit("7"))}
    known = {"cliente": F.col("p_type"), "ov": (F.col("p_size") * 11).cast("string")}
    out = [joins.top_like(p.select(written[f].alias("written")), p.select(known[f].alias("known")), "written", "known", similarity.likeness).select(F.lit(f).alias("field"), "written", "known", "score") for f in known]
    return out[0].unionByName(out[1])


@query(
    "l2_measures_near",
    """WITH v AS (SELECT DISTINCT 'comp' AS field, round(p_retailprice) + 3 AS written, 50.0::DOUBLE AS t FROM part UNION SELECT DISTINCT 'esp', p_size / 4.0, 0.05 FROM part), k AS (SELECT DISTINCT 'comp' AS field, p_retailprice AS known FROM part UNION SELECT DISTINCT 'esp', p_size / 3 FROM part)
 SELECT field, written::DOUBLE AS written, known, ROUND(CASE WHEN abs(written - known) <= t THEN 1.0 ELSE GREATEST(0.0, 1 - (abs(written - known) - t) / GREATEST(t, 1.0)) END * 100, 6) AS score FROM v JOIN k USING (field) QUALIFY row_number() OVER (PARTITION BY field, written ORDER BY abs(written - known), known) <= 10""",
)
def l2_measures(spark: SparkSession, d: str) -> DataFrame:
    """The ten known measures nearest to each written one, field by field."""
    p = read(spark, d, "part")
    a = joins.nearest_values(p.select((F.round("p_retailprice") + 3).alias("written")), p.select(F.col("p_retailprice").alias("known")), "written", "known", 50.0)
    b = joins.nearest_values(p.select((F.col("p_size") / 4).alias("written")), p.select((F.col("p_size") / 3).alias("known")), "written", "known", 0.05)
    return a.select(F.lit("comp").alias("field"), "written", "known", "score").unionByName(b.select(F.lit("esp").alias("field"), "written", "known", "score"))


@query(
    "l2_misread_orders",
    f"""WITH {PLAN}, m AS (SELECT row_id, replace(of, '1', '7') AS of FROM r WHERE of <> '' AND of LIKE '%1%9%'), s AS (SELECT a.of, b.of AS known, {LIKE.format(a="a.of", b="b.of")} AS score FROM (SELECT DISTINCT of FROM m) a, (SELECT DISTINCT of FROM p) b),
 t AS (SELECT of, known FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY of ORDER BY score DESC, known) <= 10) SELECT DISTINCT row_id, plan_ord FROM m JOIN t USING (of) JOIN p ON p.of = t.known""",
)
def l2_misread(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of rows whose order number was misread, by the ten known numbers most like it."""
    rows, plan, _ = tables(spark, d)
    m = rows.where("of like '%1%9%'").select("row_id", F.replace("of", F.lit("1"), F.lit("7")).alias("of"), "ov", "modelo")
    near = joins.top_codes(m.select(F.col("of").alias("written")), plan.select(F.col("of").alias("known")), "written", "known")
    return linkage.candidates(m, plan, [], {"of": near})


@query("j26_identity", "WITH r AS (SELECT c_custkey AS row_id, c_custkey % 120 AS code, CASE WHEN c_custkey % 3 = 0 THEN 'Supplier#' || lpad(CAST(c_custkey % 100 AS VARCHAR), 9, '0') ELSE 'nobody' END AS name FROM customer) SELECT row_id, CASE WHEN s.s_name = name THEN s.s_suppkey WHEN u.s_suppkey IS NOT NULL THEN u.s_suppkey END AS code, CASE WHEN s.s_name = name THEN 'code_name' WHEN u.s_suppkey IS NOT NULL THEN 'name' ELSE 'no_ref' END AS how, FALSE AS suspended FROM r LEFT JOIN supplier s ON s.s_suppkey = code LEFT JOIN supplier u ON u.s_name = name")
def j26_identity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(k.alias("row_id"), (k % 120).alias("code"), F.when(k % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 100).cast("string"), 9, "0"))).otherwise("nobody").alias("name"))
    return linkage.identity(rows, read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name")))
