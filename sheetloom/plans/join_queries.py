"""Joins by chains of keys, ranges, neighbourhoods, tokens and likeness; set operations; predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import joins
from .registry import query
from .tables import EDIT, FACT, LIKE, PLAN, SHEET, edits, facts, plan, read, sheets


BARE = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"


@query(
    "j11_lookup_chain",
    f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, lpad(CAST(MIN(l_partkey) AS VARCHAR), 6, '0') AS of, CAST(MIN(l_suppkey) % 50 + 1 AS VARCHAR) AS ov, MIN(CASE WHEN l_linenumber % 2 = 0 THEN 'Brand#' || (l_partkey % 5 + 1) ELSE 'x' END) AS modelo, 'c' || MIN(l_suppkey) % 3 AS cliente, MIN(l_quantity) * 40 AS comp, MIN(l_linenumber) * 10 AS lbase FROM lineitem GROUP BY 1),
 e AS (SELECT p_partkey AS entry_ord, lpad(CAST(p_partkey - p_partkey % 3 AS VARCHAR), 6, '0') AS of, CAST(p_size AS VARCHAR) AS ov, p_brand || ' ' || p_type AS des, 'C' || p_size % 3 AS cliente, p_size * 40 AS comp, p_size AS lbase FROM part),
 b AS (SELECT r.row_id, r.ov, r.modelo, e.entry_ord, e.of AS eof, {BARE.format("e.des")} AS edes, r.ov = e.ov AS same, contains({BARE.format("e.des")}, {BARE.format("r.modelo")}) OR contains({BARE.format("r.modelo")}, {BARE.format("e.des")}) AS model, upper(r.cliente) = e.cliente AS client, abs(r.comp - e.comp) AS dc, abs(r.lbase - e.lbase) AS dl, r.of = e.of AS direct FROM r JOIN e ON r.of = e.of OR r.ov = e.ov),
 d AS (SELECT * FROM b WHERE direct QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY 8 * CAST(model AS INTEGER) + 4 * CAST(same AS INTEGER) + 2 * CAST(client AS INTEGER) + CAST(dc <= 50 AS INTEGER) + CAST(dl <= 30 AS INTEGER) DESC, dc + dl, entry_ord) = 1),
 ok AS (SELECT row_id, entry_ord, 'of' AS via FROM d WHERE same OR model)
 SELECT * FROM ok UNION ALL SELECT row_id, MIN(entry_ord), 'ov' FROM b WHERE same AND model AND row_id NOT IN (SELECT row_id FROM ok) GROUP BY row_id HAVING COUNT(DISTINCT (eof, edes)) = 1""",
)
def j11(spark: SparkSession, d: str) -> DataFrame:
    modelo = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Brand#"), (F.col("l_partkey") % 5 + 1).cast("string"))).otherwise("x")
    none = F.lit(None).cast("double").alias("ltopo")
    li = read(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")).agg(F.min("l_partkey").alias("of"), F.min("l_suppkey").alias("s"), F.min(modelo).alias("modelo"), F.min("l_quantity").alias("q"), F.min("l_linenumber").alias("n"))
    number = lambda c: F.lpad(c.cast("string"), 6, "0").alias("of")  # noqa: E731 -- six characters, as in the SQL, of longer keys the first
    rows = li.select("row_id", number(F.col("of")), (F.col("s") % 50 + 1).cast("string").alias("ov"), "modelo", F.concat(F.lit("c"), (F.col("s") % 3).cast("string")).alias("cliente"), (F.col("q") * 40).alias("comp"), (F.col("n") * 10).alias("lbase"), none)
    p, size = read(spark, d, "part"), F.col("p_size")
    entries = p.select(F.col("p_partkey").alias("entry_ord"), number(F.col("p_partkey") - F.col("p_partkey") % 3), size.cast("string").alias("ov"), F.concat_ws(" ", "p_brand", "p_type").alias("designacao"), F.concat(F.lit("C"), (size % 3).cast("string")).alias("cliente"), (size * 40).alias("comp"), size.alias("lbase"), none)
    return joins.lookup_chain(rows, entries)


@query(
    "j12_first_of_tiers",
    """WITH a AS (SELECT p_partkey AS key, 'exact' AS value FROM part WHERE p_partkey % 5 = 0), b AS (SELECT p_partkey AS key, p_brand AS value FROM part WHERE p_partkey % 2 = 0)
 SELECT p_partkey AS key, COALESCE(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 1 WHEN b.value IS NOT NULL THEN 2 END AS tier FROM part LEFT JOIN a ON a.key = p_partkey LEFT JOIN b ON b.key = p_partkey""",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_brand")
    return joins.first_of(p.select("key"), "key", p.where("key % 5 = 0").select("key", F.lit("exact").alias("value")), p.where("key % 2 = 0").select("key", F.col("p_brand").alias("value")))


@query(
    "j13_unique_containing",
    """WITH l AS (SELECT DISTINCT p_name AS label FROM part), n AS (SELECT split_part(p_name, ' ', 1) AS name, MIN(p_size % 3) AS code FROM part GROUP BY 1 UNION SELECT split_part(p_name, ' ', 2), MAX(p_size % 3) FROM part GROUP BY 1)
 SELECT label, MIN(code) AS code FROM l JOIN n ON (length(name) >= 3 AND contains(label, name)) OR (length(label) >= 3 AND contains(name, label)) GROUP BY label HAVING COUNT(DISTINCT code) = 1""",
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i)).alias("name")
    names = p.groupBy(word(0)).agg(F.min(F.col("p_size") % 3).alias("code")).union(p.groupBy(word(1)).agg(F.max(F.col("p_size") % 3).alias("code"))).distinct()
    return joins.unique_containing(p.select(F.col("p_name").alias("label")).distinct(), names)


@query(
    "j15_band_join",
    "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON abs(c_acctbal - s_acctbal) <= 25 AND c_nationkey = s_nationkey",
)
def j15(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"))
    s = read(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation"))
    return joins.band_join(c, s, "c_acctbal", "s_acctbal", 25.0, ["nation"]).select("c_custkey", "s_suppkey")


@query(
    "j16_grid_join",
    """SELECT c_custkey, p_partkey FROM customer JOIN part ON abs(floor(c_acctbal / 30) - floor(p_retailprice / 30)) <= 1 AND abs(floor(c_nationkey / 30) - floor(p_size / 30)) <= 1""",
)
def j16(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return joins.grid_join(c, read(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), [("c_acctbal", "p_retailprice"), ("c_nationkey", "p_size")], 30, ["p_partkey"]).select("c_custkey", "p_partkey")


@query(
    "j17_token_join",
    """WITH t AS (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS t FROM benchmark), u AS (SELECT item_id, t FROM t WHERE length(t) >= 5), k AS (SELECT t FROM u GROUP BY t HAVING COUNT(DISTINCT item_id) <= 50)
 SELECT c.conv_id * 1000 + c.turn AS row_id, u.item_id, COUNT(DISTINCT u.t) AS shared FROM (SELECT conv_id, turn, unnest(list_distinct(string_split(text, ' '))) AS t FROM conversations) c JOIN u ON u.t = c.t WHERE u.t IN (SELECT t FROM k) GROUP BY ALL""",
)
def j17(spark: SparkSession, d: str) -> DataFrame:
    left = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.split("text", " ").alias("_tokens"))
    return joins.token_join(left, read(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("_tokens")), "row_id", "item_id")


@query(
    "j18_top_like",
    f"""WITH a AS (SELECT DISTINCT p_name AS a FROM part), b AS (SELECT DISTINCT p_type || ' ' || split_part(p_name, ' ', 2) AS b FROM part),
 s AS (SELECT a, b, {LIKE.format(a="a", b="b")} AS score FROM a, b) SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM s WHERE score >= 20 QUALIFY place <= 3""",
)
def j18(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    known = p.select(F.concat_ws(" ", "p_type", F.get(F.split("p_name", " "), F.lit(1))).alias("b"))
    return joins.top_like(p.select(F.col("p_name").alias("a")), known, "a", "b", similarity.likeness, 3, 20)


@query(
    "j19_candidate_pool",
    f"WITH {FACT}, {PLAN} SELECT DISTINCT f.of AS of, p.plan_ord FROM (SELECT DISTINCT of, modelo, larg FROM fact) f JOIN plan p ON p.of = f.of OR (p.modelo = f.modelo AND p.larg = f.larg)",
)
def j19(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by any field, each once: a union of equi-joins in place of a join on either."""
    f, p = facts(spark, d).select("of", "modelo", "larg").distinct(), plan(spark, d)
    by_of = f.join(p.select("of", "plan_ord"), "of").select("of", "plan_ord")
    by_model = f.join(p.select("modelo", "larg", "plan_ord"), ["modelo", "larg"]).select("of", "plan_ord")
    return by_of.unionByName(by_model).dropDuplicates(["of", "plan_ord"])


@query(
    "j20_unmatched_cross",
    "WITH u AS (SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)) SELECT n_nationkey, r_regionkey FROM u, region",
)
def j20(spark: SparkSession, d: str) -> DataFrame:
    """Only rows without any candidate are held against everything; the other side is a fixed small dimension."""
    rest = read(spark, d, "nation").join(read(spark, d, "supplier").where("s_acctbal > 9000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti")
    return rest.select("n_nationkey").crossJoin(F.broadcast(read(spark, d, "region").select("r_regionkey")))


@query("j21_zip_rows", "SELECT a.conv_id, a.turn, a.role AS user_role, b.role AS next_role FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn")
def j21(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return joins.zip_rows(c.select("conv_id", "turn", F.col("role").alias("user_role")), c.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("role").alias("next_role")), ["conv_id", "turn"])


@query("j22_zip_padded", "SELECT COALESCE(a.conv_id, b.conv_id - 1) AS conv_id, COALESCE(a.turn, b.turn) AS turn, COALESCE(a.role, '') AS user_role, COALESCE(b.role, '') AS next_role FROM conversations a FULL JOIN conversations b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn")
def j22(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return joins.zip_rows(c.select("conv_id", "turn", F.col("role").alias("user_role")), c.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("role").alias("next_role")), ["conv_id", "turn"], padded=True)


@query("j24_status_changes", f"WITH {SHEET} SELECT COALESCE(a.status, '-') AS before, COALESCE(b.status, '-') AS after, COUNT(*) AS n FROM sheet a FULL JOIN sheet b ON b.sheet_id = a.sheet_id + 1 GROUP BY ALL")
def j24(spark: SparkSession, d: str) -> DataFrame:
    s = sheets(spark, d)
    return joins.status_changes(s, s.withColumn("sheet_id", F.col("sheet_id") - 1), ["sheet_id"])


@query("j2_left_having", f"WITH {SHEET}, {EDIT} SELECT sheet_id, COUNT(id) AS n FROM sheet LEFT JOIN edit USING (sheet_id) GROUP BY sheet_id HAVING COUNT(id) >= 60")
def j2(spark: SparkSession, d: str) -> DataFrame:
    return sheets(spark, d).join(edits(spark, d), "sheet_id", "left").groupBy("sheet_id").agg(F.count("id").alias("n")).where("n >= 60")


@query("j5_semi", f"WITH {FACT} SELECT sheet_id, status FROM sheet WHERE sheet_id IN (SELECT sheet_id FROM fact WHERE of < 20)")
def j5(spark: SparkSession, d: str) -> DataFrame:
    return sheets(spark, d).join(facts(spark, d).where("of < 20"), "sheet_id", "left_semi").select("sheet_id", "status")


@query("j7_survival", f"WITH {SHEET}, {EDIT} SELECT sheet_id, CAST(sheet_id NOT IN (SELECT sheet_id FROM edit WHERE source = 'human') AS INTEGER) AS survived FROM sheet")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return joins.survival(sheets(spark, d).select("sheet_id"), edits(spark, d).where("source = 'human'"), ["sheet_id"])


@query("j8_seed_if_absent", "SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey < 20 UNION ALL SELECT r_regionkey + 18, r_name FROM region WHERE r_regionkey + 18 NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def j8(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return joins.replaced_by(n, read(spark, d, "region").select((F.col("r_regionkey") + 18).alias("key"), F.col("r_name").alias("name")), "key")


@query("u2_new_wins", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def u2(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return joins.replaced_by(c.where("c_custkey % 3 = 0").select("c_custkey", "c_mktsegment"), c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("old").alias("c_mktsegment")), "c_custkey")


@query("u4_joint_support", f"WITH {FACT}, a AS (SELECT sheet_id, list_distinct(list(of)) AS s FROM fact GROUP BY 1) SELECT x.sheet_id, len(list_intersect(x.s, y.s)) AS common FROM a x JOIN a y ON y.sheet_id = x.sheet_id + 1 WHERE len(list_intersect(x.s, y.s)) > 0")
def u4(spark: SparkSession, d: str) -> DataFrame:
    a = facts(spark, d).groupBy("sheet_id").agg(F.collect_set("of").alias("s"))
    b = a.select((F.col("sheet_id") - 1).alias("sheet_id"), F.col("s").alias("t"))
    return a.join(b, "sheet_id").select("sheet_id", F.size(F.array_intersect("s", "t")).alias("common")).where("common > 0")


@query("u5_unseen", f"WITH {FACT} SELECT p_partkey AS of FROM part WHERE p_partkey NOT IN (SELECT of FROM fact WHERE ship_date < DATE '1995-02-01')")
def u5(spark: SparkSession, d: str) -> DataFrame:
    seen = facts(spark, d).where("ship_date < date '1995-02-01'").select("of").distinct()
    return read(spark, d, "part").select(F.col("p_partkey").alias("of")).join(seen, "of", "left_anti")


@query("p4_in_list_empty", "SELECT n_nationkey FROM nation WHERE FALSE")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return joins.filtered(read(spark, d, "nation"), n_name=[]).select("n_nationkey")


@query("p4_in_list", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)")
def p4_list(spark: SparkSession, d: str) -> DataFrame:
    return joins.filtered(read(spark, d, "nation"), n_regionkey=[1, 3], n_name=None).select("n_nationkey")


@query("p5_either_column", "SELECT p_partkey FROM part WHERE upper(p_brand) = upper('brand#3') OR upper(p_type) = upper('promo')")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where((F.upper("p_brand") == F.upper(F.lit("brand#3"))) | (F.upper("p_type") == F.upper(F.lit("promo")))).select("p_partkey")


@query("p14_paths", f"WITH {EDIT} SELECT regexp_replace(field_path, '\\[[0-9]+\\]', '[]', 'g') AS path, string_split(field_path, '.')[-1] AS leaf, CAST(regexp_extract(field_path, '^rows\\[([0-9]+)\\]', 1) AS INTEGER) AS row, COUNT(*) AS n FROM edit GROUP BY ALL")
def p14(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("field_path")
    return edits(spark, d).groupBy(text.general_path(path).alias("path"), text.leaf(path).alias("leaf"), text.row_of(path).alias("row")).agg(F.count("*").alias("n"))


@query("p19_hash_split", "SELECT c_custkey, (list_reduce([CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT) for c in string_split(sha256(CAST(c_custkey AS VARCHAR)), '')], lambda a, b: (a * 16 + b) % 100)) < 20 AS blind FROM customer")
def p19(spark: SparkSession, d: str) -> DataFrame:
    """The whole digest modulo 100, digit by digit."""
    digits = F.split(F.sha2(F.col("c_custkey").cast("string"), 256), "")
    rest = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, c: (a * 16 + F.conv(c, 16, 10).cast("bigint")) % 100)
    return read(spark, d, "customer").select("c_custkey", (rest < 20).alias("blind"))


@query("p20_stratified_sample", f"WITH {SHEET} SELECT sheet_id, setor FROM sheet QUALIFY row_number() OVER (PARTITION BY setor ORDER BY sheet_id) <= 4")
def p20(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = sheets(spark, d)
    return s.withColumn("n", F.row_number().over(Window.partitionBy("setor").orderBy("sheet_id"))).where("n <= 4").select("sheet_id", "setor")


@query("t2_paging", f"WITH {SHEET} SELECT sheet_id, status FROM sheet ORDER BY sheet_id DESC LIMIT 50 OFFSET 100")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return sheets(spark, d).orderBy(F.desc("sheet_id")).offset(100).limit(50).select("sheet_id", "status")


@query("x_text_functions", """SELECT n_nationkey, upper(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS compact, trim(regexp_replace(upper(n_name), '[\\s\\-_/.]+', ' ', 'g')) AS label,
 regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, replace(upper(n_name), 'O', '0') AS zero_key, lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS of FROM nation""")
def x_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_name")
    return read(spark, d, "nation").select("n_nationkey", text.compact(n).alias("compact"), text.label(n).alias("label"), text.slug(n).alias("slug"), text.zero_key(n).alias("zero_key"), text.order_number(F.col("n_nationkey").cast("string")).alias("of"))
