"""Changes to all sheets in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import editing
from .registry import query
from .tables import EDIT, FACT, SHEET, edits, facts, read, sheets

REV = f"{SHEET}, rev AS (SELECT sheet_id, status, custkey % 3 AS revision, custkey FROM sheet)"
ASKED = """asked AS (SELECT l_orderkey AS sheet_id, CASE WHEN l_orderkey % 4 <> 0 THEN l_orderkey % 3 END AS expected_revision, l_linenumber AS seq, 'rows[' || (l_linenumber % 3) || '].of' AS path, CAST(MIN(l_partkey) AS VARCHAR) AS new_value FROM lineitem GROUP BY l_orderkey, l_linenumber),
 cell AS (SELECT sheet_id, 'rows[1].of' AS path, 'old' || custkey % 5 AS value FROM rev),
 audit AS (SELECT a.*, CASE WHEN status IS NULL THEN 'missing' WHEN status = 'validated' THEN 'validated' WHEN expected_revision IS NOT NULL AND expected_revision <> revision THEN 'stale' END AS refused, COALESCE(lag(new_value) OVER (PARTITION BY a.sheet_id, a.path ORDER BY seq), c.value, '') AS was FROM asked a LEFT JOIN rev USING (sheet_id) LEFT JOIN cell c USING (sheet_id, path))"""


def revisions(spark: SparkSession, d: str) -> DataFrame:
    return sheets(spark, d).withColumn("revision", F.col("custkey") % 3)


def asked(spark: SparkSession, d: str) -> DataFrame:
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    g = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").cast("string").alias("new_value"))
    return g.select(key.alias("sheet_id"), F.when(key % 4 != 0, key % 3).alias("expected_revision"), line.alias("seq"), F.concat(F.lit("rows["), (line % 3).cast("string"), F.lit("].of")).alias("path"), "new_value")


def cells(spark: SparkSession, d: str) -> DataFrame:
    return sheets(spark, d).select("sheet_id", F.lit("rows[1].of").alias("path"), F.concat(F.lit("old"), (F.col("custkey") % 5).cast("string")).alias("value"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    return editing.applied_edits(revisions(spark, d).select("sheet_id", "status", "revision"), cells(spark, d), asked(spark, d))


@query("k1_inserted", f"WITH {REV}, n AS (SELECT sheet_id, status, revision FROM rev UNION ALL SELECT (SELECT MAX(sheet_id) FROM rev) + c_custkey - (SELECT MIN(c_custkey) FROM customer) + 1, 'pending', 0 FROM customer) SELECT status, COUNT(*) AS n, MAX(sheet_id) AS last_id, CAST(SUM(revision) AS BIGINT) AS revisions FROM n GROUP BY status")
def k1(spark: SparkSession, d: str) -> DataFrame:
    known = revisions(spark, d).select("sheet_id", "status", "revision")
    c = read(spark, d, "customer")
    new = c.crossJoin(F.broadcast(c.agg(F.min("c_custkey").alias("least")))).select((F.col("c_custkey") - F.col("least") + 1).alias("ord"))
    return editing.inserted(known, new, "ord").groupBy("status").agg(F.count("*").alias("n"), F.max("sheet_id").alias("last_id"), F.sum("revision").alias("revisions"))


@query("k4_audit", f"WITH {REV}, {ASKED} SELECT sheet_id, seq, path, new_value, refused, CASE WHEN refused IS NULL THEN was END AS old_value FROM audit")
def k4(spark: SparkSession, d: str) -> DataFrame:
    return audit(spark, d).select("sheet_id", "seq", "path", "new_value", "refused", "old_value")


@query("k4_cells_after", f"WITH {REV}, {ASKED}, l AS (SELECT sheet_id, path, arg_max(new_value, seq) AS v FROM audit WHERE refused IS NULL GROUP BY ALL) SELECT sheet_id, path, COALESCE(v, value) AS value FROM cell FULL JOIN l USING (sheet_id, path)")
def k4_cells(spark: SparkSession, d: str) -> DataFrame:
    return editing.cells_after(cells(spark, d), audit(spark, d))


@query("r5_revisions", f"WITH {REV}, {ASKED} SELECT sheet_id, revision + CAST(sheet_id IN (SELECT sheet_id FROM audit WHERE refused IS NULL) AS INTEGER) AS revision FROM rev")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return editing.revised(revisions(spark, d), audit(spark, d)).select("sheet_id", "revision")


@query("r5_protected_after", f"WITH {SHEET}, {EDIT}, m AS (SELECT s.sheet_id, COALESCE(MAX(id), 0) AS seq FROM sheet s LEFT JOIN edit e ON e.sheet_id = s.sheet_id AND source = 'system' GROUP BY 1) SELECT DISTINCT sheet_id, field_path FROM edit JOIN m USING (sheet_id) WHERE source IN ('human', 'wizard') AND id > seq")
def r5_protected(spark: SparkSession, d: str) -> DataFrame:
    e = edits(spark, d)
    return editing.protected_after(e, editing.marks(e.where("source = 'system'"), sheets(spark, d)))


ROWS = "line AS (SELECT l_orderkey AS sheet_id, l_linenumber || ':' || l_partkey AS cell, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem), n AS (SELECT sheet_id, COUNT(*) AS n FROM line GROUP BY 1)"


def with_rows(spark: SparkSession, d: str) -> DataFrame:
    held = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    rows = F.transform("r", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    return sheets(spark, d).join(held.select("sheet_id", rows.alias("rows")), "sheet_id").select("sheet_id", "status", "rows", (F.col("custkey") % 4).alias("at"))


@query("z11_row_removed", f"WITH {SHEET}, {ROWS}, s AS (SELECT sheet_id, status, custkey % 4 AS pos, n FROM sheet JOIN n USING (sheet_id)), o AS (SELECT *, CASE WHEN status = 'validated' THEN 'validated' WHEN pos >= n THEN 'out_of_range' ELSE 'removed' END AS outcome FROM s) SELECT o.sheet_id, outcome, CASE WHEN outcome = 'removed' THEN cell END AS removed, n - CAST(outcome = 'removed' AS INTEGER) AS n_rows FROM o LEFT JOIN line ON line.sheet_id = o.sheet_id AND i = pos")
def z11_removed(spark: SparkSession, d: str) -> DataFrame:
    return editing.row_removed(with_rows(spark, d), "at").select("sheet_id", "outcome", "removed", F.size("rows").alias("n_rows"))


@query("z11_row_added", f"WITH {SHEET}, {ROWS} SELECT sheet_id, CASE WHEN status = 'validated' THEN 'validated' ELSE 'added' END AS outcome, CASE WHEN status <> 'validated' THEN 'rows[' || n || ']' END AS path, n + CAST(status <> 'validated' AS INTEGER) AS n_rows FROM sheet JOIN n USING (sheet_id)")
def z11_added(spark: SparkSession, d: str) -> DataFrame:
    return editing.row_added(with_rows(spark, d)).select("sheet_id", "outcome", "path", F.size("rows").alias("n_rows"))


@query("z12_validated", f"WITH {REV} SELECT sheet_id, 'OP ' || custkey % 10 AS operador, CASE WHEN status = 'validated' THEN 'already' ELSE 'validated' END AS outcome, 'validated' AS status, revision + CAST(status <> 'validated' AS INTEGER) AS revision FROM rev")
def z12(spark: SparkSession, d: str) -> DataFrame:
    return editing.validated(revisions(spark, d), chosen(spark, d))


def chosen(spark: SparkSession, d: str) -> DataFrame:
    return sheets(spark, d).select("sheet_id", F.concat(F.lit("OP "), (F.col("custkey") % 10).cast("string")).alias("operador"))


@query("z12_restamped", f"WITH {FACT} SELECT CASE WHEN f.status = 'validated' THEN f.operador ELSE 'OP ' || s.custkey % 10 END AS operador, COUNT(*) AS n, CAST(SUM(qtd) AS BIGINT) AS qtd FROM fact f JOIN sheet s USING (sheet_id) GROUP BY 1")
def z12_facts(spark: SparkSession, d: str) -> DataFrame:
    f = editing.restamped(facts(spark, d), editing.validated(revisions(spark, d), chosen(spark, d)))
    return f.where("status = 'validated'").groupBy("operador").agg(F.count("*").alias("n"), F.sum("qtd").alias("qtd"))


DATES = ("2026-07-03", "2026-02-30", "3-7-2026", "2031-01-01", "2025-01-15", "")


@query(
    "z13_dates_corrected",
    f"""WITH {REV}, a AS (SELECT sheet_id, status, revision, ({list(DATES)})[sheet_id % 6 + 1] AS new, sheet_id % 2 AS expected, CASE WHEN custkey % 50 = 0 THEN repeat('x', 600) WHEN custkey % 7 = 0 THEN ' wrong year ' END AS reason, CASE WHEN custkey % 4 = 0 THEN '15-01-2025' ELSE '01-01-2024' END AS old FROM rev),
 o AS (SELECT *, TRY_CAST(new AS DATE) AS day, CASE WHEN NOT regexp_matches(new, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR TRY_CAST(new AS DATE) IS NULL THEN 'not_a_date' WHEN TRY_CAST(new AS DATE) NOT BETWEEN DATE '2024-01-01' AND DATE '2030-12-31' THEN 'out_of_range' WHEN length(trim(reason)) > 500 THEN 'long_reason' WHEN status <> 'validated' THEN 'not_validated' WHEN expected <> revision THEN 'stale' WHEN old = strftime(TRY_CAST(new AS DATE), '%d-%m-%Y') THEN 'no_change' ELSE 'corrected' END AS outcome FROM a)
 SELECT sheet_id, outcome, CASE WHEN outcome = 'corrected' THEN old END AS old_date, CASE WHEN outcome = 'corrected' THEN strftime(day, '%d-%m-%Y') END AS date, CASE WHEN outcome = 'corrected' THEN revision + 1 END AS revision, CASE WHEN outcome = 'corrected' THEN trim(reason) END AS reason FROM o""",
)
def z13(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("sheet_id"), F.col("custkey")
    s = revisions(spark, d).withColumn("old_date", F.when(c % 4 == 0, "15-01-2025").otherwise("01-01-2024"))
    new = F.get(F.array(*map(F.lit, DATES)), (k % 6).cast("int"))
    reason = F.when(c % 50 == 0, F.repeat(F.lit("x"), 600)).when(c % 7 == 0, " wrong year ")
    return editing.corrected_date(s, s.select("sheet_id", new.alias("new_date"), (k % 2).alias("expected_revision"), reason.alias("reason")))


@query("z27_aliased", "WITH a AS (SELECT DISTINCT upper(split_part(p_type, ' ', 1)) AS f, 'X ' || split_part(p_type, ' ', 1) AS t FROM part WHERE p_type LIKE 'S%') SELECT COALESCE(t, p_brand) AS value, t IS NOT NULL AS changed, COUNT(*) AS n FROM (SELECT CASE WHEN p_size % 2 = 0 THEN ' ' || lower(split_part(p_type, ' ', 1)) ELSE p_brand END AS p_brand FROM part) LEFT JOIN a ON f = upper(trim(p_brand)) GROUP BY ALL")
def z27(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    word = F.get(F.split("p_type", " "), F.lit(0))
    proposals = p.where("p_type like 'S%'").select(word.alias("from"), F.concat(F.lit(" X "), word).alias("to"))
    rows = p.select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.lower(word))).otherwise(F.col("p_brand")).alias("value"))
    return editing.aliased_values(rows, "value", proposals).groupBy("value", "changed").agg(F.count("*").alias("n"))


KINDS = ("cliente_alias", "modelo_alias", "confusion_pair", "observed_value", "case_rule", "other")


@query("l24_risk", f"WITH p AS (SELECT p_partkey AS k, ({list(KINDS)})[p_partkey % 6 + 1] AS kind, CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE 'none' END AS t, p_size % 3 = 0 AS conflict FROM part), v AS (SELECT DISTINCT p_brand AS v FROM part) SELECT k, CASE WHEN kind = 'observed_value' THEN 'low' WHEN kind = 'case_rule' AND NOT conflict THEN 'low' WHEN kind = 'cliente_alias' AND upper(t) IN (SELECT upper(v) FROM v) THEN 'low' ELSE 'behavior' END AS risk FROM p")
def l24(spark: SparkSession, d: str) -> DataFrame:
    p, k = read(spark, d, "part"), F.col("p_partkey")
    asked = p.select(k.alias("k"), F.get(F.array(*map(F.lit, KINDS)), (k % 6).cast("int")).alias("kind"), F.when(F.col("p_size") % 2 == 0, F.lower("p_brand")).otherwise("none").alias("to"), (F.col("p_size") % 3 == 0).alias("conflict"))
    return editing.classified(asked, p.select(F.lit("cliente_alias").alias("kind"), F.col("p_brand").alias("value"))).select("k", "risk")
