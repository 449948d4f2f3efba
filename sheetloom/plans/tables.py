"""The engine's concepts over the star-schema tables: sheets, their rows as facts, plan, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Today" is an argument everywhere; this is the one the registered queries use.
AS_OF = "1998-06-30"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "extracted").otherwise("pending")
    return o.select(
        F.col("o_orderkey").alias("sheet_id"),
        status.alias("status"),
        F.to_date("o_orderdate").alias("iso_date"),
        F.col("o_orderpriority").alias("setor"),
        (F.lit(1) + F.col("o_orderkey") % 12).cast("double").alias("hours"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_totalprice").alias("total"),
    )


#: Which table a fact's column comes from.
SOURCES = {"operador": "supplier", "modelo": "part", "larg": "part", "cliente": "customer", "segmento": "customer", "status": "orders", "iso_date": "orders", "setor": "orders", "hours": "orders"}


def facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """A row for each line of a sheet. The dimension tables are joined by key; Spark broadcasts them while they are small.
    With columns given, only the tables that have them are joined: every line has its partner in all of them."""
    needed = {SOURCES[c] for c in columns if c in SOURCES} if columns else set(SOURCES.values())
    row = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sheet_id"),
        F.col("l_linenumber").alias("row_index"),
        F.col("l_partkey").alias("of"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_quantity").cast("bigint").alias("qtd"),
        F.col("l_extendedprice").alias("price"),
        F.to_date("l_shipdate").alias("ship_date"),
        F.col("l_returnflag").alias("flag"),
    )
    operador = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("operador"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("of"), F.concat_ws(" ", "p_brand", "p_type").alias("modelo"), F.col("p_size").alias("larg"))
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("cliente"), F.col("c_mktsegment").alias("segmento"))
    out = row
    if needed & {"orders", "customer"}:
        head = sheets(spark, sf_dir)
        out = row.join((head.join(customer, "custkey") if "customer" in needed else head).drop("custkey", "total"), "sheet_id")
    if "supplier" in needed:
        out = out.join(operador, "suppkey")
    if "part" in needed:
        out = out.join(part, "of")
    return out.select(*columns) if columns else out


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan lines: siblings share a model; quanttrp is null for every 11th, every 7th is closed."""
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("plan_ord"),
        key.alias("of"),
        F.concat_ws(" ", "p_brand", "p_type").alias("modelo"),
        F.when(key % 11 != 0, (F.col("p_size") * 3).cast("double")).alias("quanttrp"),
        (key % 7 == 0).alias("closed"),
        (F.col("p_size") % 5).cast("double").alias("produced"),
        F.col("p_size").cast("double").alias("larg"),
        F.col("p_retailprice").alias("comp"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log: the source follows from the event's type, the path from its props."""
    e = read(spark, sf_dir, "events")
    source = F.when(F.col("event_type").isin("click", "view", "error"), "human").when(F.col("event_type") == "purchase", "system").otherwise("wizard")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("sheet_id"),
        F.concat(F.lit("rows["), (k % 5).cast("string"), F.lit("]."), F.element_at(F.array(*map(F.lit, ("of", "cliente", "modelo", "qtd"))), k % 4 + 1)).alias("field_path"),
        k.cast("string").alias("new_value"),
        (k % 10).cast("string").alias("old_value"),
        F.col("ts").alias("edited_at"),
        source.alias("source"),
        F.col("value").alias("value"),
    )


#: The same in SQL, to begin an oracle with.
SHEET = """sheet AS (SELECT o_orderkey AS sheet_id, CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'extracted' ELSE 'pending' END AS status,
 CAST(o_orderdate AS DATE) AS iso_date, o_orderpriority AS setor, CAST(1 + o_orderkey % 12 AS DOUBLE) AS hours, o_custkey AS custkey, o_totalprice AS total FROM orders)"""
FACT = f"""{SHEET}, fact AS (SELECT l_orderkey AS sheet_id, l_linenumber AS row_index, l_partkey AS of, l_suppkey AS suppkey, CAST(l_quantity AS BIGINT) AS qtd, l_extendedprice AS price,
 CAST(l_shipdate AS DATE) AS ship_date, l_returnflag AS flag, s.status, s.iso_date, s.setor, s.hours, c_name AS cliente, c_mktsegment AS segmento, s_name AS operador,
 p_brand || ' ' || p_type AS modelo, p_size AS larg
 FROM lineitem JOIN sheet s ON s.sheet_id = l_orderkey JOIN customer ON c_custkey = s.custkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"""
PLAN = """plan AS (SELECT p_partkey AS plan_ord, p_partkey AS of, p_brand || ' ' || p_type AS modelo, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size * 3 AS DOUBLE) END AS quanttrp,
 p_partkey % 7 = 0 AS closed, CAST(p_size % 5 AS DOUBLE) AS produced, CAST(p_size AS DOUBLE) AS larg, p_retailprice AS comp FROM part)"""
EDIT = """edit AS (SELECT event_id AS id, user_id AS sheet_id, 'rows[' || (k % 5) || '].' || (['of', 'cliente', 'modelo', 'qtd'])[k % 4 + 1] AS field_path, CAST(k AS VARCHAR) AS new_value,
 CAST(k % 10 AS VARCHAR) AS old_value, ts AS edited_at, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'human' WHEN event_type = 'purchase' THEN 'system' ELSE 'wizard' END AS source, value
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
#: Likeness by its definition: case aside; equal, one within the other, nothing in common, lengths too far apart, edits.
LIKE = "CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN upper({a}) = upper({b}) THEN 100.0::DOUBLE WHEN contains(upper({a}), upper({b})) OR contains(upper({b}), upper({a})) THEN 80.0::DOUBLE WHEN (length({a}) > 3 AND length({b}) > 3 AND len(list_intersect(string_split(upper({a}), ''), string_split(upper({b}), ''))) = 0) OR abs(length({a}) - length({b})) > 5 THEN 0.0::DOUBLE WHEN levenshtein(upper({a}), upper({b})) >= GREATEST(length({a}), length({b})) THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * (1 - levenshtein(upper({a}), upper({b})) / GREATEST(length({a}), length({b}))) END"
