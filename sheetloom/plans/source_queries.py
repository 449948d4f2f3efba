"""Operators of sources and sinks over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as source
from .registry import query
from .tables import read


@query("s5_until_blank", "SELECT c_custkey FROM customer WHERE c_custkey < (SELECT MIN(c_custkey) FROM customer WHERE c_custkey % 100 = 99)")
def s5(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 100 != 99, F.col("c_name")).alias("key"))
    return source.until_blank(rows, "key", "c_custkey").select("c_custkey")


@query("s8_by_priority", "WITH t AS (SELECT n_nationkey % 7 AS key, n_name AS name, 0 AS prio, n_nationkey AS o FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_regionkey + 3, r_name, 1, r_regionkey FROM region) SELECT key, name FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY prio, o) = 1")
def s8(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").where("n_nationkey < 5").select((F.col("n_nationkey") % 7).alias("key"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("o"))
    r = read(spark, d, "region").select((F.col("r_regionkey") + 3).alias("key"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("o"))
    return source.by_priority([n, r], "key", F.col("o")).select("key", "name")


@query("s5_stock_aliases", "WITH s AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'M' ELSE '' END || (p_partkey % 40) AS lote, MIN(p_size) AS qtd FROM part GROUP BY 1), a AS (SELECT CASE WHEN lote LIKE 'M%' THEN substr(lote, 2) ELSE 'M' || lote END AS lote, qtd FROM s) SELECT lote, qtd, FALSE AS aliased FROM s UNION ALL SELECT lote, qtd, TRUE FROM a WHERE lote NOT IN (SELECT lote FROM s)")
def s5_stock(spark: SparkSession, d: str) -> DataFrame:
    lote = F.concat(F.when(F.col("p_partkey") % 2 == 0, "M").otherwise(""), (F.col("p_partkey") % 40).cast("string"))
    return source.aliased(read(spark, d, "part").groupBy(lote.alias("lote")).agg(F.min("p_size").alias("qtd")), "lote")


@query("s10_stats", "SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS n_keys, MAX(o_custkey) AS last_key FROM orders")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return source.stats(read(spark, d, "orders"), "o_custkey")


@query("k6_three_blocks", "SELECT o_orderkey AS sheet_id, 0 AS block, 0 AS place, o_orderpriority || ';' || o_orderstatus AS line FROM orders UNION ALL SELECT l_orderkey, 1, l_linenumber, l_partkey || ';' || l_suppkey FROM lineitem UNION ALL SELECT o_orderkey, 2, 0, CAST(o_custkey AS VARCHAR) FROM orders")
def k6(spark: SparkSession, d: str) -> DataFrame:
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    key = F.col("o_orderkey").alias("sheet_id")
    rows = li.select(F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("row_index"), "l_partkey", "l_suppkey")
    return source.three_blocks(o.select(key, "o_orderpriority", "o_orderstatus"), rows, o.select(key, "o_custkey"), "sheet_id")


@query("k12_safe_cells", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '''=' || n_name WHEN n_nationkey % 3 = 1 THEN '''-' || n_name ELSE n_name END AS cell FROM nation")
def k12(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    return source.safe(read(spark, d, "nation").select("n_nationkey", F.concat(F.when(k == 0, "=").when(k == 1, "-").otherwise(""), "n_name").alias("cell")))
