"""Reading and writing: reference tables, documents, logs; exports that are safe to open and to run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import neutral

#: Column names of reference tables, lower case, and what they are called here.
PLAN_COLUMNS = {"of": "of", "ov": "ov", "cliente": "cliente", "designacao": "designacao", "comp": "comp", "larg": "larg", "esp": "esp", "lbase": "lbase", "ltopo": "ltopo", "quanttrp": "quanttrp", "fechado": "fechado"}


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON documents, each file one, with the file's name; files that can't be read are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.input_file_name())


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; corrupt ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sheet_rows(spark: SparkSession, path: str, header: bool = True, sep: str = ";") -> DataFrame:
    """A spreadsheet's exports as texts, columns in lower case, with each row's file and its place there from 1 (ord). The
    files are read whole, one to a task, for a split has no line numbers; such exports have some ten thousand rows."""
    names = [c.strip().lower() for c in spark.read.option("header", header).option("sep", sep).csv(path).columns]
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r", ""), "\n")).alias("ord", "_line"))
    lines = lines.where((F.trim("_line") != "") & (F.lit(not header) | (F.col("ord") > 0)))
    read = F.from_csv("_line", ", ".join(f"`{i}` string" for i in range(len(names))), {"sep": sep, "mode": "PERMISSIVE"})
    return lines.withColumn("_r", read).select(*[F.col(f"_r.`{i}`").alias(n) for i, n in enumerate(names)], "file", (F.col("ord") + (0 if header else 1)).cast("long").alias("ord"))


def until_blank(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The rows before the first one whose key is blank."""
    end = rows.where(F.col(key).isNull() | (F.trim(key) == "")).agg(F.min(order).alias("_end"))
    return rows.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (F.col(order) < F.col("_end"))).drop("_end")  # one row


def plan(rows: DataFrame, first: str = "quanttrp", last: str = "esp") -> DataFrame:
    """A plan by its header: known columns by name; every column between two of them is a phase, kept in order."""
    names = rows.columns
    number = lambda c: F.replace(F.trim(F.col(f"`{c}`")), F.lit(","), F.lit(".")).try_cast("double")
    phases = names[names.index(first) + 1 : names.index(last)] if first in names and last in names else []
    numeric = {"comp", "larg", "esp", "lbase", "ltopo", "quanttrp"}
    known = [(number(c) if to in numeric else F.trim(F.col(c))).alias(to) for c, to in PLAN_COLUMNS.items() if c in names]
    held = F.array(*[F.struct(F.lit(p).alias("phase"), number(p).alias("qty")) for p in phases]) if phases else F.array().cast("array<struct<phase: string, qty: double>>")
    out = rows.where(F.trim("of").rlike("^[0-9]+$")) if "of" in names else rows
    return out.select(F.col("ord").alias("plan_ord"), *known, held.alias("fases"))


def keyed(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row for each key, the first in an order."""
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_n = 1").drop("_n").withColumnRenamed("_key", "key")


def aliased(stock: DataFrame, key: str, prefix: str = "M") -> DataFrame:
    """Stock under its lot's name and under the name with or without a prefix, which never takes a real lot's place."""
    other = F.when(F.col(key).startswith(prefix), F.substring(key, len(prefix) + 1, 10_000)).otherwise(F.concat(F.lit(prefix), F.col(key)))
    alias = stock.withColumn(key, other).join(stock.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return stock.withColumn("aliased", F.lit(False)).unionByName(alias.withColumn("aliased", F.lit(True)))


def by_priority(tables: list[DataFrame], key: str, *order: Column) -> DataFrame:
    """One row for each key of several tables: that of the first table that has it, within a table the first in an order."""
    whole = None
    for i, t in enumerate(tables):
        t = t.withColumn("_prio", F.lit(i))
        whole = t if whole is None else whole.unionByName(t)
    return whole.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_prio", *order))).where("_n = 1").drop("_n", "_prio")


def newest_files(spark: SparkSession, path: str, kind: Column) -> DataFrame:
    """(kind, path, modificationTime, length): of a folder's files, classified by an expression over path and content,
    the newest of each kind."""
    f = spark.read.format("binaryFile").load(path).withColumn("kind", kind).where("kind is not null")
    return f.groupBy("kind").agg(F.max_by(F.struct("path", "modificationTime", "length"), F.struct("modificationTime", "length", "path")).alias("f")).select("kind", "f.*")


def stats(rows: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and the greatest key: what an import is judged by."""
    return rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"), F.max(key).alias("last_key"))


def safe(df: DataFrame, sheet: bool = False) -> DataFrame:
    """df with no text that a spreadsheet would take for a formula."""
    return df.withColumns({f.name: neutral(F.col(f"`{f.name}`"), sheet) for f in df.schema.fields if f.dataType.simpleString() == "string"})


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    safe(df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def three_blocks(header: DataFrame, rows: DataFrame, footer: DataFrame, key: str, sep: str = ";") -> DataFrame:
    """(key, block, place, line): header, rows and footer of each document as lines of one text, in order."""
    line = lambda df, *skip: F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c not in skip])
    a = header.select(key, F.lit(0).alias("block"), F.lit(0).alias("place"), line(header, key).alias("line"))
    b = rows.select(key, F.lit(1).alias("block"), F.col("row_index").alias("place"), line(rows, key, "row_index").alias("line"))
    c = footer.select(key, F.lit(2).alias("block"), F.lit(0).alias("place"), line(footer, key).alias("line"))
    return a.unionByName(b).unionByName(c)


def snapshot(df: DataFrame, path: str, stamp: str) -> str:
    """A copy in a folder of its own, <path>/<stamp>; what was there under another stamp stays. Spark marks a folder that is
    complete (_SUCCESS), and `latest` reads none but such, so that a copy that fails takes no earlier one's place."""
    at = f"{path.rstrip('/')}/{stamp}"
    df.write.mode("errorifexists").parquet(at)
    return at


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete snapshot, by its stamp; None if there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    done = [f.getPath() for f in fs.listStatus(place) if f.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    newest = max((p.toString() for p in done), key=lambda p: p.rsplit("/", 1)[1], default=None)
    return spark.read.parquet(newest) if newest else None


def write_json(df: DataFrame, path: str, stamp: str) -> str:
    """As snapshot, a file of JSON lines for each part."""
    at = f"{path.rstrip('/')}/{stamp}"
    df.write.mode("errorifexists").json(at)
    return at


def read_blocks(spark: SparkSession, path: str, sep: str | None = ";") -> DataFrame:
    """(file, block, place, cells): a text file's lines, blocks parted by blank lines; a file without blank lines is one flat
    block. Without sep each file's own counts: a semicolon if its first line has more of them than commas, else a comma."""
    t = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    blocks = t.select("file", F.posexplode(F.split(F.trim(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r", "")), r"\n\s*\n")).alias("block", "b"))
    if sep is not None:
        blocks = blocks.withColumn("sep", F.lit(sep))
    else:
        first = blocks.where("block = 0").select("file", F.get(F.split("b", "\n"), F.lit(0)).alias("_l"))
        count = lambda c: F.length("_l") - F.length(F.replace("_l", F.lit(c), F.lit("")))
        blocks = blocks.join(first.select("file", F.when(count(";") > count(","), ";").otherwise(",").alias("sep")), "file")
    lines = blocks.select("file", "block", "sep", F.posexplode(F.split("b", "\n")).alias("place", "line"))
    return lines.select("file", "block", "place", F.split("line", F.col("sep")).alias("cells"))
