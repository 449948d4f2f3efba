"""Helpers that several operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset on a local master, as in a test, a temporary folder is set for the session; on a cluster that is an
    error, for a folder of one machine is no other's.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="sheetloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def released() -> None:
    """Gives back to the system the memory of what the driver no longer holds, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: what follows doesn't compute it anew,
    and a lost executor takes nothing of it along. The table is deleted when the driver's JVM ends."""
    spark = df.sparkSession
    # shuffle files go when the driver's objects for them do; without this, those of tables staged before would stay long
    released()
    spark.sparkContext._jvm.System.gc()
    at = f"{shared_dir(spark).rstrip('/')}/staged/{re.sub('[^a-z0-9_]', '_', label)}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).option("parquet.block.size", 16 << 20).parquet(at)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(at)


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt by a hash that no join deals by. Put between a sum over keys and a join by them, it makes the join deal
    both its sides itself; Spark then sees how much of each key there is, and splits a hot key's rows."""
    return df.repartition(F.xxhash64(*keys))


def flagged(rows: DataFrame, key: str, live: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """rows with `maybe`: whether their key, a hash, may be in live (one column of keys). By a bit table of fixed size, at most
    bits / 64 words, which is broadcast: true for all that are in live and, the more there are, for some others."""
    at = live.select(F.col(live.columns[0]).bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("_bits"))
    found = rows.withColumn("_at", F.col(key).bitwiseAND(F.lit(bits - 1))).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word", "left")
    return found.withColumn("maybe", F.expr("coalesce(shiftright(_bits, cast(_at % 64 as int)) & 1 = 1, false)")).drop("_at", "_word", "_bits")


def small_batches(spark: SparkSession) -> None:
    """Rows are read, and go to Python, in batches of a few megabytes, so that memory doesn't depend on how long texts are."""
    reachable()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, so that further columns of a table can't clash with those an operator adds."""
    small_batches(df.sparkSession)
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()))


def slices(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about limit characters together, at least one text each."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def groups(batches: Iterator, *keys: str) -> Iterator:
    """The whole groups of rows (as pandas frames) with equal keys; the rows come sorted by them, in Arrow batches."""
    import numpy as np
    import pandas as pd

    held = None
    for batch in batches:
        part = batch.to_pandas()
        if held is not None:
            part = pd.concat([held, part], ignore_index=True)
        if not len(part):
            continue
        change = np.zeros(len(part) - 1, bool)
        for k in keys:
            column = part[k].to_numpy()
            change |= column[1:] != column[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        for start, end in zip(edges, edges[1:], strict=False):
            yield part.iloc[start:end]
        held = part.iloc[edges[-1] :]
    if held is not None and len(held):
        yield held
