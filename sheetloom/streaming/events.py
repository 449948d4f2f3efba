"""Streams: event folds, change logs, idempotent replacement by key, late rows, and queues of files.

State is kept by key and bounded by watermarks; every sink is idempotent, so that a batch that runs again after a
failure leaves the same rows. Batch counterparts are in operators.documents and operators.ordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Watermark for rows whose own date is late.
LATE = "30 days"


def files(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "json", at_once: int = 100) -> DataFrame:
    """A folder as a queue: new files become batches, each file once; the checkpoint recovers what was begun."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", at_once).load(path)


def folded(events: DataFrame) -> DataFrame:
    """The running state by kind: how many, the last version, and its payload; for output mode update or complete."""
    return events.groupBy("type").agg(F.count("*").alias("n"), F.max("version").alias("version"), F.max_by("payload", "version").alias("payload"))


def newest_edits(edits: DataFrame, sources: tuple[str, ...] = ("human", "wizard")) -> DataFrame:
    """The newest value of each path by the sources that count."""
    return edits.where(F.col("source").isin(*sources)).groupBy("sheet_id", "field_path").agg(F.max("id").alias("id"), F.max_by("new_value", "id").alias("value"))


def consumption(rows: DataFrame, cutoff: str, late: str = LATE) -> DataFrame:
    """Pieces by order and day; rows dated before the cutoff never count, rows later than the watermark are dropped."""
    r = rows.where(F.col("event_date") >= F.lit(cutoff).cast("timestamp")).withWatermark("event_date", late)
    return r.groupBy(F.window("event_date", "1 day").alias("day"), "of").agg(F.sum("qtd").alias("used")).select(F.col("day.start").alias("day"), "of", "used")


def replaced(path: str, key: str, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch's rows take the place of earlier ones with their keys. The table is split by a hash
    of the key; only the parts that a batch touches are written anew, into a folder named after the batch, and the
    newest folder of a part counts, so a batch that runs twice changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        b = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        old = current(spark, path, before=number)
        if old is not None:
            touched = b.select("part").distinct()
            kept = old.join(F.broadcast(touched), "part", "left_semi").join(b.select(key).distinct(), key, "left_anti")  # at most `parts` rows are broadcast
            b = b.unionByName(kept.drop("batch"), allowMissingColumns=True)
        b.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(path)

    return write


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table that `replaced` writes: of each part the rows of its newest batch."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    if before is not None:
        df = df.where(F.col("batch") < before)
    newest = df.groupBy("part").agg(F.max("batch").alias("batch"))
    return df.join(F.broadcast(newest), ["part", "batch"], "left_semi")  # a row for each part


def every(documents: int, job: Callable[[DataFrame], None], key: str = "sheet_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: runs a job whenever so many new documents have come together."""
    seen = {"n": 0}

    def write(batch: DataFrame, number: int) -> None:
        seen["n"] += batch.select(key).distinct().count()
        if seen["n"] >= documents:
            seen["n"] = 0
            job(batch)

    return write


def cusum_stream(outcomes: DataFrame, slack: float, limit: float) -> DataFrame:
    """Page's sum of each line as a stream: (line, n, s, alarm) after each batch, its state two numbers by line.

    outcomes: line, seq, z. Within a batch rows are taken in the order of seq.
    """
    import pandas as pd

    def step(key, frames, state):
        n, s, alarm = state.get if state.exists else (0, 0.0, -1)
        for frame in frames:
            for seq, z in frame.sort_values("seq")[["seq", "z"]].itertuples(index=False):
                n, s = n + 1, max(0.0, s + z - slack)
                if s > limit and alarm < 0:
                    alarm = int(seq)
        state.update((n, s, alarm))
        yield pd.DataFrame({"line": [key[0]], "n": [n], "s": [round(s, 9)], "alarm": [alarm]})

    return outcomes.groupBy("line").applyInPandasWithState(step, "line long, n long, s double, alarm long", "n long, s double, alarm long", "update", "NoTimeout")
