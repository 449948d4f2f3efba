"""Taking over reference tables: no content twice, nothing older than what is there, and back to the last good one on failure."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables


def digest(df: DataFrame) -> str:
    """A table's content whatever its rows' order: how many rows, and the sum of their hashes."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")), F.lit(0))).collect()[0]
    return f"{n}:{total}"


@dataclass
class Imported:
    """What became of an import: taken, same (content), older, empty or mismatch; and the digest that is there now."""

    outcome: str
    digest: str | None


def imported(spark: SparkSession, df: DataFrame, path: str, stamp: str, recent: Callable[[DataFrame], object] | None = None) -> Imported:
    """Takes df over as a snapshot under path, unless it has no rows, the content that is there already, or (recent: a
    function from a table to what tells its age) is older. What was written is read again; if it isn't what was to be
    written, the folder is set aside, and the snapshot before it stays the latest."""
    now = tables.latest(spark, path)
    held = digest(now) if now is not None else None
    new = digest(df)
    if new.startswith("0:"):
        return Imported("empty", held)
    if new == held:
        return Imported("same", held)
    if now is not None and recent is not None and (a := recent(df)) is not None and (b := recent(now)) is not None and a < b:
        return Imported("older", held)
    at = tables.snapshot(df, path, stamp)
    if digest(spark.read.parquet(at)) != new:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, False)
        return Imported("mismatch", held)
    return Imported("taken", new)


@dataclass
class Watched:
    """References that are read again when their files change. A reading that fails leaves the last good one in use; `failed`
    says why. modified tells when the files last changed; with `fresh_for` it is asked at most so often (seconds)."""

    read: Callable[[], DataFrame]
    modified: Callable[[], object]
    fresh_for: float = 30.0
    clock: Callable[[], float] = time.monotonic
    failed: str | None = None
    _held: DataFrame | None = field(default=None, init=False)
    _seen: object = field(default=None, init=False)
    _asked: float | None = field(default=None, init=False)

    def get(self) -> DataFrame | None:
        now = self.clock()
        if self._asked is not None and now - self._asked < self.fresh_for:
            return self._held
        self._asked = now
        seen = self.modified()
        if self._held is not None and seen == self._seen:
            return self._held
        try:
            found = self.read().persist()
            found.count()  # a table that can't be read fails here
        except Exception as e:  # the last good one stays
            self.failed = f"{type(e).__name__}: {e}"[:300]
            return self._held
        old, self._held, self._seen, self.failed = self._held, found, seen, None
        if old is not None:
            old.unpersist()
        return self._held


def modified(spark: SparkSession, path: str) -> int:
    """When a folder's files last changed, in milliseconds; 0 if there are none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max((f.getModificationTime() for f in fs.listStatus(place)), default=0) if fs.exists(place) else 0


class Kept:
    """Results by name and context, for some seconds: one that is asked for again with the same context is not made anew."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock = seconds, clock
        self._held: dict[str, tuple[object, float, DataFrame]] = {}

    def get(self, name: str, context: object, make: Callable[[], DataFrame]) -> DataFrame:
        held = self._held.get(name)
        if held and held[0] == context and self.clock() - held[1] < self.seconds:
            return held[2]
        if held:
            held[2].unpersist()
        made = make().persist()
        self._held[name] = (context, self.clock(), made)
        return made
