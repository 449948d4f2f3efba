"""A session with the settings the operators are written for."""

from __future__ import annotations

import os

from pyspark import SparkContext
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "sheetloom", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def reachable() -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder either was started in.
    On machines that don't have that folder the package comes by --py-files or with the image."""
    context = SparkContext._active_spark_context
    if context is not None:
        home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        held = context.environment.get("PYTHONPATH", "")
        if home not in held.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(p for p in (held, home) if p)
