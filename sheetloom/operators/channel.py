"""What readings do to characters: aligned corrections counted, and the bits that each substitution costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import alignment

# Bounds of a substitution's cost in bits, and the weight of what is assumed beforehand.
LEAST, MOST, PSEUDO = 3.0, 10.0, 0.5


def substitutions(pairs: DataFrame, expected: str = "new_value", found: str = "old_value", distinct: bool = True) -> DataFrame:
    """(gold, ocr, n): characters of aligned texts; each pair of texts is aligned once however often it occurs."""
    p = pairs.where(F.col(expected).isNotNull() & F.col(found).isNotNull()).groupBy(expected, found).agg(F.count("*").alias("times"))
    a = p.select("times" if not distinct else F.lit(1).alias("times"), F.explode(alignment(F.col(expected), F.col(found))).alias("a"))
    return a.groupBy(F.col("a.expected").alias("gold"), F.col("a.found").alias("ocr")).agg(F.sum("times").alias("n"))


def confusions(counts: DataFrame, least: int = 3) -> DataFrame:
    """Substitutions seen often enough, with their share of all readings of the character."""
    total = counts.groupBy("gold").agg(F.sum("n").alias("total"))
    c = counts.where((F.col("gold") != F.col("ocr")) & (F.col("gold") != "") & (F.col("ocr") != "") & (F.col("n") >= least))
    return c.join(total, "gold").withColumn("weight", F.round(F.col("n") / F.col("total"), 6)).drop("total")


def costs(counts: DataFrame, letters: int = 36) -> DataFrame:
    """(gold, ocr, bits): -log2 of the smoothed share, within bounds. A bounded table: pairs of characters."""
    total = counts.where("gold != ''").groupBy("gold").agg(F.sum("n").alias("total"))
    share = (F.col("n") + PSEUDO) / (F.col("total") + PSEUDO * letters)
    c = counts.where("gold != '' and ocr != '' and gold != ocr").join(total, "gold")
    return c.select("gold", "ocr", F.round(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), -F.log2(share))), 6).alias("bits"))
