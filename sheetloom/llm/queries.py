"""The registered queries of this folder, each over its whole table, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_text, jaccard_join, licenses, line_dedup, packing, suffix_dedup, syncmers, toxicity
from .shared import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: how many lines it has, how many of them repeat, and a digest of the text that is left."""
    out = line_dedup.line_report(table(spark, sf_dir, "documents"), exact_chars=line_dedup.EXACT_CHARS)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary())


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compared(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_packing": op2_packing,
        "op3_html_text": op3_html_text,
        "op4_syncmers": op4_syncmers,
        "op5_toxicity": op5_toxicity,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_licenses": op7_licenses,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_bpe": op9_bpe,
        "op10_neighbours": op10_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {}
