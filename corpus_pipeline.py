"""From documents to packed training sequences.

The stages, each over all that its predecessor kept: documents predicted to be toxic go; of lines that repeat, up to
a few edits, the first occurrence stays; of documents whose shingles are nearly alike one stays; of passages that
repeat, PASSAGE bytes or more, the first occurrence stays; what is left is packed. All but the last return the columns of documents. Each
stage's result is written to the shared folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetloom.llm import jaccard_join, line_dedup, packing, suffix_dedup, toxicity
from sheetloom.llm.queries import vocabulary
from sheetloom.llm.shared import staged, table

#: Bytes that count as a passage: some 35 words of the shortest kind, so that no passage of over 50 words is too short. And
#: of an anchor in it.
PASSAGE, ANCHOR = 200, 64


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that aren't predicted to be toxic, as they come: null, empty and long texts, repeated rows and further
    columns, too. Without labels nothing is toxic; an empty table stays empty."""
    return toxicity.kept(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that repeat an earlier one; null texts stay null, and a text all of whose lines go is
    empty. Rows of one doc_id count as one document; those without come last."""
    return line_dedup.removed(docs, line_dedup.doomed(docs, exact_chars=line_dedup.EXACT_CHARS)).drop("__removed")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of its least doc_id; repeated rows are one. Texts without words stay,
    and so do all of a group without any doc_id."""
    return jaccard_join.one_each(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that repeat an earlier one, by doc_id and place (a null doc_id first); repeated rows
    stay or go together. Null texts come out empty; a character that a cut goes through goes, too."""
    return suffix_dedup.first_kept(docs, PASSAGE, ANCHOR)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; null and empty texts are an end token. Ties don't matter: each
    row has its pieces."""
    return packing.packed_documents(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_passages),
    ("packing", pack),
]

#: No SQL expresses these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
