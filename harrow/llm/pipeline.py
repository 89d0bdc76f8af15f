"""A training corpus from ``documents``: five stages, each an operator of this subpackage, each written as Parquet and read again.

Every stage works on all that the one before kept. All but the last return the columns of ``documents``, with any others
that the input has; ``n_chars`` follows the text where a stage changes it. Rows that share a doc_id are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import line_dedup, mixing, near_dup, packing, toxicity
from harrow.llm.shared import arrow_rows, read, staged


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that operator 7 rejects (score 0.3 or more); the labels come from ``sf_dir``."""
    model = toxicity.learn(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    with arrow_rows(spark, 1000):
        return staged(toxicity.score(docs, model).filter("toxic_score < 0.3").select("row.*"), "pipeline-toxicity")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document that loses all lines stays with an empty text."""
    marked = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    changed = F.size("kept") < F.col("n_lines")
    text = F.array_join("kept", "\n")
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return marked.select(*(F.when(changed, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id, once."""
    return near_dup.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: rows repeat, and some go."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Toxicity scores, token ids and packings are not for SQL: tests/llm hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
