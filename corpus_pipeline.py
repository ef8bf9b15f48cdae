"""The corpus pipeline: quality, line dedup, near duplicates, mixing, packing.

Each stage works on all that the one before kept, as written to Parquet and read again. All but
the last return the columns of ``documents``; texts that a stage changes have their ``n_chars``
counted again. Rows of null id or text, empty tables and further columns are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.llm.line_dedup import dedup_lines
from granary.llm.mixing import mixed_documents
from granary.llm.near_duplicates import keep_one
from granary.llm.packing import pack
from granary.llm.quality_classifier import keep_good


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(spark, docs, runtime.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more stay only where they come first."""
    return _counted(dedup_lines(spark, docs, min_docs=10, keep="first").select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: whole and fractional repetitions of documents."""
    return _counted(mixed_documents(spark, docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: one row for each piece of a document, with its place."""
    return pack(spark, docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("best-fit packing", packing),
]
#: SQL can't express the classifier or the tokenizer; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = runtime.Scratch(spark)
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
