"""From raw documents to tokens: five stages, each written as Parquet and read again.

The first stage numbers the rows it keeps, and later decisions are joined back on that number: ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, decontamination, jaccard_join, quality, surrogates
from granary.llm.common import table, written
from granary.llm.queries import KEY, byte_bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The number of a row; only tables that a stage wrote have it.
ROW = "row_no"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    kept = quality.assess(docs, also=tuple(COLUMNS[1:])).where("kept").select(COLUMNS)
    return kept.withColumn(ROW, F.monotonically_increasing_id())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the first of the id that names the group."""
    first = jaccard_join.link(docs, row_col=ROW).where("first").select(ROW)
    return docs.select(*COLUMNS, ROW).join(first, ROW, "left_semi")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontamination.contained(docs, table(spark, sf_dir, "benchmark"), id_col=ROW).select(ROW).distinct()
    return docs.select(*COLUMNS, ROW).join(leaks, ROW, "left_anti")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return surrogates.replace(docs.select(*COLUMNS, ROW), KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS, ROW)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode_column(docs, "doc_id", "text", byte_bpe(), keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("private_data", private_data),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
