"""Validation rules as relations: each gives the rows, or the groups, that break it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import running


def overlaps(df: DataFrame, group: Sequence[str], offset: str, size: str, tie: str) -> DataFrame:
    """Ranges that begin before the range sorted just before them ends."""
    ends = df.withColumn("__end", F.col(offset) + F.col(size))
    return running(ends, group, [offset, tie], lags=["__end"]).where(F.col("last___end") > F.col(offset)).withColumnRenamed("last___end", "end_before").drop("__end", "position")


def order_gaps(df: DataFrame, group: Sequence[str], number: str) -> DataFrame:
    """Per group whose numbers are not 1..n, each once: rows, how many numbers are out of range, repeated or missing."""
    one = df.groupBy(*group, number).agg(F.count("*").alias("c"))
    per = one.groupBy(*group).agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("repeated"), F.count("*").alias("d"), F.max(number).alias("top"), F.count_if(F.col(number) < 1).alias("below"))
    made = per.select(*group, F.col("n").cast("long"), F.col("below").cast("long").alias("out_of_range"), F.col("repeated").cast("long"), F.greatest(F.lit(0), F.col("top") - (F.col("d") - F.col("below"))).cast("long").alias("missing"))
    return made.where("out_of_range > 0 OR repeated > 0 OR missing > 0")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def trusted(df: DataFrame, known: DataFrame, revoked: DataFrame, key: str) -> DataFrame:
    """Rows whose key is known and not revoked."""
    return df.join(known.select(key), key, "left_semi").join(revoked.select(key), key, "left_anti")


def replay_guard(df: DataFrame, group: Sequence[str], arrival: str, sequence: str) -> DataFrame:
    """Whether a row's sequence is above all that arrived before it for the same key; rejected rows can't be above, so they need no exception."""
    seen = running(df, group, [arrival], maxes=[sequence])
    return seen.withColumn("accepted", F.coalesce(F.col(sequence) > F.col(f"top_{sequence}"), F.col(sequence).isNotNull()))


def bad_endpoints(edges: DataFrame, nodes: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """Edges with an end that is no node, or whose ends are equal, with the first rule they break."""
    n = nodes.select(F.col(key).alias("__n")).distinct()
    a = edges.join(n.withColumnRenamed("__n", "__a"), F.col(source) == F.col("__a"), "left")
    b = a.join(n.withColumnRenamed("__n", "__b"), F.col(target) == F.col("__b"), "left")
    code = F.when(F.col("__a").isNull(), "no source").when(F.col("__b").isNull(), "no target").when(F.col(source) == F.col(target), "self loop")
    return b.withColumn("code", code).where("code IS NOT NULL").drop("__a", "__b")
