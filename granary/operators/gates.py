"""Comparisons of two runs, resampled intervals and codec summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import at_ranks, running


def same_values(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Keys of both sides with MATCH, MISMATCH, MISSING_LEFT or MISSING_RIGHT; null equals null."""
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), [*keys], "full")
    status = F.when(F.col("__r").isNull(), "MISSING_RIGHT").when(F.col("__l").isNull(), "MISSING_LEFT").when(F.col(a).eqNullSafe(F.col(b)), "MATCH").otherwise("MISMATCH")
    return both.withColumn("status", status).drop("__l", "__r")


def median_interval(df: DataFrame, order: str, value: str, resamples: int, seed: int) -> DataFrame:
    """Median, and its 95 % bootstrap interval by ceil ranks of the resamples' medians; draws come from a fixed generator.

    df holds one row for each group of a summary, so resamples * rows is small."""
    placed = running(df, [], [order]).select((F.col("position") - 1).alias("pos"), F.col(value).alias("v"))
    drawn = placed.agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))).alias("r"))
    drawn = drawn.select("n", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    drawn = drawn.select("r", F.expr(f"((r * 1103515245 + i * 12345 * (r + 7) + {seed}) % 2147483648) div 8 % n").alias("pos"))
    medians = drawn.join(placed, "pos").groupBy("r").agg(F.percentile("v", 0.5).alias("v"))
    ends = at_ranks(medians, [], "v", lo=0.025, hi=0.975).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))
    whole = placed.agg(F.round(F.percentile("v", 0.5), 6).alias("median"))
    return whole.crossJoin(ends)  # one row each


def codec_summary(df: DataFrame, group: Sequence[str], value: str, steady: float = 0.15) -> DataFrame:
    """Count, extremes, upper median, variation (infinite, or 0, for a mean of 0), positive values, and whether it is steady."""
    placed = running(df.where(F.col(value).isNotNull()).select(*group, value), [*group], [value])
    sizes = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"))
    same = [F.col(f"p.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    middle = placed.alias("p").join(sizes.alias("s"), same).where("position = n div 2 + 1").select(*(F.col(f"p.{g}").alias(g) for g in group), F.round(value, 6).alias("upper_median"))
    mean, sd = F.avg(value), F.stddev_pop(value)
    plain = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), mean.alias("mean"), sd.alias("sd"), F.count_if(F.col(value) > 0).alias("passes"))
    cv = F.when(F.col("mean") == 0, F.lit(float("inf"))).otherwise(F.expr("sd / nullif(mean, 0)"))
    both = plain.alias("p").join(middle.alias("s"), same).select(*(F.col(f"p.{g}").alias(g) for g in group), "n", "lo", "upper_median", "hi", "mean", "sd", "passes")
    return both.select(*group, "n", "lo", "upper_median", "hi", F.round(cv, 6).alias("cv"), F.round(F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(cv), 6).alias("cv_or_zero"), "passes", (cv <= steady).alias("stable"))
