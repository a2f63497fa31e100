"""Summaries, trimming, rankings and budget gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import at_ranks, running


def with_groups(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    """Inner join on the group columns; null groups are groups."""
    names = [f"__right_{g}" for g in group]
    other = right.withColumnsRenamed(dict(zip(group, names, strict=True)))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names, strict=True)), F.lit(True))
    return left.join(other, same).drop(*names)


def summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count, extremes, mean, population deviation, coefficient of variation (infinite for a mean of 0), median and p95 of each group."""
    plain = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    cv = F.when(F.col("mean") == 0, F.lit(float("inf"))).otherwise(F.expr("sd / nullif(mean, 0)"))
    return with_groups(plain.withColumn("cv", cv), at_ranks(df, group, value, p95=0.95), group)


def deviations(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Rows with the median of their group (mid) and the group's median absolute deviation (mad)."""
    mid = at_ranks(df, group, value).select(*group, F.col("median").alias("mid"))
    off = with_groups(df.where(F.col(value).isNotNull()), mid, group).withColumn("off", F.abs(F.col(value) - F.col("mid")))
    mad = at_ranks(off, group, "off").select(*group, F.col("median").alias("mad"))
    return with_groups(off, mad, group)


def trim(df: DataFrame, group: Sequence[str], value: str, width: float = 3.0, least: float = 0.7) -> DataFrame:
    """Per group: rows within width deviations of the median (all, if the deviation is 0), and whether enough of them stay."""
    stays = (F.col("mad") == 0) | (F.col("off") <= F.lit(width) * F.col("mad"))
    counted = deviations(df, group, value).groupBy(*group).agg(F.count("*").alias("n"), F.count_if(stays).alias("kept"))
    return counted.withColumn("accepted", F.col("kept") >= F.lit(least) * F.col("n"))


def rank_sum(df: DataFrame, dataset: str, entry: str, metrics: Sequence[str]) -> DataFrame:
    """Score of an entry in its dataset: the mean of its places by each metric, smallest first, ties by entry; then its rank by score."""
    long = df.select(dataset, entry, F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("double")))))).where("value IS NOT NULL")
    places = running(long, [dataset, "key"], ["value", entry])
    scores = places.groupBy(dataset, entry).agg((F.sum("position") / F.count("*")).alias("score"))
    return running(scores, [dataset], ["score", entry]).withColumnRenamed("position", "place")


def percent(value: Column, base: Column) -> Column:
    """Change against a base in percent; 0 where the base is about 0."""
    return F.when(F.abs(base) < 1e-12, F.lit(0.0)).otherwise((value - base) / F.when(base != 0, base) * 100)


def budget_gate(base: DataFrame, current: DataFrame, keys: Sequence[str], budgets: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Change of each metric for the keys on both sides, and PASS, WARN or FAIL by its budget; bases of 0 are skipped."""
    pick = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"), F.lit(float(w)).alias("warn"), F.lit(float(f)).alias("fail")) for m, (w, f) in budgets.items()]
    b = base.select(*keys, F.inline(F.array(*pick))).withColumnRenamed("v", "base")
    c = current.select(*keys, F.inline(F.array(*pick))).select(*keys, "metric", F.col("v").alias("current"))
    both = b.join(c, [*keys, "metric"]).where("base <> 0").withColumn("pct", (F.col("current") - F.col("base")) / F.col("base") * 100)
    return both.withColumn("status", F.when(F.col("pct") >= F.col("fail"), "FAIL").when(F.col("pct") >= F.col("warn"), "WARN").otherwise("PASS")).drop("warn", "fail")


def gate_verdict(gate: DataFrame) -> DataFrame:
    """One row: FAIL if any comparison failed or there was none, WARN if any warned, else PASS."""
    n = lambda status: F.count_if(F.col("status") == status)
    verdict = F.when((F.count("*") == 0) | (n("FAIL") > 0), "FAIL").when(n("WARN") > 0, "WARN").otherwise("PASS")
    return gate.agg(F.count("*").alias("comparisons"), n("FAIL").alias("failed"), n("WARN").alias("warned"), verdict.alias("verdict"))
