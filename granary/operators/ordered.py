"""Running values over ordered groups, however large one group is.

Rows are dealt by ranges of (group, order), so a hot group spreads over many tasks. Each range computes its own running
values; what earlier ranges of the same group hold is added as a carry. At most one group crosses the border of two
neighbouring ranges, so there are fewer carries than ranges, and they are broadcast whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.staging import staged

_PART = "__range"


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), maxes: Sequence[str] = (), lags: Sequence[str] = ()) -> DataFrame:
    """Adds position (from 1), before_<c> of the sums of earlier rows (0 at first), top_<c> of their maxima and last_<c> of the row before (null at first).

    group and order together should be unique; rows that tie keep one range and an arbitrary order among themselves.
    Null groups are groups, null order values come first. An empty table gives an empty result.
    """
    tagged = staged_ranges(df, [*group, *order])
    here = Window.partitionBy(_PART, *group).orderBy(*order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    last = F.struct(*lags) if lags else F.lit(None)
    local = tagged.select(
        "*",
        F.row_number().over(here).alias("__at"),
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__sum_{c}") for c in sums),
        *(F.max(c).over(before).alias(f"__max_{c}") for c in maxes),
        *([F.lag(last).over(here).alias("__lag")] if lags else []),
    )
    totals = tagged.groupBy(_PART, *group).agg(
        F.count("*").alias("n"),
        *(F.sum(c).alias(f"s_{c}") for c in sums),
        *(F.max(c).alias(f"m_{c}") for c in maxes),
        *([F.max_by(last, F.struct(*order)).alias("l")] if lags else []),
    )
    earlier = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col(_PART).alias("__p"),
        *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)),
        F.sum("n").over(earlier).alias("__n"),
        *(F.sum(f"s_{c}").over(earlier).alias(f"__cs_{c}") for c in sums),
        *(F.max(f"m_{c}").over(earlier).alias(f"__cm_{c}") for c in maxes),
        *([F.last("l").over(earlier).alias("__cl")] if lags else []),
    ).where("__n IS NOT NULL")
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)), F.col(_PART) == F.col("__p"))
    at = F.col("__at") == 1
    return local.join(F.broadcast(carry), same, "left").select(
        *df.columns,
        (F.col("__at") + F.coalesce("__n", F.lit(0))).cast("long").alias("position"),
        *((F.col(f"__sum_{c}") + F.coalesce(f"__cs_{c}", F.lit(0))).alias(f"before_{c}") for c in sums),
        *(F.greatest(f"__max_{c}", f"__cm_{c}").alias(f"top_{c}") for c in maxes),
        *(F.when(at, F.col(f"__cl.{c}")).otherwise(F.col(f"__lag.{c}")).alias(f"last_{c}") for c in lags),
    )


def staged_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows dealt by ranges, each with the number of its range."""
    return staged(df.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()), "ranges")


def at_ranks(df: DataFrame, group: Sequence[str], value: str, **fractions: float) -> DataFrame:
    """Per group: n, the median (mean of the middle two), and for each fraction p the value at place ceil(p * (n - 1)), counted from 0.

    Null values are left out; there is no interpolation besides the median's. No group is collected.
    """
    placed = running(df.select(*group, value).where(F.col(value).isNotNull()), group, [value])
    sizes = placed.groupBy(*group).agg(F.count("*").alias("n"))
    names = [f"__z{i}" for i in range(len(group))]
    sizes = sizes.select("n", *(F.col(g).alias(z) for g, z in zip(group, names, strict=True)))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(z)) for g, z in zip(group, names, strict=True)), F.lit(True))
    place = F.col("position") - 1
    wanted = {"__lo": F.floor((F.col("n") - 1) / 2), "__hi": F.ceil((F.col("n") - 1) / 2)} | {k: F.ceil(F.lit(p) * (F.col("n") - 1)) for k, p in fractions.items()}
    picked = placed.join(sizes, same).groupBy(*group).agg(F.first("n").alias("n"), *(F.max(F.when(place == w, F.col(value))).alias(k) for k, w in wanted.items()))
    return picked.select(*group, "n", ((F.col("__lo") + F.col("__hi")) / 2).alias("median"), *fractions)
