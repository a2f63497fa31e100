"""Byte slices, fixed-chunk deltas, runs and offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import running

SLICE = 4096


def slices(df: DataFrame, key: str, payload: str, size: int = SLICE) -> DataFrame:
    """Each slice of a binary payload with its number from 0; null and empty payloads have none."""
    n = F.octet_length(payload)
    at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    cut = df.select(key, F.col(payload).alias("__payload"), F.explode(at).alias("chunk"))
    return cut.select(key, F.col("chunk").cast("long").alias("chunk"), F.expr(f"substring(__payload, chunk * {size} + 1, {size})").alias("data"))


def delta(base: DataFrame, target: DataFrame, key: str, size: int = SLICE) -> DataFrame:
    """Slices that differ between two payload tables (key, payload): the new bytes, or null where the target is shorter."""
    old = slices(base, key, "payload", size).withColumnRenamed("data", "old")
    new = slices(target, key, "payload", size).withColumnRenamed("data", "new")
    return old.join(new, [key, "chunk"], "full").where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "chunk", "old", "new")


def patched(base: DataFrame, changes: DataFrame, key: str, size: int = SLICE) -> DataFrame:
    """The target payload of each key, from its base and its changes. A payload is one value, so its slices meet in one row."""
    old = slices(base, key, "payload", size)
    now = old.join(changes.select(key, "chunk", "new", F.lit(True).alias("changed")), [key, "chunk"], "full")
    data = F.when(F.col("changed"), F.col("new")).otherwise(F.col("data"))
    parts = now.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk", F.hex(data).alias("hex")))).alias("parts"))
    return parts.select(key, F.unhex(F.concat_ws("", F.col("parts.hex"))).alias("payload"))


def runs(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Neighbouring rows of equal value merged: first order value and number of rows of each run."""
    marked = running(df, group, order, lags=[value])
    starts = marked.withColumn("__new", F.when((F.col("position") == 1) | ~F.col(value).eqNullSafe(F.col(f"last_{value}")), 1).otherwise(0)).drop("position", f"last_{value}")
    numbered = running(starts, group, order, sums=["__new"]).withColumn("run", (F.col("before___new") + F.col("__new")).cast("long"))
    return numbered.groupBy(*group, "run").agg(F.first(value).alias(value), F.min(order[0]).alias("first"), F.count("*").alias("n"))


def front_coded(df: DataFrame, name: str) -> DataFrame:
    """Distinct sorted keys as (length of the prefix shared with the key before, rest)."""
    keys = running(df.select(F.col(name).alias("key")).where("key IS NOT NULL").distinct(), [], ["key"], lags=["key"])
    most = F.least(F.length("key"), F.length("last_key"))
    shared = F.when(most > 0, F.size(F.filter(F.sequence(F.lit(1), most), lambda i: F.substring("key", F.lit(1), i) == F.substring("last_key", F.lit(1), i)))).otherwise(0)
    return keys.withColumn("shared", shared.cast("long")).select("position", "shared", F.expr("substring(key, int(shared) + 1)").alias("rest"))


#: Longest chunk of the copy deltas. A rolling-hash cut before it needs 48 given bits, which real data never meets.
COPY_SLICE = 8192


def copy_ops(base: DataFrame, target: DataFrame, key: str, size: int = COPY_SLICE) -> DataFrame:
    """How to make each target payload from its base: ops in order, COPY (from a base offset) or LITERAL (with the bytes).

    A chunk is copied from the lowest base offset with the same bytes; neighbouring literals, and copies that continue
    each other, are one op. Repeated base chunks are reduced before the join, so that it makes no more rows than target chunks.
    """
    b = slices(base, key, "payload", size)
    b = b.groupBy(key, F.sha2("data", 256).alias("__hash"), "data").agg((F.min("chunk") * size).alias("from")).withColumnRenamed("data", "__same")
    t = slices(target, key, "payload", size).withColumn("__hash", F.sha2("data", 256))
    found = t.join(b, [key, "__hash"], "left").withColumn("from", F.when(F.col("__same") == F.col("data"), F.col("from")))
    placed = found.select(key, "chunk", "from", F.octet_length("data").cast("long").alias("size"), F.when(F.col("from").isNull(), F.hex("data")).alias("hex"))
    seen = running(placed, [key], ["chunk"], lags=["from", "size"])
    joins = F.when(F.col("from").isNull(), F.col("last_from").isNull()).otherwise(F.col("from").eqNullSafe(F.col("last_from") + F.col("last_size")))
    marked = seen.select(key, "chunk", "from", "size", "hex", F.when((F.col("position") > 1) & joins, 0).otherwise(1).alias("__new"))
    runs_of = running(marked, [key], ["chunk"], sums=["__new"]).withColumn("op", (F.col("before___new") + F.col("__new")).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct("chunk", "hex")))
    return runs_of.groupBy(key, "op").agg(F.min("from").alias("from"), F.sum("size").cast("long").alias("size"), F.unhex(F.concat_ws("", parts["hex"])).alias("data")).select(
        key, "op", F.when(F.col("from").isNull(), "LITERAL").otherwise("COPY").alias("kind"), "from", "size", F.when(F.col("from").isNull(), F.col("data")).alias("data")
    )


def replayed(base: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """The payload that the ops of each key make from its base. A payload is one value, so its ops meet in one row."""
    held = ops.join(base.select(key, F.col("payload").alias("__base")), key, "left")
    data = F.when(F.col("kind") == "COPY", F.hex(F.expr("substring(__base, int(from) + 1, int(size))"))).otherwise(F.hex("data"))
    parts = held.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("op", data.alias("hex")))).alias("parts"))
    return parts.select(key, F.unhex(F.concat_ws("", F.col("parts.hex"))).alias("payload"))
