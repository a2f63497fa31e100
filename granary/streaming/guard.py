"""A replay guard over a stream, with commits that can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.operators.checks import replay_guard


def guard_stream(stream: DataFrame, key: str, arrival: str, sequence: str, folder: str) -> StreamingQuery:
    """Judge each row of a stream: accepted, if its sequence is above all earlier ones of its key.

    Batch n reads the highest sequences after batch n - 1 and overwrites its own rows and state, so a batch that runs
    again after a failure gives the same files. Rows: folder/rows; the state after each batch: folder/state/<n>.
    """

    def commit(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        judged = replay_guard(batch, [key], arrival, sequence)
        tops = batch.groupBy(key).agg(F.max(sequence).alias("__top"))
        if n:
            state = spark.read.parquet(f"{folder}/state/{n - 1}")
            known = state.select(F.col(key).alias("__key"), F.col("__top").alias("__before"))
            judged = judged.join(known, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("accepted", F.col("accepted") & F.coalesce(F.col(sequence) > F.col("__before"), F.lit(True)))
            tops = tops.unionByName(state).groupBy(key).agg(F.max("__top").alias("__top"))
        judged.select(*batch.columns, "accepted").write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
        tops.write.mode("overwrite").parquet(f"{folder}/state/{n}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
