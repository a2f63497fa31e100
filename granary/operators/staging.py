"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, as in tests, a folder of its own where nothing set it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back; a lost executor then loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstaged(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads, and let Spark drop the shuffles that made them."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Shuffle files live until the driver collects its garbage; after a large step that is now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
