"""Cutting lineage through the shared checkpoint folder."""

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session gets one of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="ledgersight-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and continue from the stored copy.

    The copy is a Parquet table next to the checkpoints: it survives lost executors, and
    later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_stored(spark: SparkSession) -> None:
    """Delete the tables ``materialise`` stored for this application."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{current}/stored-*")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(path) or []:
            fs.delete(status.getPath(), True)
