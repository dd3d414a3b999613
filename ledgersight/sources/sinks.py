"""Writers for predictions, tables and models."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished Spark output lies at ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def reuse_or_write(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                   force: bool = False) -> DataFrame:
    """The table stored at ``path``, built and stored first when absent or forced."""
    if force or not is_complete(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    """Store a fitted model or a bundle; ``models.bundle.load`` reads a bundle back."""
    model.write().overwrite().save(path)
