"""Readers for event logs, labels and prediction files.

Paths are resolved through the Hadoop file system, so they may live on any store the
cluster reads.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.splits import row_at, up_to
from .schemas import SchemaRegistry

PREDICTION_SCHEMA = "event_id bigint, predict double"


def find_paths(spark: SparkSession, pattern: str, exclude: str | None = None) -> list[str]:
    """Sorted paths matching a glob, minus those whose file name contains ``exclude``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path) or []
    names = [status.getPath() for status in found]
    return sorted(p.toString() for p in names if not exclude or exclude not in p.getName())


def resolve(spark: SparkSession, patterns, exclude: str | None = None) -> list[str]:
    """Paths of the first pattern that matches anything."""
    patterns = [patterns] if isinstance(patterns, str) else patterns
    for pattern in patterns:
        paths = find_paths(spark, pattern, exclude)
        if paths:
            return paths
    return []


def existing(spark: SparkSession, paths, required: bool = True) -> list[str]:
    """The given paths that exist; a missing one is an error unless ``required`` is off."""
    kept = [p for p in paths if find_paths(spark, p)]
    missing = [p for p in paths if p not in kept]
    if missing and required:
        raise FileNotFoundError(f"missing inputs: {missing}")
    if not kept:
        raise FileNotFoundError("none of the inputs exists")
    return kept


def read_events(spark: SparkSession, paths, first_files: int | None = None,
                tolerant: bool = False, registry: str | None = None) -> DataFrame | None:
    """Parquet event log; None when there are no paths.

    ``tolerant`` merges differing file schemas, filling absent columns with null. It opens every footer, unless
    ``registry`` names a folder that keeps the schemas of files already seen (see ``SchemaRegistry``).
    ``first_files`` reads only the first files, for development runs.
    """
    if not paths:
        return None
    if tolerant and registry:
        return SchemaRegistry(spark, registry).read(paths[:first_files])
    reader = spark.read.option("mergeSchema", str(tolerant).lower())
    return reader.parquet(*paths[:first_files])


def read_period_files(spark: SparkSession, base: str, first_files: int | None = None,
                      tolerant: bool = True, registry: str | None = None) -> dict:
    """Period name -> raw event log, for the standard file layout under ``base``.

    Columns that only some files of a period have are kept, null elsewhere, which opens every
    footer, or with a ``registry`` folder those of new files; without ``tolerant`` the columns are those of one file.
    """
    layout = {
        "pretrain": (f"{base}/*pre*train*.parquet", None),
        "train": (f"{base}/train_part_*.parquet", None),
        "pretest": (f"{base}/*pre*test*.parquet", None),
        "test": (f"{base}/*test*.parquet", "pre"),
    }
    frames = {}
    for period, (pattern, exclude) in layout.items():
        events = read_events(spark, find_paths(spark, pattern, exclude), first_files, tolerant,
                             registry and f"{registry}/{period}")
        if events is not None:
            frames[period] = canonical_names(events)
    return frames


def canonical_names(df: DataFrame) -> DataFrame:
    """Map alternative column spellings to the canonical ones."""
    for other, name in fv.COLUMN_ALIASES.items():
        if other in df.columns and name not in df.columns:
            df = df.withColumnRenamed(other, name)
    return df


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label side table as (event_id bigint, target bigint)."""
    return label_columns(spark.read.parquet(path))


def label_columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("event_id").cast("bigint"), F.col("target").cast("bigint"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """CSV of (event_id, predict)."""
    return spark.read.csv(path, header=True, schema=PREDICTION_SCHEMA)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Ids an output must cover, from a CSV whose header names event_id."""
    return spark.read.csv(path, header=True).select(F.col("event_id").cast("bigint"))


def first_rows(df: DataFrame, n: int = fv.HEAD_ROWS, order=("event_id",)) -> DataFrame:
    """The first ``n`` rows by whole-number ``order`` columns, for development runs.

    The n-th row is located by counting, so no task receives n rows of every partition.
    """
    rows = df.count()
    if rows <= n:
        return df
    return df.where(up_to(order, row_at(df, n, order, rows=rows))).limit(n)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df`` itself; an empty one is an error."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
