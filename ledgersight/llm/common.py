"""Helpers the operators of this subpackage share."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import materialise

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query over the tables in a folder, with its SQL where there is one."""

    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of a table, whatever other columns it has."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                     F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(df_column: str, modulus: int) -> Column:
    """crc32 of the number as text, modulo ``modulus``; null numbers count as empty text."""
    return F.crc32(F.coalesce(F.col(df_column).cast("string"), F.lit("")).cast("binary")) % modulus


__all__ = ["ORACLE", "QUERIES", "ascii_lower", "documents", "materialise", "query", "remainder", "table"]
