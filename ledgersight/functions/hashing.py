"""Deterministic buckets for sampling."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import column


def bucket(columns, modulus, seed=0) -> Column:
    """Bucket 0..modulus-1 from a 64-bit hash of the columns and a seed."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    return F.pmod(F.xxhash64(*[column(c) for c in columns], F.lit(seed)), F.lit(modulus))


def portable_hash(columns, seed=0) -> Column:
    """32-bit number from an MD5 digest of the columns' text, equal in any SQL engine."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    parts = [column(c).cast("string") for c in columns]
    if seed:
        parts.append(F.lit(str(seed)))
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def portable_bucket(columns, modulus, seed=0) -> Column:
    return portable_hash(columns, seed) % F.lit(modulus)
