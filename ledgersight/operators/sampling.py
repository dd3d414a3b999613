"""Deterministic sampling of unlabelled and normal rows.

The hash is a parameter: ``hashing.bucket`` (64-bit, fast) or ``hashing.portable_bucket``
(MD5, reproducible in other engines).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.casts import column
from ..functions.hashing import bucket, portable_hash


def keep_positives(df: DataFrame, keep: int, modulus: int = 100, target: str = "target",
                   offset: int = 0, hasher=bucket) -> DataFrame:
    """All positives plus ``keep`` of every ``modulus`` other rows.

    ``offset`` rotates which others are kept, so folds see different negatives.
    """
    rotated = F.pmod(hasher("event_id", modulus) + F.lit(offset), F.lit(modulus))
    return df.where((F.col(target) == 1) | (rotated < keep))


def keep_customer_sample(df: DataFrame, modulus: int = fv.CUSTOMER_MODULUS,
                         hasher=bucket) -> DataFrame:
    """One in ``modulus`` customers, each with the whole history."""
    return df.where(hasher("customer_id", modulus) == 0)


def keep_unlabelled(time="event_ts", border=fv.SAMPLE_BORDER, seed: int = fv.SEED,
                    hasher=bucket) -> Column:
    """Whether an unlabelled row is kept: 1 in 10 from the border on, 1 in 30 before."""
    key = ["event_id", "customer_id"]
    recent = hasher(key, fv.RECENT_UNLABELLED_MODULUS, seed) == 0
    old = hasher(key, fv.OLD_UNLABELLED_MODULUS, seed + fv.OLD_SEED_SHIFT) == 0
    at = column(time)
    border = F.lit(border).cast("timestamp")
    return F.when(at >= border, recent).when(at < border, old).otherwise(F.lit(False))


def mark_samples(df: DataFrame, border=fv.SAMPLE_BORDER, seed: int = fv.SEED,
                 hasher=bucket, raw: str = "train_target_raw") -> DataFrame:
    """Add is_train_sample (labelled or kept train rows) and is_test."""
    is_train = F.col("period") == "train"
    kept = (F.col(raw) != -1) | keep_unlabelled(border=border, seed=seed, hasher=hasher)
    return df.withColumns({
        "is_train_sample": is_train & F.coalesce(kept, F.lit(False)),
        "is_test": F.col("period") == "test",
    })


def exact_sample(df: DataFrame, n: int = fv.PLOT_SAMPLE_ROWS, key="event_id",
                 seed: int = fv.SEED) -> DataFrame:
    """Exactly min(n, rows) rows: those with the smallest hash of ``key``.

    Rows whose hash is far above the n-th smallest are dropped where they are read, so
    the final ordering handles little more than n rows; the margin grows until it holds n.
    """
    rows = df.count()
    if rows <= n:
        return df
    hashed = df.withColumn("_hash", portable_hash(key, seed))
    margin = 6 * n**0.5 + 100
    while True:
        share = min(1.0, (n + margin) / rows)
        near = hashed.where(F.col("_hash") <= int(share * 2**32))
        if share == 1.0 or near.limit(n).count() == n:
            keys = [key] if isinstance(key, str) else list(key)
            return near.orderBy("_hash", *keys).limit(n).drop("_hash")
        margin *= 4


def contrast_sample(df: DataFrame, n: int = fv.PLOT_SAMPLE_ROWS, target: str = "target",
                    key="event_id") -> DataFrame:
    """All positives and at most ``n`` negatives, for class comparisons."""
    positives = df.where(F.col(target) == 1)
    return positives.unionByName(exact_sample(df.where(F.col(target) == 0), n, key))
