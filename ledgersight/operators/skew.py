"""Hot keys: finding them, and joins that split them over many tasks.

A customer, session or category may own a large share of all rows. The list of
keys with more than ``hot_rows`` rows is short by construction (at most
``rows / hot_rows`` entries), so it can be broadcast whatever the input size.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import materialise

TASK_ROWS = 200_000     # rows that a task sorts for every window of a block


@dataclass(frozen=True)
class SkewPolicy:
    """Limits on what one task may be handed."""

    hot_rows: int = 1_000_000          # a key above this is split
    min_cell_us: int = 1_000_000       # narrowest time slice of a split customer
    broadcast_rows: int = 1_000_000    # a lookup table above this is shuffled instead


DEFAULT_POLICY = SkewPolicy()


def same(left: DataFrame, right: DataFrame, names) -> Column:
    """Equality on ``names`` that also pairs nulls."""
    return reduce(
        lambda a, b: a & b, (left[name].eqNullSafe(right[name]) for name in names)
    )


def hot_keys(df: DataFrame, keys, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame | None:
    """Keys owning more than ``policy.hot_rows`` rows, or None when there are none.

    Column _parts is the number of tasks the key's rows should be spread over. The counts
    are combined before the shuffle, so the check itself is not skewed.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    parts = F.ceil(F.col("count") / policy.hot_rows).cast("int").alias("_parts")
    found = df.groupBy(*keys).count().where(F.col("count") > policy.hot_rows).select(*keys, parts)
    if found.isEmpty():
        return None
    return materialise(found)


def split_hot(df: DataFrame, hot: DataFrame, keys):
    """(rows of ordinary keys, rows of hot keys)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    flag = F.broadcast(hot)
    condition = same(df, flag, keys)
    return df.join(flag, condition, "left_anti"), df.join(flag, condition, "left_semi")


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys``, with about TASK_ROWS of its ``rows`` in a partition.

    Windows over several keys hold a sort for each, so what a task needs follows from its rows. Without a number of
    partitions it would follow from the session's settings and grow with the table.
    """
    if rows <= TASK_ROWS:
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def is_small(df: DataFrame, policy: SkewPolicy = DEFAULT_POLICY) -> bool:
    """Whether ``df`` has few enough rows to broadcast."""
    return df.count() <= policy.broadcast_rows


def lookup_join(left: DataFrame, right: DataFrame, keys, how: str = "left",
                policy: SkewPolicy = DEFAULT_POLICY, hot="find",
                right_rows: int | None = None) -> DataFrame:
    """Join ``left`` with a table holding one row per key, whatever the key's skew.

    A small table is broadcast after its row count is checked. A larger one is
    shuffled; keys that are hot on the left are salted there and repeated per salt
    on the right, so no task receives a whole hot key. Null keys match null keys.
    ``how`` is inner, left, left_semi or left_anti. ``hot`` is the table of keys that are
    hot on the left when already known, None for "no hot keys". ``right`` is counted
    (unless ``right_rows`` is given) and then joined, so it should be a stored table.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    small = is_small(right, policy) if right_rows is None else right_rows <= policy.broadcast_rows
    if small:
        return null_safe_join(left, F.broadcast(right), keys, how)
    if isinstance(hot, str):
        hot = hot_keys(left, keys, policy)
    if hot is None:
        return null_safe_join(left, right, keys, how)
    hot = F.broadcast(hot)
    # the task number spreads full copies of one row; it is the same when a task is retried
    spread = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in left.columns])
    salted_left = null_safe_join(left, hot, keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(spread, F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    salted_right = null_safe_join(right, hot, keys, "left").withColumn(
        "_salt", F.explode(copies)).drop("_parts")
    return null_safe_join(salted_left, salted_right, keys + ["_salt"], how).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
    """Null-safe equi-join that keeps one copy of the key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys)
    )
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{k}" for k in keys]) if how in ("inner", "left") else joined
