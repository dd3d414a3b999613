"""Cutting a hot customer's timeline into slices that fit one task.

Ordinary customers are handled by plain windows partitioned on the customer. A hot
customer's rows are spread over (customer, time slice) groups instead; what happened
before a slice enters it as one extra row, so the same window expressions hold.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import DAY_US, SECOND_US
from .lineage import materialise
from .skew import DEFAULT_POLICY, SkewPolicy, null_safe_join

MAX_CELL_US = 30 * DAY_US


def slice_width(df: DataFrame, key: str, time: str,
                policy: SkewPolicy = DEFAULT_POLICY) -> int:
    """Slice width in microseconds such that no (key, slice) exceeds the row limit.

    Starts from the average density of the densest key and narrows while bursts
    still overfill a slice, down to ``policy.min_cell_us``. Only counts reach the driver.
    """
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi"))
    widest = per_key.agg(
        F.min((F.col("hi") - F.col("lo") + 1) / F.col("n")).alias("gap")).first()["gap"]
    width = int(max(policy.min_cell_us, min(MAX_CELL_US, (widest or 0) * policy.hot_rows / 2)))
    while width > policy.min_cell_us:
        fullest = (df.groupBy(key, cell_of(time, width)).count()
                   .agg(F.max("count")).first()[0])
        if fullest is None or fullest <= policy.hot_rows:
            break
        width = max(policy.min_cell_us, width // 8)
    return width


def slice_rows(df: DataFrame, key: str, time: str, tie: str,
               policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Add _cell, a slice of the (time, tie) order of each key that fits one task.

    Slices are time cells. Where even the narrowest cell is overfull, rows are cut by
    their exact time and then by ranges of the unique whole number ``tie``. The list of
    overfull cells has at most rows / hot_rows entries.
    """
    width = slice_width(df, key, time, policy)
    at = cell_of(time, width)
    whole = F.lit(0).cast("bigint")
    overfull = (df.groupBy(key, at.alias("_at")).count()
                .where(F.col("count") > policy.hot_rows).select(key, "_at"))
    if overfull.isEmpty():
        return df.withColumn("_cell", F.struct(at.alias("at"), whole.alias("exact"), whole.alias("part")))
    overfull = materialise(overfull)
    marked = null_safe_join(df.withColumn("_at", at),
                            F.broadcast(overfull.withColumn("_full", F.lit(True))),
                            [key, "_at"], "left")
    step = _tie_step(marked.where("_full"), key, time, tie, policy)
    exact = F.when(F.col("_full"), F.col(time)).otherwise(whole)
    part = F.when(F.col("_full"), F.expr(f"{tie} div {step}")).otherwise(whole)
    return marked.withColumn(
        "_cell", F.struct(F.col("_at").alias("at"), exact.alias("exact"), part.alias("part"))
    ).drop("_at", "_full")


def _tie_step(df, key, time, tie, policy) -> int:
    """Width of tie ranges such that no (key, time, range) exceeds the row limit.

    Ties are unique, so a range of ``hot_rows`` numbers always fits.
    """
    ticks = df.groupBy(key, time).agg(
        F.count(F.lit(1)).alias("n"), F.min(tie).alias("lo"), F.max(tie).alias("hi"))
    gap = ticks.where(F.col("n") > policy.hot_rows).agg(
        F.min((F.col("hi") - F.col("lo") + 1) / F.col("n"))).first()[0]
    step = max(policy.hot_rows, int((gap or 1) * policy.hot_rows / 2))
    while step > policy.hot_rows:
        fullest = (df.groupBy(key, time, F.expr(f"{tie} div {step}")).count()
                   .agg(F.max("count")).first()[0])
        if fullest <= policy.hot_rows:
            break
        step = max(policy.hot_rows, step // 8)
    return step


def cell_of(time, width: int) -> Column:
    time = F.col(time) if isinstance(time, str) else time
    return F.floor(time / F.lit(width)).cast("bigint")


def sums_before(ticks: DataFrame, keys, time: str, sums, width: int,
                inclusive: bool = False) -> DataFrame:
    """Replace each column of ``sums`` by its total over earlier ticks of the same keys.

    ``ticks`` has one row per (keys, time). Totals per slice are summed over earlier
    slices, then enter the slice as a row dated one microsecond before its start.
    """
    keys, sums = list(keys), list(sums)
    cells = ticks.withColumn("_cell", cell_of(time, width))
    per_cell = cells.groupBy(*keys, "_cell").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    carried = per_cell.select(
        *keys, "_cell", (F.col("_cell") * width - 1).alias(time),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast(cells.schema[c].dataType).alias(c) for c in sums],
        F.lit(True).alias("_carried"),
    )
    rows = cells.withColumn("_carried", F.lit(False)).unionByName(
        carried, allowMissingColumns=True)
    frame = (W.partitionBy(*keys, "_cell").orderBy(time)
             .rangeBetween(W.unboundedPreceding, 0 if inclusive else -1))
    return (
        rows.withColumns({c: F.coalesce(F.sum(c).over(frame), F.lit(0)) for c in sums})
        .where(~F.col("_carried")).drop("_carried", "_cell")
    )


def neighbour_time(ticks: DataFrame, keys, time: str, width: int, name: str,
                   following: bool) -> DataFrame:
    """Add the next (or previous) tick of the same keys; null at the end of the line."""
    keys = list(keys)
    cells = ticks.withColumn("_cell", cell_of(time, width))
    edge = F.min(time) if following else F.max(time)
    per_cell = cells.groupBy(*keys, "_cell").agg(edge.alias("_edge"))
    over_cells = W.partitionBy(*keys).orderBy("_cell")
    shift = F.lead if following else F.lag
    borders = (
        per_cell.select(*keys, "_cell", shift("_edge").over(over_cells).alias(time),
                        F.lit(True).alias("_border"))
        .where(F.col(time).isNotNull())
    )
    rows = cells.withColumn("_border", F.lit(False)).unionByName(
        borders, allowMissingColumns=True)
    inside = W.partitionBy(*keys, "_cell").orderBy(time)
    return (rows.withColumn(name, shift(time).over(inside))
            .where(~F.col("_border")).drop("_border", "_cell"))
