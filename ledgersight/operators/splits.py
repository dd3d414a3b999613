"""Chronological train/validation splits, expressed as predicates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.casts import column
from ..functions.calendar import DAY_US


def fixed_holdout(start=fv.FIXED_HOLDOUT_START, time="event_ts") -> Column:
    """True for validation rows."""
    return column(time) >= F.lit(start).cast("timestamp")


def relative_holdout_start(df: DataFrame, days: int = fv.HOLDOUT_DAYS,
                           time: str = "event_us") -> int:
    """Microsecond timestamp lying ``days`` before the latest event."""
    latest = df.agg(F.max(time)).first()[0]
    if latest is None:
        raise ValueError("no event has a timestamp")
    return latest - days * DAY_US


def row_at(df: DataFrame, position: int, columns, slots: int = 4096, exact_rows: int = 100_000,
           rows: int | None = None):
    """Values of the whole-number ``columns`` in the row at ``position`` (from 1) of their order.

    The row is located by repeatedly counting rows in equal slots of a column's range and
    narrowing to the slot that holds the position, so no task ever sorts the whole table.
    Only slot counts reach the driver. A position past the end gives the last row.
    """
    rows = df.count() if rows is None else rows
    position = min(position, rows)
    for name in columns:
        if rows <= exact_rows:
            break
        low, high = df.agg(F.min(name), F.max(name)).first()
        while high > low and rows > exact_rows:
            step = (high - low) // slots + 1
            slot = F.expr(f"({name} - ({low})) div {step}").alias("slot")
            for number, rows in sorted(df.groupBy(slot).count().collect()):
                if position <= rows:
                    break
                position -= rows
            low, high = low + number * step, min(high, low + (number + 1) * step - 1)
            df = df.where(F.col(name).between(low, high))
    if rows > exact_rows:  # copies of one row
        return tuple(df.select(*columns).first())
    inside = df.select(*columns).orderBy(*columns).limit(position)
    return tuple(inside.orderBy(*[F.desc(c) for c in columns]).first())


def up_to(columns, values) -> Column:
    """Rows at or before ``values`` in the order of ``columns``."""
    inside = F.lit(True)
    for name, value in reversed(list(zip(columns, values))):
        inside = (F.col(name) < value) | ((F.col(name) == value) & inside)
    return inside


def position_threshold(df: DataFrame, share: float = fv.FALLBACK_TRAIN_SHARE,
                       time: str = "event_us", tie: str = "event_id", **limits):
    """(time, tie) of the last row inside the first ``share`` of rows in time order.

    At least one row is inside. Returns None for an empty table.
    """
    rows = df.count()
    if rows == 0:
        return None
    return row_at(df, max(1, int(rows * share)), (time, tie), rows=rows, **limits)


def mark_holdout(df: DataFrame, days: int = fv.HOLDOUT_DAYS,
                 share: float = fv.FALLBACK_TRAIN_SHARE) -> DataFrame:
    """Add is_val: the last ``days``, or the last 1 - share of rows if that leaves no train row."""
    start = relative_holdout_start(df, days)
    is_val = F.col("event_us") >= start
    if df.where(~is_val).isEmpty():
        order = ("event_us", "event_id")
        is_val = ~up_to(order, position_threshold(df, share, *order))
    return df.withColumn("is_val", is_val)


def split_name(cut=fv.FIXED_HOLDOUT_START, split="split_group", time="event_ts",
               target="target") -> Column:
    """train / val / test / null from the split tag, the cut date and label presence."""
    before = column(time) < F.lit(cut).cast("timestamp")
    known = column(target).isNotNull()
    return (F.when((column(split) == "train") & known & before, "train")
            .when((column(split) == "train") & known & ~before, "val")
            .when(column(split) == "test", "test"))


def recent_subset(border=fv.RECENT_BORDER, time="event_ts", raw="train_target_raw") -> Column:
    """Rows from the border on, and every labelled row whatever its date."""
    return (column(time) >= F.lit(border).cast("timestamp")) | (column(raw) != -1)


def class_counts(df: DataFrame, target: str = "target", by=()) -> DataFrame:
    """Rows, positives and negatives, optionally per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(target) == 1).alias("n_pos"),
        F.count_if(F.col(target) == 0).alias("n_neg"),
    )


def positive_weight(df: DataFrame, target: str = "target",
                    factor: float = fv.DYNAMIC_WEIGHT_FACTOR, fallback: float = 1.0) -> DataFrame:
    """One row: the weight of positives, factor * negatives / positives."""
    counts = df.agg(F.sum(target).alias("pos"), F.count(F.lit(1)).alias("n"))
    weight = F.lit(factor) * (F.col("n") - F.col("pos")) / F.col("pos")
    return counts.select(
        F.when(F.col("pos") > 0, weight).otherwise(F.lit(fallback)).alias("pos_weight"))
