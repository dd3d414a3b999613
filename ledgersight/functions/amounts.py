"""Amount, screen and ratio features of one event."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import column


def log_abs(amt) -> Column:
    return F.log1p(F.abs(column(amt)))


def is_negative(amt) -> Column:
    return (column(amt) < 0).cast("int")


def screen_pixels(width="screen_w", height="screen_h") -> Column:
    return column(width).cast("int") * column(height).cast("int")


def screen_ratio(width="screen_w", height="screen_h") -> Column:
    """Width over height, 0 unless both are positive."""
    w, h = column(width), column(height)
    return F.when((h > 0) & (w > 0), w.cast("double") / h.cast("double")).otherwise(F.lit(0.0))


def ratio_plus_one(numerator, denominator) -> Column:
    """numerator / (denominator + 1); null when the denominator comes out as zero."""
    return F.try_divide(column(numerator).cast("double"), column(denominator).cast("double") + 1.0)
