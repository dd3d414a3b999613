"""Casts, null fills and parsing of raw event columns."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

# digits after the point that amounts are summed with
AMOUNT_SCALE = 6


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_int(c, spark_type="int", fill=fv.NULL_INTEGER) -> Column:
    """Integer of the given width; malformed, out-of-range and null become ``fill``."""
    return F.coalesce(column(c).try_cast(spark_type), F.lit(fill).cast(spark_type))


def lenient_double(c) -> Column:
    """Double, or null when the value is not a number."""
    return column(c).try_cast("double")


def strict_timestamp(c, fmt=fv.TIMESTAMP_FORMAT) -> Column:
    """Parse a timestamp; a malformed value fails the query."""
    return F.to_timestamp(column(c), fmt)


def lenient_timestamp(c, fmt=fv.TIMESTAMP_FORMAT) -> Column:
    """Parse a timestamp; a malformed value becomes null."""
    return F.try_to_timestamp(column(c), F.lit(fmt))


def category(c, fill=fv.NULL_CATEGORY) -> Column:
    """Category as text with nulls replaced."""
    return F.coalesce(column(c).cast("string"), F.lit(fill))


def digits(c, pattern, spark_type="smallint", fill=fv.NULL_INTEGER) -> Column:
    """First captured digit run of a text, ``fill`` when absent or too large."""
    return lenient_int(F.regexp_extract(column(c), pattern, 1), spark_type, fill)


def exact_amount(c, scale: int = AMOUNT_SCALE) -> Column:
    """Amount as decimal(38, scale), rounded to ``scale`` digits (at most 6, so differences keep them).

    Decimal sums are exact and do not depend on the order in which partial sums are
    merged, so a rolling sum can be taken as a difference of two running sums. An amount
    that is not finite or has over 38 - ``scale`` whole digits fails the query.
    """
    if not 0 <= scale <= 6:
        raise ValueError(f"scale must lie in 0..6, not {scale}")
    value = column(c).try_cast(f"decimal(38,{scale})")
    return F.when(column(c).isNull() | value.isNotNull(), value).otherwise(F.raise_error(
        F.concat(F.lit("amount does not fit an exact sum: "), column(c).cast("string"))))


def exact_parts(c, scale: int = AMOUNT_SCALE) -> tuple[Column, Column]:
    """(whole, rest) of ``exact_amount``: its floor, and what is above it in units of 10^-scale.

    Both are 64-bit numbers, so running sums of them stay primitive and are still exact; ``joined_parts``
    makes one number of two sums. An amount whose floor does not fit fails the query.
    """
    value = exact_amount(c, scale)
    whole = F.floor(value).try_cast("bigint")
    rest = ((value - F.floor(value)) * F.lit(10 ** scale)).cast("bigint")
    return F.when(value.isNull() | whole.isNotNull(), whole).otherwise(F.raise_error(
        F.concat(F.lit("amount does not fit an exact sum: "), column(c).cast("string")))), rest


def joined_parts(whole, rest, scale: int = AMOUNT_SCALE) -> Column:
    """The double nearest to whole + rest / 10^scale, for sums of ``exact_parts``.

    Below 2^53 units the quotient of two doubles is that number; larger sums go through decimals.
    """
    whole, rest, unit = column(whole), column(rest), 10 ** scale
    small = (F.abs(whole) < 4 * 10 ** 15 // unit) & (rest < 4 * 10 ** 15)
    exact = whole.cast(f"decimal(38,{scale})") + rest.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale))
    return F.when(small, (whole * unit + rest).cast("double") / F.lit(float(unit))).otherwise(exact.cast("double"))


def exact_square(c, scale: int = AMOUNT_SCALE) -> Column:
    """Square of ``exact_amount`` as decimal(37, 12), for exact sums; 10^12 and above fail the query."""
    value = exact_amount(c, scale)
    short = value.try_cast("decimal(18,6)")
    return F.when(value.isNull() | short.isNotNull(), short * short).otherwise(F.raise_error(
        F.concat(F.lit("amount does not fit an exact sum of squares: "), column(c).cast("string"))))
