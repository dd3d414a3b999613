"""Calendar parts and time differences of event timestamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .casts import column

SECOND_US = 1_000_000
HOUR_US = 3_600 * SECOND_US
DAY_US = 24 * HOUR_US


def micros(ts) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(column(ts))


def iso_weekday(ts) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.weekday(column(ts)) + 1


def is_weekend(ts, first_day=fv.WEEKEND_FROM_WEEKDAY) -> Column:
    """1 from ISO weekday ``first_day`` on (5 counts Friday, 6 is Saturday and Sunday)."""
    return (iso_weekday(ts) >= first_day).cast("int")


def is_night(ts) -> Column:
    return (F.hour(column(ts)) < fv.NIGHT_BEFORE_HOUR).cast("int")


def day_number(ts) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(column(ts)))


def seconds_between(later_us, earlier_us) -> Column:
    """Whole seconds from ``earlier_us`` to ``later_us``, truncated."""
    gap = column(later_us) - column(earlier_us)
    return ((gap - gap % SECOND_US) / SECOND_US).cast("bigint")


def minus_days(ts, days) -> Column:
    return column(ts) - F.make_dt_interval(F.lit(days))


def calendar_features(ts="event_ts") -> dict[str, Column]:
    """Name -> expression for the calendar part of the feature table."""
    ts = column(ts)
    return {
        "hour": F.hour(ts),
        "weekday": iso_weekday(ts),
        "day": F.dayofmonth(ts),
        "month": F.month(ts),
        "is_weekend": is_weekend(ts),
        "event_day_number": day_number(ts),
        "event_date": F.to_date(ts),
    }
