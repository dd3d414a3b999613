"""Statistics across the columns of one row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import column


def _present(columns) -> Column:
    values = F.array(*[column(c).cast("double") for c in columns])
    return F.filter(values, lambda x: x.isNotNull())


def _total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def row_mean(columns) -> Column:
    """Mean of the non-null values; null when there are none."""
    values = _present(columns)
    return F.try_divide(_total(values), F.size(values).cast("double"))


def row_std(columns) -> Column:
    """Sample standard deviation of the non-null values; null below two values."""
    values = _present(columns)
    n = F.size(values)
    mean = F.try_divide(_total(values), n.cast("double"))
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))
