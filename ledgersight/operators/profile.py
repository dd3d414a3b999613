"""Distributions as tables: histograms and class-conditional densities."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fv


def histogram(df: DataFrame, columns, bins: int = fv.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width counts: column, bin, low, high, n. The last bin includes the maximum.

    Empty bins are present with n = 0. Two passes: the range of each column (all that
    reaches the driver), then the counts, combined before the shuffle.
    """
    columns = list(columns)
    found = df.agg(*[x for c in columns for x in _extremes(c, F.col(c))]).first()
    ranges = {c: (found[f"lo_{c}"], found[f"hi_{c}"]) for c in columns
              if found[f"lo_{c}"] is not None}
    counts = _binned(df, {c: F.col(c) for c in ranges}, ranges, bins).groupBy("column", "bin").count()
    edges = [(c, b, lo + b * ((hi - lo) / bins), lo + (b + 1) * ((hi - lo) / bins))
             for c, (lo, hi) in ranges.items() for b in range(bins)]
    all_bins = df.sparkSession.createDataFrame(
        edges, "column string, bin int, low double, high double")
    # one row per column and bin on either side
    return all_bins.join(counts, ["column", "bin"], "left").select(
        "column", "bin", "low", "high", F.coalesce("count", F.lit(0)).alias("n"))


def class_density(df: DataFrame, features, target: str = "target",
                  bins: int = fv.HISTOGRAM_BINS) -> DataFrame:
    """Density of each feature per class on shared bins.

    ``features`` maps a column to whether its axis is logarithmic; a logarithmic axis
    is used only if some value is positive, and then covers the positive values. A
    feature with an empty class is left out. Columns: feature, log_axis, target, bin,
    n, density (share of the class per unit of the axis).
    """
    df = df.where(F.col(target).isin(0, 1))

    def logged(c):
        return F.when(F.col(c) > 0, F.log10(F.col(c).cast("double")))

    per_class = df.groupBy(target).agg(*[x for c in features for x in (
        F.count(c).alias(f"n_{c}"), F.count(logged(c)).alias(f"pos_{c}"),
        *_extremes(c, F.col(c)), *_extremes(f"log_{c}", logged(c)))]).collect()
    axes, kept, ranges = {}, {}, {}
    for c, wants_log in features.items():
        if len(per_class) < 2 or not all(r[f"n_{c}"] for r in per_class):
            continue
        axes[c] = bool(wants_log and any(r[f"pos_{c}"] for r in per_class))
        kept[c] = logged(c) if axes[c] else F.col(c)
        name = f"log_{c}" if axes[c] else c
        ranges[c] = (min(r[f"lo_{name}"] for r in per_class if r[f"lo_{name}"] is not None),
                     max(r[f"hi_{name}"] for r in per_class if r[f"hi_{name}"] is not None))
    counts = _binned(df, kept, ranges, bins, target).groupBy("column", target, "bin").count()
    total = F.sum("count").over(W.partitionBy("column", target))  # over bins, not rows
    width = F.coalesce(*[F.when(F.col("column") == c, F.lit((hi - lo) / bins))
                         for c, (lo, hi) in ranges.items()], F.lit(0.0))
    return counts.select(
        F.col("column").alias("feature"), F.col("column").isin([c for c in axes if axes[c]]).alias("log_axis"),
        F.col(target).alias("target"), "bin", F.col("count").alias("n"),
        (F.col("count") / total / F.when(width > 0, width).otherwise(F.lit(1.0))).alias("density"))


def log_axis_by_name(columns) -> dict:
    """Logarithmic axis for columns named after amounts."""
    return {c: "amt" in c.lower() or "amount" in c.lower() for c in columns}


def _extremes(name, value):
    value = value.cast("double")
    return F.min(value).alias(f"lo_{name}"), F.max(value).alias(f"hi_{name}")


def _binned(df, values, ranges, bins, *keep):
    """A row (column, bin) per non-null value; 0-based bins, the maximum in the last one."""
    cells = []
    for c, value in values.items():
        lo, hi = ranges[c]
        value = value.cast("double")
        number = F.floor((value - lo) / ((hi - lo) / bins)).cast("int") if hi > lo else F.lit(0)
        cells.append(F.struct(F.lit(c).alias("column"), F.when(
            value.isNotNull(), F.least(number, F.lit(bins - 1))).alias("bin")))
    empty = F.array().cast("array<struct<column:string,bin:int>>")
    return df.select(*keep, F.explode(F.array(*cells) if cells else empty).alias("c")).select(
        *keep, "c.*").where(F.col("bin").isNotNull())
