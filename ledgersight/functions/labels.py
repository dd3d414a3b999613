"""Label definitions over a sparse label table (1 red, 0 yellow, absent green)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .casts import column


def unlabelled_as_negative(target="target") -> Column:
    return F.coalesce(column(target), F.lit(0))


def three_way(target="target", period="period") -> Column:
    """1 red, 0 yellow, -1 unlabelled inside the train period; null elsewhere."""
    return F.when(column(period) == "train",
                  F.coalesce(column(target), F.lit(-1)).cast("int"))


def red_vs_rest(raw="train_target_raw", sampled="is_train_sample") -> Column:
    """Binary target, defined on sampled training rows only."""
    return F.when(column(sampled), (column(raw) == 1).cast("int"))


def suspicious(raw="train_target_raw") -> Column:
    """1 for every labelled row, 0 for unlabelled."""
    return (column(raw) != -1).cast("int")


def main_weight(raw="train_target_raw") -> Column:
    w = fv.MAIN_WEIGHTS
    raw = column(raw)
    return F.when(raw == 1, w["red"]).when(raw == 0, w["yellow"]).otherwise(w["green"])


def suspicious_weight(raw="train_target_raw") -> Column:
    w = fv.SUSPICIOUS_WEIGHTS
    return F.when(column(raw) != -1, w["labelled"]).otherwise(w["unlabelled"])


def red_yellow_weight(raw="train_target_raw") -> Column:
    w = fv.RED_YELLOW_WEIGHTS
    return F.when(column(raw) == 1, w["red"]).otherwise(w["yellow"])
