"""Assembling, aligning and checking scores per event."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import materialise


def keep_first(df: DataFrame, key: str = "event_id", order=()) -> DataFrame:
    """One row per key, the first by ``order``.

    A minimum over (order, row) combines on the map side, so many copies of one key
    never meet in a single task.
    """
    order = list(order) or [c for c in df.columns if c != key]
    rest = [c for c in df.columns if c != key and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_row")
    kept = df.groupBy(key).agg(row)
    return kept.select(*[F.col(c) if c == key else F.col(f"_row.{c}").alias(c)
                         for c in df.columns])


def merge_predictions(frames: dict[str, DataFrame]) -> DataFrame:
    """Name -> prediction file to one row per event all files share, with pred_<name>."""
    renamed = [df.select("event_id", F.col("predict").alias(f"pred_{name}"))
               for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, "event_id", "inner"), renamed)


def join_suffixed(left: DataFrame, right: DataFrame, key: str = "event_id",
                  suffix: str = "_new") -> DataFrame:
    """Inner join; a right column that collides gets the suffix."""
    renamed = right.select(*[
        F.col(c).alias(c + suffix) if c != key and c in left.columns else F.col(c)
        for c in right.columns])
    return left.join(renamed, key, "inner")


def fill_template(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row for every template id; predict is null when missing."""
    return template.select("event_id").join(predictions, "event_id", "left")


def missing_predictions(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """Template ids without a prediction."""
    known = predictions.where(F.col("predict").isNotNull())
    return template.select("event_id").join(known, "event_id", "left_anti")


def require_complete(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """The filled template; a missing prediction is an error."""
    n = missing_predictions(template, predictions).count()
    if n:
        raise ValueError(f"{n} template events have no prediction")
    return fill_template(template, predictions)


def align_scores(full: DataFrame, partial: DataFrame, score: str) -> DataFrame:
    """Scores of a subset spread to all rows; rows outside it get the subset's mean."""
    mean = partial.agg(F.avg(score)).first()[0]
    joined = full.join(partial.select("event_id", score), "event_id", "left")
    return joined.withColumn(score, F.coalesce(F.col(score), F.lit(mean)))


def submission(scores: DataFrame, template: DataFrame | None = None) -> DataFrame:
    """(event_id, predict), one row per event, complete against the template if given."""
    unique = keep_first(scores.select("event_id", "predict"))
    return unique if template is None else require_complete(template, materialise(unique))
