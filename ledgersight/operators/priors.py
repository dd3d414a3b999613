"""Smoothed category priors: how often a category is labelled, and labelled red.

All keys are aggregated in one pass over the training rows (grouping sets), which
combines counts before the shuffle, so a dominant category is not a hot spot. The
tables are small next to the events; each is broadcast after its size is checked.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .lineage import materialise
from .skew import DEFAULT_POLICY, SkewPolicy, lookup_join

STATISTICS = ("cnt", "red_rate_all", "labeled_rate_all", "red_share_labeled")


class PriorTables(dict):
    """Key -> prior table, with the number of rows of each."""

    def __init__(self, *args):
        super().__init__(*args)
        self.rows = {}

    def keep(self, columns) -> "PriorTables":
        """The same tables with only some of their columns: key -> {column: new name}."""
        kept = PriorTables({
            key: table.select(key, *[F.col(c).alias(n) for c, n in columns(key).items()])
            for key, table in self.items()})
        kept.rows = dict(self.rows)
        return kept


def prior_columns(key: str) -> list[str]:
    return [f"prior_{key}_{s}" for s in STATISTICS]


def fit_rows(df: DataFrame, holdout_start=None, time: str = "event_ts") -> DataFrame:
    """Training rows to fit on. With a holdout start, its labels stay out of the priors."""
    train = df.where(F.col("period") == "train")
    if holdout_start is not None:
        train = train.where(F.col(time) < F.lit(holdout_start).cast("timestamp"))
    return train


def fit(events: DataFrame, labels: DataFrame | None, keys=fv.PRIOR_KEYS,
        cnt_smooth: float = fv.PRIOR_COUNT_SMOOTHING,
        lbl_smooth: float = fv.PRIOR_LABELLED_SMOOTHING) -> "PriorTables":
    """Key -> prior table. ``events`` already carries ``target`` when ``labels`` is None.

    The tables are stored; ``PriorTables.rows`` holds their sizes.
    """
    keys = list(keys)
    if labels is not None:
        events = events.select("event_id", *keys).join(labels, "event_id", "left")
    counted = (
        events.groupingSets([[k] for k in keys], *keys)
        .agg(F.grouping_id(*keys).alias("_set"), F.count(F.lit(1)).alias("cnt"),
             F.count("target").alias("lbl"),
             F.coalesce(F.sum("target"), F.lit(0)).cast("double").alias("red"))
    )
    counted = materialise(counted)
    sizes = {r["_set"]: r["count"] for r in counted.groupBy("_set").count().collect()}
    tables = PriorTables()
    for i, key in enumerate(keys):
        # grouping_id has a bit per key, set when the key is not part of the group
        this_set = (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
        tables.rows[key] = sizes.get(this_set, 0)
        red, lbl, cnt = F.col("red"), F.col("lbl"), F.col("cnt")
        tables[key] = counted.where(F.col("_set") == this_set).select(
            F.col(key),
            cnt.alias(f"prior_{key}_cnt"),
            ((red + fv.PRIOR_NUMERATOR) / (cnt + cnt_smooth)).alias(f"prior_{key}_red_rate_all"),
            ((lbl + fv.PRIOR_NUMERATOR) / (cnt + cnt_smooth)).alias(f"prior_{key}_labeled_rate_all"),
            ((red + fv.PRIOR_NUMERATOR) / (lbl + lbl_smooth)).alias(f"prior_{key}_red_share_labeled"),
        )
    return tables


def apply(df: DataFrame, tables: dict[str, DataFrame],
          policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Attach every prior table; an unseen category leaves its columns null."""
    rows = getattr(tables, "rows", {})
    for key, table in tables.items():
        df = lookup_join(df, table, key, "left", policy, right_rows=rows.get(key))
    return df
