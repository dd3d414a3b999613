"""Reports over prediction files and labelled events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import compare, normalise, periods, predictions, profile, sampling
from ..operators.lineage import materialise
from ..operators.rolling import Gap, timeline_features, velocity_specs
from ..operators.skew import DEFAULT_POLICY, SkewPolicy
from ..sources import readers, sinks


def prediction_report(files: dict[str, DataFrame], bins: int = fv.HISTOGRAM_BINS) -> dict:
    """Disagreement table, most disputed events, score correlations and histograms."""
    table = materialise(compare.disagreement(predictions.merge_predictions(files)))
    scores = [c for c in table.columns if c.startswith("pred_")]
    return {
        "disagreement": compare.by_disagreement(table),
        "most_disputed": compare.most_disputed(table),
        "correlations": compare.correlation_matrix(table, scores),
        "histograms": profile.histogram(table, ["mean_pred", "std_pred"], bins),
    }


def write_prediction_report(spark: SparkSession, files: dict[str, str], out: str) -> None:
    """Read CSV prediction files by name and write every table of the report."""
    readers.existing(spark, list(files.values()))
    report = prediction_report({n: readers.read_predictions(spark, p) for n, p in files.items()})
    for name, df in report.items():
        sinks.write_predictions(df, f"{out}/{name}")


def labelled_features(events: DataFrame, labels: DataFrame, amount: str = "operaton_amt",
                      policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Labelled events with the features that are compared between classes."""
    rows = periods.labelled(periods.attach_labels(events, labels, policy))
    wanted = [s for s in velocity_specs(amount) if s.name in ("amt_1h", "amt_24h", "cnt_24h")]
    rows = timeline_features(rows, wanted, [Gap("seconds_since_prev")], policy=policy)
    return rows.withColumns({"hour": F.hour("event_ts"),
                             "day_of_week": F.weekday("event_ts") + 1})


def class_report(events: DataFrame, labels: DataFrame, features=None,
                 policy: SkewPolicy = DEFAULT_POLICY, negatives: int | None = None) -> dict:
    """Class-conditional densities and the correlation matrix of all labelled rows.

    ``negatives`` asks for a contrast sample of that many negatives instead.
    """
    features = features or fv.PLOTTED_FEATURES
    rows = materialise(labelled_features(events, labels, policy=policy))
    if negatives is not None:
        rows = materialise(sampling.contrast_sample(rows, negatives))
    numeric = normalise.numeric_columns(rows.drop("event_us"))
    return {
        "class_density": profile.class_density(rows, features),
        "correlations": compare.correlation_matrix(rows, numeric),
    }
