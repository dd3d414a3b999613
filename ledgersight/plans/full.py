"""The full job: history features, priors, four models, blend and checked output."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import labels as label_rules
from ..functions.hashing import bucket
from ..models import boosting
from ..models.bundle import EnsembleModel, bundle, heads
from ..models.encode import Encoder
from ..operators import evaluate, impute, late, normalise, periods, predictions, priors, sampling, splits
from ..operators.history import HistoryColumns, history_features
from ..operators.lineage import materialise
from ..operators.skew import DEFAULT_POLICY, SkewPolicy


@dataclass(frozen=True)
class FullConfig:
    """``leak_free_priors`` keeps the labels of the holdout out of the priors."""

    sample_border: str = fv.SAMPLE_BORDER
    recent_border: str = fv.RECENT_BORDER
    holdout_start: str = fv.FULL_HOLDOUT_START
    leak_free_priors: bool = True
    refit: bool = True
    refit_least: int = fv.REFIT_MIN_ITERATIONS
    hasher: object = bucket
    learner: boosting.Boosting = boosting.Boosting()
    policy: SkewPolicy = DEFAULT_POLICY


def labelled_log(frames: dict[str, DataFrame], labels: DataFrame,
                 policy: SkewPolicy = DEFAULT_POLICY, hot="find") -> DataFrame:
    """Normalised log over all periods with labels and the three-way raw target."""
    parts = {p: normalise.normalise_lenient(normalise.keep_existing(df, fv.EVENT_COLUMNS))
             for p, df in frames.items()}
    log = periods.tagged_union(parts, policy=policy, hot=hot)
    return periods.attach_labels(log, labels, policy).withColumn(
        "train_target_raw", label_rules.three_way())


def feature_table(log: DataFrame, config: FullConfig = FullConfig(),
                  columns: HistoryColumns = HistoryColumns(), hot="find") -> DataFrame:
    """Meta columns, event features and history of sampled training and test rows.

    ``hot`` is the result of ``periods.hot_customers`` over the raw frames, if at hand.
    """
    log = sampling.mark_samples(log, config.sample_border, hasher=config.hasher)
    log = log.withColumn("event_date", F.to_date("event_ts"))
    kept = F.col("is_train_sample") | F.col("is_test")
    # the sample is known before the windows: rows outside it pass them without their wide columns
    narrow = late.fold(log, [*columns.inputs(), "is_train_sample", "is_test"], kept)
    rows = late.unfold(history_features(narrow, columns, policy=config.policy, hot=hot).where(kept))
    # features of the single event are computed last, for the rows that are kept
    rows = normalise.add_event_features(rows).withColumn("target_bin", label_rules.red_vs_rest())
    wanted = fv.META_COLUMNS + fv.CATEGORICAL_FEATURES + fv.EVENT_FEATURES + fv.HISTORY_FEATURES
    return normalise.keep_existing(rows, dict.fromkeys(wanted))


def with_priors(features: DataFrame, log: DataFrame, config: FullConfig = FullConfig(),
                keys=fv.PRIOR_KEYS) -> DataFrame:
    """Attach category priors; categories unseen in training get the column mean."""
    start = config.holdout_start if config.leak_free_priors else None
    tables = priors.fit(priors.fit_rows(log, start), None, keys)
    joined = materialise(priors.apply(features, tables, config.policy))
    return impute.fill_means(joined, [c for k in keys for c in priors.prior_columns(k)])


def model_frames(table: DataFrame, config: FullConfig = FullConfig()):
    """(name -> rows (label, weight, is_val, features) of the four models, encoder)."""
    _, categorical, numeric = normalise.feature_columns(table.columns)
    train = table.where("is_train_sample").withColumn(
        "is_val", splits.fixed_holdout(config.holdout_start)).withColumn("label", F.col("target_bin"))
    encoder = Encoder(categorical, numeric, policy=config.policy).fit(train.where(~F.col("is_val")))
    meta = ["event_id", "event_ts", "train_target_raw", "target_bin", "is_val"]
    train = materialise(encoder.transform_training(train, ~F.col("is_val")).select(*meta, "features"))

    def frame(rows, label, weight):
        return rows.withColumns({"label": label, "weight": weight})

    labelled = train.where(F.col("train_target_raw") != -1)
    return {
        "main": frame(train, F.col("target_bin"), label_rules.main_weight()),
        "recent": frame(train.where(splits.recent_subset(config.recent_border)),
                        F.col("target_bin"), label_rules.main_weight()),
        "suspicious": frame(train, label_rules.suspicious(), label_rules.suspicious_weight()),
        "red_yellow": frame(labelled, F.col("target_bin"), label_rules.red_yellow_weight()),
    }, encoder


def run(table: DataFrame, config: FullConfig = FullConfig()):
    """(scores of the test rows, searched blend weights, bundle, holdout report).

    Models are fitted on the rows before the holdout, blended where the holdout's average
    precision is best, refitted on all rows, and blended with the same weights.
    """
    frames, encoder = model_frames(table, config)
    fitted = {name: boosting.fit_holdout(rows, config.learner) for name, rows in frames.items()}
    held = frames["main"].where("is_val").select(
        "event_id", "label", "features", splits.recent_subset(config.recent_border).alias("in_recent"))
    held = materialise(heads(held, {n: m for n, (m, _) in fitted.items()}))
    searched = materialise(evaluate.blend_search(held))
    best = evaluate.best_blend(searched).first()
    models = {n: m for n, (m, _) in fitted.items()}
    if config.refit:
        models = {n: boosting.refit(frames[n], config.learner, best_iterations, config.refit_least)
                  for n, (_, best_iterations) in fitted.items()}
    weights = {"main": best["w_main"], "recent": best["w_recent"], "product": best["w_product"]}
    report = evaluate.holdout_report(held, weights, "in_recent")
    fitted = bundle(encoder, EnsembleModel("blend", models, weights))
    return fitted.transform(table.where("is_test")).select("event_id", "predict"), searched, fitted, report


def submit(scores: DataFrame, template: DataFrame) -> DataFrame:
    return predictions.submission(scores, template)
