"""Runs over the standard file layout: read, build, train, score, write.

``data`` holds pretrain*/train_part_*/pretest*/test* Parquet files, train_labels.parquet
and, for the full job, sample_submit.csv.
"""

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from . import fixed_values as fv
from .models import boosting
from .operators import compare, periods, predictions
from .operators.lineage import materialise
from .plans import ensemble, full, reports
from .plans.velocity import VelocityConfig, scored_rows, tagged_features, training_rows
from .sources import readers, sinks

# --- fixed values: how the velocity runs differ -----------------------------------------
VELOCITY_RUNS = {
    "recent": {
        "features": VelocityConfig(history_days=0), "preset": "main", "seeds": fv.SEEDS_FIVE,
        "holdout_start": fv.FIXED_HOLDOUT_START, "pos_weight": 10.0, "history": ("pretest",)},
    "history": {
        "features": VelocityConfig(label_rule="labelled", sample_keep=1, sample_modulus=20),
        "preset": "main", "seeds": fv.SEEDS_FIVE, "holdout_start": None, "pos_weight": 10.0,
        "history": ("pretrain", "train", "pretest")},
    "ensemble": {
        "features": VelocityConfig(label_rule="labelled", sample_keep=1, sample_modulus=10),
        "preset": "ensemble", "seeds": fv.SEEDS_TEN, "holdout_start": None, "pos_weight": None,
        "fallback": 10.0, "history": ("pretrain", "train", "pretest")},
    "bounded": {
        "features": VelocityConfig(label_rule="labelled", sample_keep=1, sample_modulus=50,
                                   history_days=fv.HISTORY_DAYS,
                                   scored_history_days=fv.HISTORY_DAYS),
        "preset": "ensemble", "seeds": fv.SEEDS_TEN, "holdout_start": None, "pos_weight": None,
        "history": ("train", "pretest")},
}


def _inputs(spark, data):
    frames = readers.read_period_files(spark, data)
    for period in ("train", "test"):
        if period not in frames:
            raise FileNotFoundError(f"no {period} files under {data}")
    return frames, readers.read_labels(spark, f"{data}/train_labels.parquet")


def _history(frames, names) -> DataFrame | None:
    parts = [frames[n] for n in names if n in frames]
    return reduce(lambda a, b: periods.union_diagonal(a, b), parts) if parts else None


def _ensemble_config(run, scale, seeds, learner):
    return ensemble.EnsembleConfig(
        learner=learner or boosting.preset(run["preset"], scale),
        seeds=tuple(run["seeds"][:seeds]), holdout_start=run["holdout_start"],
        pos_weight=run["pos_weight"], weight_fallback=run.get("fallback", 1.0))


def velocity_run(spark: SparkSession, data: str, out: str, name: str = "recent",
                 scale: float = 1.0, seeds: int | None = None, features=None, learner=None,
                 holdout_start="preset") -> DataFrame:
    """Bagged boosted trees on velocity features; writes out/predictions and the bundle out/model."""
    run = dict(VELOCITY_RUNS[name])
    if holdout_start != "preset":
        run["holdout_start"] = holdout_start
    frames, labels = _inputs(spark, data)
    config = features or run["features"]
    train = training_rows(frames.get("pretrain") if "pretrain" in run["history"] or config.history_days
                          else None, frames["train"], labels, config)
    scored = scored_rows(_history(frames, run["history"]), frames["test"], config)
    scores, precision, fitted = ensemble.bagged(train, scored, _ensemble_config(run, scale, seeds, learner))
    precision.show(truncate=False)
    sinks.save_model(fitted, f"{out}/model")
    sinks.write_predictions(predictions.submission(scores), f"{out}/predictions")
    return readers.read_predictions(spark, f"{out}/predictions")


def single_run(spark: SparkSession, data: str, out: str, scale: float = 1.0, learner=None,
               cut: str = fv.FIXED_HOLDOUT_START) -> DataFrame:
    """One model over the tagged union of all periods; writes out/predictions and out/model."""
    frames, labels = _inputs(spark, data)
    rows = materialise(tagged_features(frames, labels))
    train = periods.labelled(rows.where("split_group = 'train'"))
    config = ensemble.EnsembleConfig(
        learner=learner or boosting.preset("single", scale), seeds=(fv.SEED,), holdout_start=cut,
        pos_weight=1.0)
    scores, precision, fitted = ensemble.bagged(train, rows.where("split_group = 'test'"), config)
    precision.show(truncate=False)
    sinks.save_model(fitted, f"{out}/model")
    sinks.write_predictions(predictions.submission(scores), f"{out}/predictions")
    return readers.read_predictions(spark, f"{out}/predictions")


def stacked_run(spark: SparkSession, data: str, out: str, scale: float = 1.0,
                seeds: int | None = None, features: VelocityConfig | None = None, learner=None,
                holdout_start: str = fv.FIXED_HOLDOUT_START, trees: int = 50) -> DataFrame:
    """Two learners per fold with rotating negatives and a logistic meta-model."""
    frames, labels = _inputs(spark, data)
    base = features or VelocityConfig(history_days=0, sample_keep=fv.ROTATION_KEEP_PERCENT,
                                      sample_stage="before")
    config = ensemble.EnsembleConfig(
        learner=learner or boosting.preset("stacked", scale), seeds=fv.SEEDS_FIVE[:seeds],
        holdout_start=holdout_start, pos_weight=fv.BOOSTING_PRESETS["stacked"]["pos_weight"])

    def fold(i):
        return training_rows(None, frames["train"], labels,
                             replace(base, sample_offset=i * fv.ROTATION_STEP))

    scored = scored_rows(_history(frames, ("pretest",)), frames["test"], base)
    scores, fitted = ensemble.stacked(fold, scored, config, trees)
    sinks.save_model(fitted, f"{out}/model")
    sinks.write_predictions(predictions.submission(scores), f"{out}/predictions")
    return readers.read_predictions(spark, f"{out}/predictions")


def full_run(spark: SparkSession, data: str, out: str, config: full.FullConfig | None = None,
             force: bool = True, scale: float = 1.0) -> DataFrame:
    """History features, priors, four models and the blend, checked against the template.

    The feature table is kept at out/features and reused when ``force`` is off.
    """
    config = config or full.FullConfig(
        learner=boosting.preset("full", scale),
        refit_least=max(1, round(fv.REFIT_MIN_ITERATIONS * scale)))
    frames, labels = _inputs(spark, data)
    hot = periods.hot_customers(frames.values(), config.policy)
    log = full.labelled_log(frames, labels, config.policy, hot)
    table = sinks.reuse_or_write(
        spark, f"{out}/features",
        lambda: full.with_priors(full.feature_table(log, config, hot=hot), log, config), force)
    scores, searched, fitted, report = full.run(table, config)
    sinks.save_model(fitted, f"{out}/model")
    sinks.write_predictions(searched, f"{out}/blend_search")
    sinks.write_predictions(report, f"{out}/holdout_report")
    template = readers.read_template(spark, f"{data}/sample_submit.csv")
    sinks.write_predictions(full.submit(scores, template), f"{out}/predictions")
    return readers.read_predictions(spark, f"{out}/predictions")


def class_report_run(spark: SparkSession, data: str, out: str) -> None:
    """Class densities and correlations of labelled training events."""
    from .operators.normalise import normalise_strict
    frames, labels = _inputs(spark, data)
    for name, df in reports.class_report(normalise_strict(frames["train"]), labels).items():
        sinks.write_predictions(df, f"{out}/{name}")


def compare_run(spark: SparkSession, data: str, out: str, first: str, second: str) -> DataFrame:
    """Label counts, and the correlation of two prediction files."""
    labels = readers.read_labels(spark, f"{data}/train_labels.parquet")
    sinks.write_predictions(labels.groupBy("target").count(), f"{out}/label_counts")
    pair = predictions.join_suffixed(
        readers.read_predictions(spark, first), readers.read_predictions(spark, second))
    found = compare.correlation(pair, "predict", "predict_new")
    sinks.write_predictions(found, f"{out}/correlation")
    return found
