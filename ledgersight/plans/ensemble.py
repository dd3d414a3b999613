"""Bagged, single-model and stacked scoring of velocity rows."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..models import boosting, stacking
from ..models.bundle import EnsembleModel, bundle
from ..models.encode import Encoder, EncoderModel
from ..operators import evaluate, normalise, splits
from ..operators.lineage import materialise
from ..operators.skew import DEFAULT_POLICY, SkewPolicy
from ..sources.readers import require_rows


@dataclass(frozen=True)
class EnsembleConfig:
    """``holdout_start`` None means the last ``holdout_days``; ``pos_weight`` None means the
    weight follows from the class counts."""

    learner: boosting.Boosting = boosting.Boosting()
    seeds: tuple = fv.SEEDS_FIVE
    holdout_start: str | None = fv.FIXED_HOLDOUT_START
    holdout_days: int = fv.HOLDOUT_DAYS
    pos_weight: float | None = 10.0
    weight_fallback: float = 1.0
    policy: SkewPolicy = DEFAULT_POLICY


def with_holdout(train: DataFrame, config: EnsembleConfig) -> DataFrame:
    """Add is_val and label."""
    train = train.withColumn("label", F.col("target"))
    if config.holdout_start is None:
        return splits.mark_holdout(train, config.holdout_days)
    return train.withColumn("is_val", splits.fixed_holdout(config.holdout_start))


def fit_encoder(train: DataFrame, config: EnsembleConfig) -> EncoderModel:
    """Encoder over the velocity features, fitted on the rows before the holdout."""
    helpers = ("label", "is_val")
    _, categorical, numeric = normalise.velocity_feature_columns(
        [c for c in train.columns if c not in helpers])
    typed = normalise.numeric_columns(train, ())
    return Encoder(categorical, [c for c in numeric if c in typed],
                   policy=config.policy).fit(train.where(~F.col("is_val")))


def encoded(encoder: EncoderModel, train: DataFrame, config: EnsembleConfig) -> DataFrame:
    """Rows ready for a learner: event_id, label, weight, is_val, features."""
    weight = config.pos_weight
    if weight is None:
        weight = splits.positive_weight(train.where(~F.col("is_val")), "label",
                                        fallback=config.weight_fallback).first()[0]
    rows = boosting.weigh_positives(encoder.transform_training(train, ~F.col("is_val")), weight)
    return materialise(rows.select("event_id", "label", "weight", "is_val", "features"))


def bagged(train: DataFrame, scored: DataFrame, config: EnsembleConfig = EnsembleConfig()):
    """(scores of ``scored``, holdout precision per seed, bundle).

    ``train`` and ``scored`` are velocity rows; a single seed gives a single model.
    """
    train = with_holdout(require_rows(materialise(train), "training table"), config)
    encoder = fit_encoder(train, config)
    rows = encoded(encoder, train, config)
    models = boosting.fit_bag(rows, config.learner, config.seeds)
    held = boosting.score_bag(models, rows.where("is_val"), keep_members=True)
    per_seed = materialise(held.select("label", F.explode(F.array(*[
        F.struct(F.lit(seed).alias("seed"), F.col(f"predict_{i}").alias("score"))
        for i, seed in enumerate(config.seeds)])).alias("s")).select("label", "s.*"))
    precision = evaluate.average_precision(per_seed, by=["seed"])
    fitted = bundle(encoder, EnsembleModel("mean", {f"seed_{seed}": m for seed, m in zip(config.seeds, models)}))
    return fitted.transform(scored).select("event_id", "predict"), precision, fitted


def stacked(fold_rows, scored: DataFrame, config: EnsembleConfig = EnsembleConfig(),
            trees: int = 50):
    """(scores, bundle). ``fold_rows(i)`` gives the velocity rows of fold i.

    The encoder comes from the first fold, so all models read the same feature vector.
    """
    first = with_holdout(materialise(fold_rows(0)), config)
    encoder = fit_encoder(first, config)

    def rows(i):
        fold = first if i == 0 else with_holdout(fold_rows(i), config)
        return encoded(encoder, fold, config)

    models, meta, _ = stacking.fit_stack(rows, config.learner, config.seeds, trees)
    members = {f"{learner}_{i}": m for learner in stacking.LEARNERS for i, m in enumerate(models[learner])}
    fitted = bundle(encoder, EnsembleModel("stack", {**members, "meta": meta}))
    return fitted.transform(scored).select("event_id", "predict"), fitted
