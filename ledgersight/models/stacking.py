"""Two learners per fold, and a logistic model over their holdout scores."""

from dataclasses import replace
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import materialise
from .boosting import Boosting, fit_forest, fit_holdout, score, score_bag

LEARNERS = ("boosted", "forest")


def stack_holdout(folds) -> DataFrame:
    """Holdout scores of all folds below each other: fold, label, boosted, forest.

    ``folds`` yields (seed, scored holdout rows).
    """
    parts = [df.select(F.lit(seed).alias("fold"), "label", *LEARNERS) for seed, df in folds]
    return reduce(lambda a, b: a.unionByName(b), parts)


def fit_meta(stacked: DataFrame):
    assembled = _assemble(stacked).withColumn("label", F.col("label").cast("double"))
    return LogisticRegression(featuresCol="meta", labelCol="label").fit(assembled)


def fit_stack(fold_rows, settings: Boosting, seeds, trees: int = 50):
    """Fit all folds and the meta-learner.

    ``fold_rows(i)`` returns the training rows of fold i (features, label, weight,
    is_val); folds differ in the negatives they keep and in the seed of both learners. Returns (models per learner,
    meta-model, stacked holdout scores).
    """
    models = {name: [] for name in LEARNERS}
    holdouts = []
    for i, seed in enumerate(seeds):
        rows = fold_rows(i)
        boosted, _ = fit_holdout(rows, replace(settings, seed=seed))
        forest = fit_forest(rows, seed, trees)
        models["boosted"].append(boosted)
        models["forest"].append(forest)
        held = rows.where("is_val")
        holdouts.append((seed, score(forest, score(boosted, held, "boosted"), "forest")))
    stacked = materialise(stack_holdout(holdouts))
    return models, fit_meta(stacked), stacked


def score_stack(models, meta, df: DataFrame, name: str = "predict") -> DataFrame:
    """Mean score per learner over the folds, then the meta-model's probability."""
    for learner in LEARNERS:
        df = score_bag(models[learner], df, learner)
    return score(meta, _assemble(df), name).drop("meta")


def _assemble(df):
    return VectorAssembler(inputCols=list(LEARNERS), outputCol="meta").transform(df)
