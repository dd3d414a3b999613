"""Boosted trees with a holdout, refits and seed bagging."""

import math
from dataclasses import dataclass, replace

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.rowwise import row_mean
from .encode import MAX_CATEGORIES


@dataclass(frozen=True)
class Boosting:
    """Settings of one boosted model. A subsample below 1 is what makes seeds differ; ``wait`` is the number of
    iterations without a better holdout loss after which training ends."""

    iterations: int = 100
    step: float = 0.1
    depth: int = 6
    subsample: float = 0.7
    seed: int = fv.SEED
    wait: int = 100
    max_bins: int = 2 * MAX_CATEGORIES


def preset(name: str, scale: float = 1.0) -> Boosting:
    """A named preset; a ``scale`` below 1 cuts the iterations and the wait and raises the step to match."""
    p = fv.BOOSTING_PRESETS[name]
    iterations, wait = (max(1, round(p[k] * scale)) for k in ("iterations", "wait"))
    return Boosting(iterations=iterations, wait=wait, step=min(0.3, p["step"] / scale ** 0.5), depth=p["depth"])


def weigh_positives(df: DataFrame, pos_weight, label: str = "label") -> DataFrame:
    """Add weight: ``pos_weight`` (a number or a column) for positives, 1 for the rest."""
    value = pos_weight if hasattr(pos_weight, "cast") else F.lit(float(pos_weight))
    return df.withColumn("weight", F.when(F.col(label) == 1, value).otherwise(F.lit(1.0)))


def _learner(s: Boosting, **extra):
    return GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=s.iterations,
        stepSize=s.step, maxDepth=s.depth, subsamplingRate=s.subsample, seed=s.seed,
        maxBins=s.max_bins, **extra)


def best_prefix(losses, wait: int) -> tuple[int, bool]:
    """(iterations with the least loss, whether training ended there) on a curve of losses.

    The curve is read up to ``wait`` iterations after its best so far; of equal losses the first counts. A curve that
    ends before that has not ended training. NaN is never better; a curve without a number keeps every iteration.
    """
    best, at = math.inf, 0
    for i, loss in enumerate(losses, 1):
        if loss < best:
            best, at = loss, i
        elif at and i - at >= wait:
            return at, True
    return at or len(losses), False


def truncated(model: GBTClassificationModel, iterations: int) -> GBTClassificationModel:
    """The model's first trees."""
    if iterations >= model.getNumTrees:
        return model
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    jvm, java = sc._jvm, model._java_obj
    trees = sc._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, iterations)
    weights = sc._gateway.new_array(jvm.double, iterations)
    for i, (tree, weight) in enumerate(zip(java.trees()[:iterations], java.treeWeights()[:iterations])):
        trees[i], weights[i] = tree, weight
    short = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"{model.uid}_{iterations}", trees, weights, java.numFeatures(), 2)
    # both sides keep the settings: the weight column, for one, only the JVM's model
    return model._copyValues(GBTClassificationModel(java.copyValues(short, jvm.org.apache.spark.ml.param.ParamMap())))


def holdout_losses(model: GBTClassificationModel, held: DataFrame) -> list[float]:
    """Mean weighted log loss on ``held`` of every prefix of the trees, from one pass over the rows."""
    return [loss / 2 for loss in model.evaluateEachIteration(held)]      # the learner's loss is twice the log loss


def fit_holdout(df: DataFrame, settings: Boosting):
    """Fit on ~is_val rows, keep the prefix of trees that is best on is_val rows: (model, iterations kept).

    ``df`` has features, label, weight and is_val. Training ends once ``settings.wait`` iterations bring no better holdout loss.
    The learner cannot go on from a fitted model, but equal settings give equal first trees; so
    the limit starts at twice the wait and doubles until the best lies that far behind, at most twice the work of the last fit.
    Without holdout rows all iterations are kept.
    """
    df = df.withColumn("label", F.col("label").cast("double"))
    train, held = df.where(~F.col("is_val")), df.where("is_val")
    alone = held.isEmpty()
    limit = settings.iterations if alone else min(settings.iterations, 2 * settings.wait)
    while True:
        model = _learner(replace(settings, iterations=limit)).fit(train)
        best, ended = (limit, True) if alone else best_prefix(holdout_losses(model, held), settings.wait)
        if ended or limit >= settings.iterations:
            model = truncated(model, best)
            return model, model.getNumTrees
        limit = min(settings.iterations, 2 * limit)


def refit(df: DataFrame, settings: Boosting, best_iterations: int,
          least: int = fv.REFIT_MIN_ITERATIONS):
    """Fit on all rows without early stopping, for at least ``least`` iterations and never
    more than the holdout fit was allowed."""
    settings = replace(settings, iterations=min(settings.iterations, max(least, best_iterations)))
    return _learner(settings).fit(df.withColumn("label", F.col("label").cast("double")))


def fit_forest(df: DataFrame, seed: int, trees: int = 50, depth: int = 8):
    """A second, different learner for stacking; fits on ~is_val rows."""
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees,
        maxDepth=depth, seed=seed, maxBins=2 * MAX_CATEGORIES)
    return forest.fit(df.where(~F.col("is_val")).withColumn("label", F.col("label").cast("double")))


def score(model, df: DataFrame, name: str = "predict") -> DataFrame:
    """Add the probability of the positive class."""
    out = model.transform(df)
    return out.select(*df.columns, vector_to_array("probability")[1].alias(name))


def log_odds(model, df: DataFrame, name: str = "predict") -> DataFrame:
    """Add log(p / (1 - p)); the trees' own margin is half of it."""
    scored = score(model, df, name)
    p = F.greatest(F.least(F.col(name), F.lit(1 - fv.LOGIT_CLIP)), F.lit(fv.LOGIT_CLIP))
    return scored.withColumn(name, F.log(p / (1 - p)))


def fit_bag(train: DataFrame, settings: Boosting, seeds=fv.SEEDS_FIVE):
    """One model per seed on the same rows."""
    return [fit_holdout(train, replace(settings, seed=seed))[0] for seed in seeds]


def score_bag(models, df: DataFrame, name: str = "predict", keep_members: bool = False) -> DataFrame:
    """Add the mean probability over the models, in one pass over ``df``."""
    members = [f"{name}_{i}" for i in range(len(models))]
    scored = df
    for model, member in zip(models, members):
        scored = score(model, scored, member)
    scored = scored.withColumn(name, row_mean(members))
    return scored if keep_members else scored.drop(*members)
