"""Losses of growing prefixes of an additive model, and where to stop."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def staged_losses(df: DataFrame, contributions: str, label: str = "label", weight: str = "weight") -> DataFrame:
    """iteration (from 1), loss: mean weighted log loss of the sums of the first contributions.

    ``contributions`` is an array of log-odds, equally long in every row, one entry per member. A row becomes
    an array of losses, and arrays are added by position with map-side sums, so rows are not multiplied by the members.
    No row for an empty table.
    """
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("losses"))
    sign = F.when(F.col(label) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))

    def step(state, x):
        total = state["sum"] + x
        # log(1 + exp(z)) without overflow
        z = sign * total
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        return F.struct(total.alias("sum"), F.concat(state["losses"], F.array(loss)).alias("losses"))

    losses = F.aggregate(contributions, zero, step)["losses"]
    rows = df.select(array_to_vector(losses).alias("losses"), F.col(weight).cast("double").alias("weight"))
    one = F.lit(1).alias("all")         # a key, so that an empty table has no group
    mean = rows.where("weight > 0").groupBy(one).agg(Summarizer.mean(F.col("losses"), F.col("weight")).alias("mean"))
    return mean.select(F.posexplode(vector_to_array("mean")).alias("place", "loss")).select(
        (F.col("place") + 1).alias("iteration"), "loss")


def stopping_point(losses: DataFrame, wait: int, by=()) -> DataFrame:
    """Per curve: best_iteration, best_loss, stopped_at.

    ``losses`` has iteration and loss. The curve is read until ``wait`` iterations have passed since its best so far;
    ``stopped_at`` is null where it ends before. Of equal losses the first is best. Windows are over
    one curve, whose length is the number of iterations.
    """
    by = list(by)
    so_far = W.partitionBy(*by).orderBy("iteration").rowsBetween(W.unboundedPreceding, W.currentRow)
    best = F.min(F.struct("loss", "iteration")).over(so_far)
    read = losses.where(F.col("loss").isNotNull() & ~F.isnan("loss")).withColumn("best", best)
    read = read.withColumn("stop", F.min(F.when(F.col("iteration") - F.col("best.iteration") >= wait, F.col("iteration"))).over(
        W.partitionBy(*by)))
    kept = read.where(F.col("stop").isNull() | (F.col("iteration") <= F.col("stop")))
    return kept.groupBy(*by).agg(F.min(F.struct("loss", "iteration")).alias("best"), F.max("stop").alias("stopped_at")).select(
        *by, F.col("best.iteration").alias("best_iteration"), F.col("best.loss").alias("best_loss"), "stopped_at")
