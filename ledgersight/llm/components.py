"""Connected components by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id it is connected with) of every id in ``edges`` (columns a, b).

    Each round gives every id the neighbour of lowest rank, itself included, by ranks drawn anew from
    the round's number, and contracts the edges; a constant share of ids goes per round whatever the
    ids' order. Only the number of edges left comes to the driver. Rounds read stored tables.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label, round_ = None, 0
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(round_), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = left.select(F.col("a").alias("id"), rank("b").alias("r")).unionByName(
            left.select(F.col("b").alias("id"), rank("a").alias("r")))
        best = both.groupBy("id").agg(F.min("r").alias("r"))
        own = F.struct(F.xxhash64(F.lit(round_), "id").alias("h"), F.col("id").alias("to"))
        step = materialise(best.select("id", F.least("r", own)["to"].alias("to")))
        a, b = (step.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        left = materialise(left.join(a, "a").join(b, "b").where("a_to <> b_to").select(
            F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        if label is None:
            label = step.select("id", F.col("to").alias("label"))
        else:
            label = materialise(label.join(step.select(F.col("id").alias("label"), "to"), "label", "left")
                                .select("id", F.coalesce("to", "label").alias("label")))
        round_ += 1
    if label is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = materialise(label.groupBy("label").agg(F.min("id").alias("component")))
    return label.join(least, "label").select("id", "component")
