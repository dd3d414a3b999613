"""Average precision and the search for blend weights."""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.probability import weighted_sum
from .lineage import materialise
from .packed_curves import wide_precision
from .skew import null_safe_join

RANGE_ROWS = 1_000_000
MAX_POSITIVES = 100_000     # whose scores the tasks of a blend search share
SHARED_SCORES = 2_000_000   # numbers broadcast in one pass of it, 16 MB


def average_precision(df: DataFrame, score: str = "score", label: str = "label", by=(),
                      rows_per_group: int | None = None,
                      range_rows: int = RANGE_ROWS) -> DataFrame:
    """Step-wise area under the precision-recall curve, tied scores as one threshold.

    One row per ``by`` group with columns ap, n_pos, n_rows; ap is null without positives.
    Groups of at most ``range_rows`` rows are walked with one window each. Larger ones are
    combined per score and cut into score ranges (see ``_by_ranges``), so no curve is
    walked in one task. ``rows_per_group`` is a bound on the group size, counted if absent.
    """
    by = list(by)
    rows = df.select(*by, F.col(score).cast("double").alias("score"),
                     F.col(label).cast("bigint").alias("tp"))
    if rows_per_group is None:
        rows_per_group = df.count()
    if rows_per_group <= range_rows:
        # peers of a range frame are the tied scores
        above = W.partitionBy(*by).orderBy(F.desc("score")).rangeBetween(
            W.unboundedPreceding, W.currentRow)
        curve = rows.select(*by, "tp", F.lit(1).alias("n"), F.sum("tp").over(above).alias("ctp"),
                            F.count(F.lit(1)).over(above).alias("cn"))
    else:
        curve = _by_ranges(rows, by, range_rows)
    term = F.col("tp") * F.col("ctp").cast("double") / F.col("cn")
    return (
        curve.groupBy(*by)
        .agg(F.sum(term).alias("area"), F.sum("tp").alias("n_pos"), F.sum("n").alias("n_rows"))
        .select(*by, F.try_divide(F.col("area"), F.col("n_pos").cast("double")).alias("ap"),
                "n_pos", "n_rows")
    )


def _by_ranges(rows: DataFrame, by, range_rows: int) -> DataFrame:
    """Per distinct score: tp, n and the counts ctp, cn at or above the score.

    Counts are taken inside a range of scores and added to the totals of all higher ranges.
    """
    steps = materialise(rows.groupBy(*by, "score").agg(
        F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("n")))
    steps = score_ranges(steps, by, range_rows)
    totals = steps.groupBy(*by, "_range").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    higher = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *by, "_range", F.coalesce(F.sum("tp").over(higher), F.lit(0)).alias("tp_above"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("n_above"))
    inside = (W.partitionBy(*by, "_range").orderBy(F.desc("score"))
              .rowsBetween(W.unboundedPreceding, 0))
    curve = steps.select(
        *by, "_range", "tp", "n",
        F.sum("tp").over(inside).alias("ctp"), F.sum("n").over(inside).alias("cn"))
    return null_safe_join(curve, carried, [*by, "_range"], "inner").select(
        *by, "tp", "n", (F.col("ctp") + F.col("tp_above")).alias("ctp"),
        (F.col("cn") + F.col("n_above")).alias("cn"))


def score_ranges(steps: DataFrame, by, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add _range to rows with distinct (by, score): it rises as the scores of a group fall.

    Ranges are those of a sort by group and score, so each group has borders of its own, however narrow
    its scores lie. Borders come from Spark's sample of the keys; while a range holds over
    4 * ``range_rows`` rows, twice as many are cut. Only counts reach the driver.
    """
    order = [*[F.col(c) for c in by], F.col("score").desc_nulls_last()]
    ranges = steps.count() // range_rows + 1
    while True:
        cut = materialise(steps.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
        fullest = cut.groupBy("_range").count().agg(F.max("count")).first()[0]
        if fullest is None or fullest <= 4 * range_rows:
            return cut
        ranges *= 2


def blend_scores(df: DataFrame, main: str = "main", recent: str = "recent",
                 product: str = "product", label: str = "label", main_steps=fv.BLEND_MAIN_STEPS,
                 recent_steps=fv.BLEND_RECENT_STEPS, steps: int = fv.BLEND_STEPS) -> DataFrame:
    """A blended score per row and weight triple, weights counted in 1/steps.

    The three weights add up to one and none is negative. The grid has a fixed size, so
    the rows grow by a constant factor.
    """
    m, r = F.col("main_step"), F.col("recent_step")
    wide = (
        df.select(F.col(main).alias("a"), F.col(recent).alias("b"), F.col(product).alias("c"),
                  F.col(label).alias("label"))
        .withColumn("main_step", F.explode(F.sequence(F.lit(main_steps[0]), F.lit(main_steps[1]))))
        .withColumn("recent_step", F.explode(F.sequence(F.lit(recent_steps[0]), F.lit(recent_steps[1]))))
        .where(m + r <= steps)
    )
    w = _weights(steps)
    blended = w["w_main"] * F.col("a") + w["w_recent"] * F.col("b") + w["w_product"] * F.col("c")
    return wide.select(m, r, blended.alias("score"), "label")


def _triples(steps: int) -> list[tuple[int, int]]:
    return [(m, r) for m in range(fv.BLEND_MAIN_STEPS[0], fv.BLEND_MAIN_STEPS[1] + 1)
            for r in range(fv.BLEND_RECENT_STEPS[0], fv.BLEND_RECENT_STEPS[1] + 1) if m + r <= steps]


def _weights(steps):
    m, r = F.col("main_step"), F.col("recent_step")
    return {"w_main": m / float(steps), "w_recent": r / float(steps),
            "w_product": (steps - m - r) / float(steps)}


def blend_search(df: DataFrame, range_rows: int = RANGE_ROWS, steps: int = fv.BLEND_STEPS, most_positives: int = MAX_POSITIVES,
                 **columns) -> DataFrame:
    """Average precision of every weight triple: w_main, w_recent, w_product, ap.

    Precision changes only at the scores of positives. Up to ``most_positives`` of them (counted) are shared with
    the tasks, which count for all triples how many of their rows fall between two positives' scores; only
    counts are shuffled. With more positives, tasks send their sorted scores of every triple in compressed
    blocks (see ``packed_curves``).
    """
    names = dict(main="main", recent="recent", product="product", label="label") | columns
    df = materialise(df.select(*dict.fromkeys(names.values())))         # read several times
    positives = df.where(F.col(names["label"]) == 1).select(*[F.col(names[c]).cast("double").alias(c) for c in ("main", "recent", "product")])
    if positives.count() <= most_positives:
        found = _precision_of_blends(df, names, np.array(positives.collect(), dtype=float).reshape(-1, 3), steps)
    else:
        triples = _triples(steps)
        curves = [[(m / float(steps), names["main"]), (r / float(steps), names["recent"]),
                   ((steps - m - r) / float(steps), names["product"])] for m, r in triples]
        m, r = (F.array(*[F.lit(t[i]) for t in triples])[F.col("curve")] for i in (0, 1))
        found = wide_precision(df, curves, names["label"], range_rows).withColumns({"main_step": m, "recent_step": r})
    return found.select(*[c.alias(n) for n, c in _weights(steps).items()], "ap")


def _precision_of_blends(df: DataFrame, names: dict, positives: np.ndarray, steps: int) -> DataFrame:
    """main_step, recent_step, ap, for positives that fit the driver."""
    spark = df.sparkSession
    triples = _triples(steps)
    kind = "main_step int, recent_step int, ap double"
    if not len(positives):
        return spark.createDataFrame([(m, r, None) for m, r in triples], kind)
    rows = df.select(*[F.col(names[c]).cast("double").alias(c) for c in ("main", "recent", "product")])

    def blended(a, b, c, m, r):             # the order of operations of blend_scores
        return m / float(steps) * a + r / float(steps) * b + (steps - m - r) / float(steps) * c

    out, each = None, max(1, SHARED_SCORES // len(positives))
    for first in range(0, len(triples), each):
        group = triples[first:first + each]
        borders = [np.unique(blended(*positives.T, m, r), return_counts=True) for m, r in group]
        shared = spark.sparkContext.broadcast([b for b, _ in borders])     # SHARED_SCORES numbers at most

        def count(batches, group=group, shared=shared):
            totals = [np.zeros(len(b) + 1, dtype=np.int64) for b in shared.value]
            for batch in batches:
                a, b, c = (batch[x].to_numpy(zero_copy_only=False) for x in ("main", "recent", "product"))
                for (m, r), border, total in zip(group, shared.value, totals):
                    total += np.bincount(np.searchsorted(border, blended(a, b, c, m, r), side="right"), minlength=len(border) + 1)
            yield pa.record_batch({"triple": pa.array(range(len(group)), pa.int32()),
                                   "counts": pa.array(totals, pa.list_(pa.int64()))})

        summed = rows.mapInArrow(count, "triple int, counts array<bigint>").groupBy("triple").agg(
            vector_to_array(Summarizer.sum(array_to_vector(F.col("counts").cast("array<double>")))).alias("counts"))

        def finish(batches, group=group, hits=[h for _, h in borders], positives=len(positives)):
            for batch in batches:
                for triple, counts in zip(batch["triple"].to_pylist(), batch["counts"]):
                    above = np.cumsum(counts.values.to_numpy()[::-1])[::-1][1:]        # rows at or above each border
                    tp = np.cumsum(hits[triple][::-1])[::-1]
                    yield pa.record_batch({"main_step": pa.array([group[triple][0]], pa.int32()), "recent_step": pa.array([group[triple][1]], pa.int32()),
                                           "ap": pa.array([float((hits[triple] * tp / above).sum() / positives)])})

        part = summed.mapInArrow(finish, kind)
        out = part if out is None else out.unionByName(part)
    return out


def best_blend(searched: DataFrame) -> DataFrame:
    """The best triple; on equal precision the first in grid order.

    Precisions are compared to 12 digits: the order of summation moves the last ones.
    """
    return searched.orderBy(F.desc(F.round("ap", 12)), "w_main", "w_recent").limit(1)


def fixed_blend(main: str = "main", recent: str = "recent"):
    return weighted_sum({main: fv.FIXED_BLEND["main"], recent: fv.FIXED_BLEND["recent"]})


def holdout_report(df: DataFrame, weights: dict, subset: str | None = None, main: str = "main", recent: str = "recent",
                   product: str = "product", label: str = "label", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Average precision of each score of the holdout and of its blends: score, ap, n_pos, n_rows.

    Scores are main, recent, product, fixed (the fixed blend) and best (``weights`` of main, recent and product). With
    ``subset``, a boolean column, also recent_aligned: the recent score where it holds, its mean there elsewhere.
    All curves come from one pass. Up to ``range_rows`` rows grow by the number of scores; more are sent as
    compressed blocks (see ``packed_curves``).
    """
    df = materialise(df.select(*dict.fromkeys([main, recent, product, label, *([subset] if subset else [])])))
    scores = {"main": F.col(main), "recent": F.col(recent), "product": F.col(product), "fixed": fixed_blend(main, recent),
              "best": weighted_sum({c: weights[name] for name, c in (("main", main), ("recent", recent), ("product", product))})}
    if subset:
        mean = df.where(subset).agg(F.avg(recent)).first()[0]
        scores["recent_aligned"] = F.when(F.col(subset), F.col(recent)).otherwise(F.lit(mean))
    rows = df.count()
    if rows > range_rows:
        names = F.array(*[F.lit(name) for name in scores])
        wide = df.select(F.col(label).alias("_label"), *[value.alias(name) for name, value in scores.items()])
        found = wide_precision(wide, [[(1.0, name)] for name in scores], "_label", range_rows)
        return found.select(names[F.col("curve")].alias("score"), "ap", "n_pos", "n_rows")
    stacked = df.select(F.col(label).alias("label"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), value.cast("double").alias("value")) for name, value in scores.items()])).alias("s"))
    return average_precision(stacked.select("s.*", "label"), "value", "label", by=["name"], rows_per_group=rows,
                             range_rows=range_rows).withColumnRenamed("name", "score")
