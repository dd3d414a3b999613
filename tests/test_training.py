"""Patience, running rates and stored bundles."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgersight.models import boosting, bundle
from ledgersight.models.encode import Encoder, running_rates
from ledgersight.operators import staged
from ledgersight.sources import sinks

SMALL = boosting.Boosting(iterations=8, step=0.3, depth=2, wait=2)


@pytest.mark.parametrize("losses, wait, want", [
    ([5, 4, 4, 4, 3, 2, 2, 2, 2, 2], 2, (2, True)),         # an early plateau ends it
    ([5, 4, 4, 4, 3, 2, 2, 2, 2, 2], 3, (6, True)),         # a longer wait gets over it
    ([5, 4, 4, 4, 3, 2, 2], 4, (6, False)),
    ([3, 2, 1], 5, (3, False)), ([1, 2, 3], 2, (1, True)), ([], 3, (0, False)),
    ([math.nan, 2, 3], 2, (2, False)), ([math.nan] * 3, 1, (3, False))])
def test_best_prefix(spark, losses, wait, want):
    assert boosting.best_prefix(losses, wait) == want
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(losses, 1)], "k string, iteration int, loss double")
    got = staged.stopping_point(df, wait, by=["k"]).collect()
    if any(x == x for x in losses):
        assert got[0].best_iteration == want[0] and (got[0].stopped_at is not None) == want[1]
    else:
        assert got == []


def test_staged_losses_equal_numpy(spark):
    draw = np.random.default_rng(2)
    parts, label, weight = draw.normal(size=(50, 6)) * 40, draw.integers(0, 2, 50), draw.uniform(0, 3, 50)
    df = spark.createDataFrame([(p.tolist(), int(y), float(w)) for p, y, w in zip(parts, label, weight)],
                               "parts array<double>, label int, weight double").repartition(5)
    z = np.cumsum(parts, axis=1) * np.where(label == 1, -1, 1)[:, None]
    want = np.average(np.logaddexp(0, z), axis=0, weights=weight)
    got = {r.iteration: r.loss for r in staged.staged_losses(df, "parts").collect()}
    assert [got[i] for i in range(1, 7)] == pytest.approx(want)
    assert staged.staged_losses(df.limit(0), "parts").count() == 0


@pytest.fixture(scope="module")
def noisy(spark):
    df = spark.range(600).select(
        F.col("id").alias("event_id"), (F.col("id") * 37 % 100 / 100.0).alias("x"), (F.col("id") % 4 == 0).alias("is_val"))
    df = df.withColumn("label", ((F.col("x") > 0.7) != (F.col("event_id") % 7 == 0)).cast("int"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(boosting.weigh_positives(df, 5.0))
    return rows.persist()


def test_fit_keeps_the_best_prefix_of_the_longest_fit(noisy):
    whole, _ = boosting.fit_holdout(noisy.withColumn("is_val", F.lit(False)).where(~F.col("is_val")), SMALL)
    assert whole.getNumTrees == SMALL.iterations                   # no holdout rows: everything is kept
    train = noisy.where("NOT is_val")
    held = noisy.where("is_val").withColumn("label", F.col("label").cast("double"))
    longest, _ = boosting.fit_holdout(train, SMALL)
    losses = boosting.holdout_losses(longest, held)
    # staged losses are the weighted log loss of the truncated models
    for k in (1, 5):
        rows = boosting.score(boosting.truncated(longest, k), held).select("label", "weight", "predict").toPandas()
        p = np.where(rows.label == 1, rows.predict, 1 - rows.predict)
        assert losses[k - 1] == pytest.approx(np.average(-np.log(p), weights=rows.weight))
    for wait in (1, 2, 8):
        model, kept = boosting.fit_holdout(noisy, replace(SMALL, wait=wait))
        assert kept == model.getNumTrees == boosting.best_prefix(losses, wait)[0]
        assert boosting.holdout_losses(model, held) == pytest.approx(losses[:kept])


def test_presets_state_their_wait():
    assert [boosting.preset(n).wait for n in ("main", "ensemble", "full", "single", "stacked")] == [100, 200, 300, 100, 50]


def test_running_rates_do_not_see_their_own_label(spark):
    """Random labels over rare values: full rates follow the label, running rates do not."""
    df = spark.range(4_000).select(F.col("id").alias("event_id"), F.concat(F.lit("c"), F.col("id") % 800).alias("kind"),
                                   (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2))).cast("int").alias("label"))
    fitted = Encoder(["kind"], [], buckets=8).fit(df)
    rate = lambda out: out.select(F.col("label").cast("double"), F.element_at(F.col("v"), 1).alias("r")).corr("label", "r")
    from pyspark.ml.functions import vector_to_array
    with_v = lambda out: out.withColumn("v", vector_to_array("features"))
    assert rate(with_v(fitted.transform(df))) > 0.3
    assert abs(rate(with_v(fitted.transform_training(df, F.lit(True))))) < 0.08


def test_running_rates_equal_a_loop(spark):
    rows = [(i, ["a", "b", None][i % 3], i * 7 % 5, int(i % 4 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, kind string, place int, label int")
    tables, sizes = running_rates(df, ["event_id", "kind"], "label", F.col("place"), buckets=5)
    assert sizes == {"event_id": 60, "kind": 3}
    for r in tables["kind"].collect():
        for b in range(6):
            before = [y for _, k, p, y in rows if k == r.kind and p < b]
            assert r.rates[b] == pytest.approx((sum(before) + 1) / (len(before) + 200))


def test_encoding_is_declared_and_bounded(spark):
    df = spark.createDataFrame([(i, f"k{i % 9}", f"m{i}", 1.0 if i else None, i % 2) for i in range(12)], "event_id int, kind string, many string, x double, label int")
    fitted = Encoder(["kind", "many"], ["x"], indexed=["kind"], max_categories=4).fit(df)
    assert fitted.labels == [["k0", "k1", "k2"]] and fitted.rate_columns == ["rate_many"]       # the most frequent, ties by name
    out = fitted.transform(df.withColumn("kind", F.lit("new"))).first()["features"]
    assert out[0] == 3.0 and out.size == 3
    assert fitted.transform(df.limit(0)).count() == 0


def test_bundles_are_read_back(spark, noisy, tmp_path):
    df = noisy.drop("features").withColumn("kind", F.concat(F.lit("c"), F.col("event_id") % 50))
    encoder = Encoder(["kind"], ["x"]).fit(df.where("NOT is_val"))
    rows = encoder.transform_training(df, ~F.col("is_val"))
    models = {n: boosting.fit_holdout(rows, replace(SMALL, iterations=2, seed=i))[0]
              for i, n in enumerate(("main", "recent", "suspicious", "red_yellow"))}
    weights = {"main": 0.5, "recent": 0.2, "product": 0.3}
    for ensemble in (bundle.EnsembleModel("mean", models), bundle.EnsembleModel("blend", models, weights)):
        path = str(tmp_path / ensemble.kind)
        sinks.save_model(bundle.bundle(encoder, ensemble), path)
        read = bundle.load(path)
        scored = df.select("event_id", "kind", "x")
        want = {r.event_id: r.predict for r in bundle.bundle(encoder, ensemble).transform(scored).collect()}
        assert {r.event_id: r.predict for r in read.transform(scored).collect()} == want and len(want) == 600
        sinks.save_model(read, str(tmp_path / f"{ensemble.kind}_again"))       # and stored once more
    with pytest.raises(ValueError):
        bundle.EnsembleModel("other", models)
