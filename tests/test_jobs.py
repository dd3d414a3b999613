"""Training, and whole runs from files to predictions."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgersight import jobs
from ledgersight.catalog.plans import CONFIG, full_periods
from ledgersight.catalog.registry import HOLDOUT_START, TRAIN_FROM
from ledgersight.models import boosting, bundle, stacking
from ledgersight.models.encode import Encoder
from ledgersight.operators import evaluate
from ledgersight.plans import reports
from ledgersight.plans.velocity import VelocityConfig
from ledgersight.sources import sinks

SMALL = boosting.Boosting(iterations=4, step=0.3, depth=3)


@pytest.fixture(scope="module")
def learnable(spark):
    """Positives follow from x and a category, with some noise."""
    df = spark.range(600).select(
        F.col("id").alias("event_id"), (F.col("id") * 37 % 100 / 100.0).alias("x"),
        F.concat(F.lit("c"), F.col("id") % 5).alias("kind"), F.concat(F.lit("m"), F.col("id") % 90).alias("many"),
        (F.col("id") % 4 == 0).alias("is_val"))
    noise = F.col("event_id") % 17 == 0
    df = df.withColumn("label", ((F.col("x") > 0.7) != noise).cast("int"))
    encoder = Encoder(["kind", "many"], ["x"], indexed=["kind"]).fit(df.where("NOT is_val"))
    rows = boosting.weigh_positives(encoder.transform_training(df, ~F.col("is_val")), 5.0)
    return rows.select("event_id", "label", "weight", "is_val", "features").persist()


def test_encoder_indexes_few_and_rates_many(learnable):
    assert learnable.first()["features"].size == 3  # index of kind, x, rate of many


def test_boosting_beats_the_base_rate(learnable):
    model, kept = boosting.fit_holdout(learnable, SMALL)
    held = boosting.score(model, learnable.where("is_val"))
    found = evaluate.average_precision(held, "predict").first()
    assert kept <= SMALL.iterations
    assert found["ap"] > 1.5 * found["n_pos"] / found["n_rows"]


def test_bag_is_the_mean_of_members_and_seeds_differ(learnable):
    models = boosting.fit_bag(learnable, SMALL, (1, 2))
    out = boosting.score_bag(models, learnable, keep_members=True).select(
        "predict", "predict_0", "predict_1").toPandas()
    assert out["predict"].values == pytest.approx((out["predict_0"] + out["predict_1"]).values / 2)
    assert (out["predict_0"] != out["predict_1"]).any()


def test_log_odds_and_refit(learnable):
    model = boosting.refit(learnable, SMALL, best_iterations=2, least=3)
    assert model.getNumTrees == 3
    assert boosting.refit(learnable, SMALL, best_iterations=2, least=300).getNumTrees == SMALL.iterations
    out = boosting.log_odds(model, boosting.score(model, learnable, "p"), "z").select("p", "z").toPandas()
    assert (1 / (1 + (-out["z"]).apply(lambda v: 2.718281828459045 ** v))).values == pytest.approx(out["p"].values)


def test_stack_uses_all_folds(learnable):
    models, meta, stacked = stacking.fit_stack(lambda i: learnable, SMALL, (1, 2), trees=3)
    held = learnable.where("is_val").count()
    assert stacked.count() == 2 * held and len(models["forest"]) == 2
    assert models["boosted"][0].getSeed() == 1 and models["boosted"][1].getSeed() == 2
    out = stacking.score_stack(models, meta, learnable.where("NOT is_val").select("event_id", "features"))
    assert out.where("predict BETWEEN 0 AND 1").count() == 600 - held


@pytest.fixture(scope="module")
def data(spark, tables, tmp_path_factory):
    """The standard file layout, written from the given events."""
    base = str(tmp_path_factory.mktemp("data"))
    names = {"pretrain": "pretrain_part_1", "train": "train_part_1", "pretest": "pretest", "test": "test"}
    for period, df in full_periods(tables).items():
        df.write.parquet(f"{base}/{names[period]}.parquet")
        if period == "test":
            df.select("event_id").coalesce(1).write.csv(f"{base}/sample_submit.csv", header=True)
    tables.labels().write.parquet(f"{base}/train_labels.parquet")
    return base


def scored_ids(spark, data):
    return {r[0] for r in spark.read.parquet(f"{data}/test.parquet").select("event_id").collect()}


FEATURES = VelocityConfig(start=TRAIN_FROM, scored_start="2024-01-24", history_days=10,
                          scored_history_days=10, sample_keep=60)


def check(out, ids, rescored=None):
    """``rescored``: what the stored bundle gives for the same events."""
    rows = out.collect()
    assert len(rows) == len(ids) and {r["event_id"] for r in rows} == ids
    assert all(r["predict"] is not None for r in rows)
    return rows


def test_velocity_run(spark, data, tmp_path):
    out = jobs.velocity_run(spark, data, str(tmp_path), "recent", seeds=2, features=FEATURES, learner=SMALL,
                            holdout_start=HOLDOUT_START)
    check(out, scored_ids(spark, data))
    assert sinks.is_complete(spark, str(tmp_path / "predictions"))
    assert bundle.load(str(tmp_path / "model")).stages[1].kind == "mean"


def test_single_run(spark, data, tmp_path):
    check(jobs.single_run(spark, data, str(tmp_path), learner=SMALL, cut=HOLDOUT_START), scored_ids(spark, data))


def test_stacked_run(spark, data, tmp_path):
    features = VelocityConfig(start=TRAIN_FROM, sample_keep=60, sample_stage="before")
    out = jobs.stacked_run(spark, data, str(tmp_path), seeds=2, features=features, learner=SMALL,
                           holdout_start=HOLDOUT_START, trees=3)
    check(out, scored_ids(spark, data))
    assert set(bundle.load(str(tmp_path / "model")).stages[1].members) == {"boosted_0", "boosted_1", "forest_0", "forest_1", "meta"}


def test_full_run_and_reports(spark, data, tmp_path):
    frames = spark.read.parquet(f"{data}/pretrain_part_1.parquet").select("customer_id").distinct()
    known = {r[0] for r in spark.read.parquet(f"{data}/test.parquet").join(frames, "customer_id", "left_semi")
             .select("event_id").collect()}
    assert known == scored_ids(spark, data)  # every test customer has history, so the template is covered
    out = jobs.full_run(spark, data, str(tmp_path / "full"), CONFIG)
    check(out, known)
    stored = bundle.load(str(tmp_path / "full/model")).transform(spark.read.parquet(str(tmp_path / "full/features")).where("is_test"))
    assert {r.event_id: r.predict for r in stored.collect()} == pytest.approx({int(r["event_id"]): float(r["predict"]) for r in out.collect()})
    files = {"a": str(tmp_path / "full/predictions"), "b": str(tmp_path / "full/predictions")}
    reports.write_prediction_report(spark, files, str(tmp_path / "report"))
    disputed = spark.read.csv(str(tmp_path / "report/most_disputed"), header=True)
    assert disputed.count() == 10
    found = jobs.compare_run(spark, data, str(tmp_path / "cmp"), *files.values())
    assert found.first()["corr"] == pytest.approx(1.0)
    jobs.class_report_run(spark, data, str(tmp_path / "classes"))
    assert spark.read.csv(str(tmp_path / "classes/correlations"), header=True).count() > 0
