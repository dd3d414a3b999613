"""Skew-safe joins, splits, medians, average precision, priors, predictions, inputs."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgersight import fixed_values as fv
from ledgersight.functions import casts
from ledgersight.functions.labels import three_way
from ledgersight.functions.rowwise import row_mean, row_std
from ledgersight.operators import (compare, evaluate, impute, normalise, periods, predictions, priors,
                                   profile, sampling, splits)
from ledgersight.operators.skew import SkewPolicy, hot_keys, lookup_join, split_hot
from ledgersight.sources import readers, sinks
from tests import brute

SALTED = SkewPolicy(hot_rows=5, broadcast_rows=1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- skew ---------------------------------------------------------------------------

@pytest.fixture
def skewed(spark):
    data = [(i, 1 if i % 3 == 0 else (None if i % 7 == 0 else i % 5)) for i in range(60)]
    return spark.createDataFrame(data, "id int, key int")


def test_hot_keys_are_the_large_ones(skewed):
    hot = hot_keys(skewed, "key", SkewPolicy(hot_rows=10))
    n = skewed.where("key = 1").count()
    assert [tuple(r) for r in hot.collect()] == [(1, -(-n // 10))]
    assert hot_keys(skewed, "key", SkewPolicy(hot_rows=60)) is None
    ordinary, heavy = split_hot(skewed, hot, "key")
    assert ordinary.count() + heavy.count() == 60 and heavy.where("key <> 1").count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, skewed, how):
    lookup = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (9, "z")], "key int, v string")
    plain = lookup_join(skewed, lookup, "key", how)
    salted = lookup_join(skewed, lookup, "key", how, SALTED)
    unsalted = lookup_join(skewed, lookup, "key", how, SkewPolicy(hot_rows=100, broadcast_rows=1))
    assert plain.columns == salted.columns
    assert rows_of(plain) == rows_of(salted) == rows_of(unsalted)


def test_salted_join_spreads_full_copies(spark):
    copies = spark.createDataFrame([(7, "same")] * 40, "key int, v string").repartition(4)
    lookup = spark.createDataFrame([(7, 1), (8, 2)], "key int, w int")
    out = lookup_join(copies, lookup, "key", "left", SALTED)
    assert out.count() == 40 and out.where("w = 1").count() == 40


# --- splits -------------------------------------------------------------------------

@pytest.mark.parametrize("exact_rows", [1, 3, 1000])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.8, 1.0])
def test_position_threshold_is_the_exact_row(spark, share, exact_rows):
    r = random.Random(share)
    data = sorted((r.choice([5, 5, 1000, r.randrange(10**15)]), i) for i in range(101))
    df = spark.createDataFrame(data, "event_us bigint, event_id bigint").repartition(3)
    found = splits.position_threshold(df, share, slots=4, exact_rows=exact_rows)
    assert tuple(found) == data[max(1, int(101 * share)) - 1]


def test_fallback_split(spark):
    df = spark.createDataFrame([(10 + i // 2, i) for i in range(10)], "event_us bigint, event_id bigint")
    marked = splits.mark_holdout(df, days=1)
    assert rows_of(marked.where("is_val").select("event_id")) == [(8,), (9,)]
    one = splits.mark_holdout(df.limit(1), days=1)
    assert one.where("NOT is_val").count() == 1
    assert splits.position_threshold(df.limit(0)) is None


def test_dynamic_weight(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "target int")
    assert splits.positive_weight(df).first()[0] == 1.5
    assert splits.positive_weight(df.where("target = 0"), fallback=10.0).first()[0] == 10.0


# --- imputation ---------------------------------------------------------------------

@pytest.mark.parametrize("zeros, ones, twos, want", [(50, 50, 0, 0.5), (50, 49, 0, 0.0), (40, 30, 31, 1.0), (10, 41, 51, 1.5)])
def test_medians_of_ties_stay_out_of_the_driver(spark, monkeypatch, zeros, ones, twos, want):
    data = [0.0] * zeros + [1.0] * ones + [2.0] * twos
    df = spark.createDataFrame([(x,) for x in data], "a double")
    monkeypatch.setattr(type(df), "offset", None)      # sorting and skipping through ties is not allowed
    assert impute.exact_medians(df, ["a"], exact_rows=3, accuracy=50) == {"a": statistics.median(data)}
    assert want == statistics.median(data)


@pytest.mark.parametrize("n", [1, 2, 7, 400, 401])
def test_medians_are_exact(spark, n):
    r = random.Random(n)
    data = [(r.gauss(0, 1), float(r.choice([1, 1, 1, 2])), None if i % 3 else r.random(), None)
            for i in range(n)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(3)
    found = impute.exact_medians(df, ["a", "b", "c", "d"], exact_rows=3, accuracy=50)
    for i, c in enumerate("abc"):
        assert found[c] == pytest.approx(statistics.median(x[i] for x in data if x[i] is not None))
    assert found["d"] is None


# --- evaluation ---------------------------------------------------------------------

@pytest.mark.parametrize("range_rows", [3, 20, 10**6])
def test_average_precision_matches_definition(spark, range_rows):
    r = random.Random(0)
    data = [(g, r.choice([0.1, 0.1, 0.5, r.random()]), int(r.random() < 0.3)) for g in "xy" for _ in range(80)]
    data += [("z", 0.5, 0), ("z", 0.7, 0)]
    df = spark.createDataFrame(data, "g string, score double, label int")
    got = {x["g"]: x["ap"] for x in evaluate.average_precision(df, by=["g"], range_rows=range_rows).collect()}
    for g in "xyz":
        assert got[g] == pytest.approx(brute.average_precision([(s, y) for h, s, y in data if h == g]))


def test_score_ranges_of_narrow_groups_hold_few_rows(spark):
    """One group's scores lie within a millionth of another's spread, one group is null."""
    r = random.Random(3)
    data = {("wide", r.random()) for _ in range(300)} | {("narrow", 0.5 + r.random() / 10**6) for _ in range(300)}
    data |= {(None, r.random()) for _ in range(50)}
    labelled = [(g, s, int(r.random() < 0.3)) for g, s in sorted(data, key=str)]
    df = spark.createDataFrame(labelled, "g string, score double, label int")
    cut = evaluate.score_ranges(df, ["g"], 20).collect()
    held = Counter(x["_range"] for x in cut)
    assert len(cut) == len(data) and max(held.values()) <= 80 and len(held) > 15
    for g in ("wide", "narrow", None):
        order = [x["_range"] for x in sorted((x for x in cut if x["g"] == g), key=lambda x: -x["score"])]
        assert order == sorted(order)
    got = {x["g"]: (x["ap"], x["n_rows"]) for x in evaluate.average_precision(df, by=["g"], range_rows=20).collect()}
    for g in ("wide", "narrow", None):
        pairs = [(s, y) for h, s, y in labelled if h == g]
        assert got[g] == (pytest.approx(brute.average_precision(pairs)), len(pairs))


def test_holdout_report_names_every_score(spark):
    r = random.Random(4)
    data = [(r.random(), r.random(), r.random(), int(r.random() < 0.3), r.random() < 0.5) for _ in range(70)]
    df = spark.createDataFrame(data, "main double, recent double, product double, label int, seen boolean")
    mean = statistics.fmean(b for _, b, _, _, seen in data if seen)
    weights = {"main": 0.5, "recent": 0.2, "product": 0.3}
    want = {"main": lambda a, b, c, s: a, "recent": lambda a, b, c, s: b, "product": lambda a, b, c, s: c,
            "fixed": lambda a, b, c, s: 0.7 * a + 0.3 * b, "best": lambda a, b, c, s: 0.5 * a + 0.2 * b + 0.3 * c,
            "recent_aligned": lambda a, b, c, s: b if s else mean}
    for range_rows in (10, 10**6):
        found = evaluate.holdout_report(df, weights, "seen", range_rows=range_rows).collect()
        assert {x["score"]: x["ap"] for x in found} == {
            name: pytest.approx(brute.average_precision([(f(a, b, c, s), y) for a, b, c, y, s in data])) for name, f in want.items()}
    assert {x["score"] for x in evaluate.holdout_report(df, weights).collect()} == set(want) - {"recent_aligned"}


def test_blend_grid_and_best(spark):
    r = random.Random(1)
    data = [(r.random(), r.random(), r.random(), int(r.random() < 0.4)) for _ in range(50)]
    df = spark.createDataFrame(data, "main double, recent double, product double, label int")
    searched = evaluate.blend_search(df)
    assert searched.count() == 96
    want = {}
    for m in range(6, 19):
        for k in range(9):
            if m + k <= 20:
                w = (m / 20, k / 20, (20 - m - k) / 20)
                want[w] = brute.average_precision([(w[0] * a + w[1] * b + w[2] * c, y) for a, b, c, y in data])
    best = evaluate.best_blend(searched).first()
    assert best["ap"] == pytest.approx(max(want.values()))
    first = min(w for w, ap in want.items() if ap > max(want.values()) - 1e-12)
    assert (best["w_main"], best["w_recent"], best["w_product"]) == pytest.approx(first)


# --- priors -------------------------------------------------------------------------

def test_priors_smooth_and_leave_unseen_null(spark):
    events = spark.createDataFrame(
        [(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "b", 2)], "event_id int, k string, j int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "event_id int, target int")
    tables = priors.fit(events, labels, ["k", "j"])
    a = tables["k"].where("k = 'a'").first()
    assert a["prior_k_cnt"] == 3
    assert a["prior_k_red_rate_all"] == pytest.approx(2 / 203)
    assert a["prior_k_labeled_rate_all"] == pytest.approx(3 / 203)
    assert a["prior_k_red_share_labeled"] == pytest.approx(2 / 4)
    assert rows_of(tables["j"].select("j", "prior_j_cnt")) == [(1, 2), (2, 2)]
    unseen = spark.createDataFrame([(9, "q", 1)], "event_id int, k string, j int")
    out = priors.apply(unseen, tables)
    assert out.first()["prior_k_cnt"] is None and out.first()["prior_j_cnt"] == 2
    filled = impute.fill_means(priors.apply(events.unionByName(unseen), tables), ["prior_k_cnt"])
    assert filled.where("k = 'q'").first()["prior_k_cnt"] == pytest.approx((3 + 3 + 3 + 1) / 4)


# --- samples and labels ---------------------------------------------------------------

def test_sampling_keeps_all_labelled(tables):
    df = tables.period_log()
    marked = sampling.mark_samples(df, "2024-01-15")
    kept = marked.where("is_train_sample")
    labelled = df.where("period = 'train' AND target IS NOT NULL").count()
    assert kept.where("train_target_raw <> -1").count() == labelled
    assert marked.where("is_train_sample AND period <> 'train'").count() == 0
    assert marked.count() == df.count()


def test_samples_nest(spark):
    df = spark.range(2000).toDF("event_id").withColumn("target", F.lit(0))
    five = {r[0] for r in sampling.keep_positives(df, 5).collect()}
    ten = {r[0] for r in sampling.keep_positives(df, 10).collect()}
    rotated = {r[0] for r in sampling.keep_positives(df, 5, offset=50).collect()}
    assert five < ten and 40 < len(five) < 180 and not five & rotated


def test_three_way_label(spark):
    df = spark.createDataFrame(
        [("train", 1), ("train", 0), ("train", None), ("test", None), ("test", 1)], "period string, target int")
    assert [r[0] for r in df.select(three_way()).collect()] == [1, 0, -1, None, None]


# --- scalars ------------------------------------------------------------------------

def test_lenient_casts(spark):
    df = spark.createDataFrame([("a1",), ("1.7",), ("300",), ("7",), (None,)], "x string")
    assert [r[0] for r in df.select(casts.lenient_int("x", "tinyint")).collect()] == [-1, -1, -1, 7, -1]


def test_device_digits(spark):
    df = spark.createDataFrame(
        [("87%", "14.2", "1080x2400"), ("abc", "v14", "x"), ("1000%", None, "1080x"), (None, "", "99999x5")],
        "battery string, device_system_version string, screen_size string")
    got = df.select(*[casts.digits(s, p).alias(n) for n, (s, p) in fv.DIGIT_PATTERNS.items()]).collect()
    assert [tuple(r) for r in got] == [(87, 14, 1080, 2400), (-1, -1, -1, -1), (100, -1, 1080, -1), (-1, -1, -1, 5)]


def test_strict_timestamp_fails_on_bad_text(spark):
    df = spark.createDataFrame([("2024-13-01 00:00:00",)], "event_dttm string")
    assert df.select(casts.lenient_timestamp("event_dttm")).first()[0] is None
    with pytest.raises(PySparkException):
        df.select(casts.strict_timestamp("event_dttm")).collect()


def test_row_statistics(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (2.0, None, None), (None, None, None)], "a double, b double, c double")
    got = df.select(row_mean(["a", "b", "c"]), row_std(["a", "b", "c"])).collect()
    assert tuple(got[0]) == pytest.approx((2.0, 2**0.5))
    assert tuple(got[1]) == (2.0, None) and tuple(got[2]) == (None, None)


# --- predictions --------------------------------------------------------------------

def test_missing_prediction_is_an_error(spark):
    template = spark.createDataFrame([(1,), (2,)], "event_id bigint")
    scores = spark.createDataFrame([(1, 0.5), (2, None)], "event_id bigint, predict double")
    with pytest.raises(ValueError, match="1 template"):
        predictions.require_complete(template, scores)
    assert predictions.fill_template(template, scores).count() == 2


def test_keep_first_follows_the_order(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 1, "c")], "event_id int, rank int, v string")
    assert rows_of(predictions.keep_first(df, order=["rank"])) == [(1, 3, "a"), (2, 1, "c")]
    assert predictions.keep_first(df, order=["rank"]).columns == df.columns


def test_single_model_has_no_deviation(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7)], "event_id int, predict double")
    table = compare.disagreement(predictions.merge_predictions({"only": df}))
    assert {r["std_pred"] for r in table.collect()} == {None}


def test_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, None, 5.0), (4.0, 8.0, 2.0)],
                               "a double, b double, c double")
    want = df.toPandas().corr()
    for r in compare.correlation_matrix(df, ["a", "b", "c"]).collect():
        assert r["corr"] == pytest.approx(want.loc[r["col_a"], r["col_b"]])


# --- profiles -----------------------------------------------------------------------

def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(x), 5.0) for x in range(11)], "v double, c double")
    got = {(r["column"], r["bin"]): r["n"] for r in profile.histogram(df, ["v", "c"], bins=5).collect()}
    assert [got["v", b] for b in range(5)] == [2, 2, 2, 2, 3]
    assert [got["c", b] for b in range(5)] == [11, 0, 0, 0, 0]


def test_density_skips_features_with_an_empty_class(spark):
    df = spark.createDataFrame([(1, 1.0, None), (0, 2.0, 3.0), (0, 9.0, -1.0)], "target int, x double, y double")
    out = profile.class_density(df, {"x": True, "y": False}, bins=4)
    assert {r["feature"] for r in out.collect()} == {"x"}
    assert all(r["log_axis"] for r in out.collect())
    assert profile.log_axis_by_name(["amt_1h", "hour"]) == {"amt_1h": True, "hour": False}


# --- inputs -------------------------------------------------------------------------

def test_missing_inputs(spark, tables, tmp_path):
    assert readers.read_events(spark, []) is None
    with pytest.raises(FileNotFoundError):
        readers.existing(spark, [str(tmp_path / "none")])
    with pytest.raises(FileNotFoundError):
        readers.existing(spark, [str(tmp_path / "none"), tables.path("events")])
    with pytest.raises(ValueError):
        readers.require_rows(tables.log().limit(0), "log")


def test_period_files_are_found_by_name(spark, tmp_path):
    for name in ("pretrain_part_1", "train_part_1", "train_part_2", "pretest", "test", "train_labels"):
        df = spark.createDataFrame([(name,)], "name string")
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    found = readers.read_period_files(spark, str(tmp_path))
    got = {p: {r[0] for r in df.collect()} for p, df in found.items()}
    assert got == {"pretrain": {"pretrain_part_1"}, "train": {"train_part_1", "train_part_2"},
                   "pretest": {"pretest"}, "test": {"test"}}


def test_reuse_or_write_rebuilds_only_when_forced(spark, tmp_path):
    path = str(tmp_path / "t")

    def build(n):
        return lambda: spark.range(n).toDF("id")

    assert sinks.reuse_or_write(spark, path, build(3)).count() == 3
    assert sinks.reuse_or_write(spark, path, build(5)).count() == 3
    assert sinks.reuse_or_write(spark, path, build(5), force=True).count() == 5


def test_absent_columns(spark):
    df = spark.createDataFrame([("5",)], "event_id string")
    out = normalise.ensure_column(df, "session_id", -1, "bigint")
    assert out.first()["session_id"] == -1
    assert normalise.normalise_categories(out, ["pos_cd"]).first()["pos_cd"] == "MISSING"
    assert periods.union_diagonal(df, out).count() == 2


def test_feature_list_guards_against_leakage():
    features, categorical, numeric = normalise.feature_columns(
        ["event_id", "target", "keep_green", "event_date", "amt", "pos_cd", "target_bin"])
    assert features == ["amt", "pos_cd"] and categorical == ["pos_cd"] and numeric == ["amt"]
