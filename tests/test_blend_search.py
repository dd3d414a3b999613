"""Blend search and correlations by counts against plain loops."""

import math

import numpy as np
import pytest

from ledgersight.operators import compare, evaluate, packed_curves


@pytest.fixture(scope="module")
def scored(spark):
    draw = np.random.default_rng(8)
    rows = [(round(float(a), 1), round(float(b), 1), float(c), int(y)) for a, b, c, y in zip(
        draw.normal(size=300), draw.normal(size=300), draw.normal(size=300), draw.integers(0, 5, 300) == 0)]
    return rows, spark.createDataFrame(rows, "main double, recent double, product double, label int").repartition(5)


def precision(scores, labels):
    """Step-wise area, ties as one threshold."""
    area = 0.0
    for s in set(scores):
        above = [y for x, y in zip(scores, labels) if x >= s]
        area += sum(y for x, y in zip(scores, labels) if x == s) * sum(above) / len(above)
    return area / sum(labels)


@pytest.mark.parametrize("most, shared", [(1_000, 2_000_000), (1_000, 150), (3, 2_000_000)])
def test_every_triple(scored, monkeypatch, most, shared):
    """All at once, in several passes, and by curves where positives are too many."""
    rows, df = scored
    monkeypatch.setattr(evaluate, "SHARED_SCORES", shared)
    got = {(round(r.w_main * 20), round(r.w_recent * 20)): r.ap for r in evaluate.blend_search(df, most_positives=most).collect()}
    assert len(got) == sum(m + r <= 20 for m in range(6, 19) for r in range(0, 9))
    for m, r in [(6, 0), (10, 5), (18, 2), (12, 8)]:
        scores = [m / 20 * a + r / 20 * b + (20 - m - r) / 20 * c for a, b, c, _ in rows]
        assert got[m, r] == pytest.approx(precision(scores, [y for *_, y in rows]))


def test_no_positives_and_no_rows(scored):
    _, df = scored
    assert {r.ap for r in evaluate.blend_search(df.where("label = 0")).collect()} == {None}
    assert evaluate.blend_search(df.limit(0)).where("ap IS NOT NULL").count() == 0


@pytest.mark.parametrize("block, range_rows", [(40, 15), (10**6, 10**6)])
def test_packed_curves_of_odd_scores(spark, monkeypatch, block, range_rows):
    """Ties, nulls (lowest), NaN (highest), infinities, both zeros, null labels and several blocks and ranges."""
    draw = np.random.default_rng(3)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1e-310, -1e300]
    rows = [(odd[draw.integers(0, 8)] if draw.random() < 0.4 else float(draw.normal()), float(draw.integers(0, 4)),
             None if draw.random() < 0.1 else int(draw.random() < 0.3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, label int").repartition(3)
    monkeypatch.setattr(packed_curves, "BLOCK_ROWS", block)
    got = {r.curve: r for r in packed_curves.wide_precision(df, [[(1.0, "a")], [(0.5, "a"), (0.25, "b")], [(1.0, "b")]], range_rows=range_rows).collect()}
    long = [(i, None if None in used else sum(used), y) for a, b, y in rows
            for i, used in enumerate([(a,), (None if a is None else 0.5 * a, 0.25 * b), (b,)])]
    want = evaluate.average_precision(spark.createDataFrame(long, "curve int, score double, label int"), by=["curve"])
    for r in want.collect():
        assert (got[r.curve].n_pos, got[r.curve].n_rows) == (r.n_pos, r.n_rows)
        assert got[r.curve].ap == pytest.approx(r.ap, abs=1e-12)
    assert packed_curves.wide_precision(df.limit(0), [[(1.0, "a")]]).count() == 0


def test_many_positives_are_not_multiplied(scored):
    """Beyond the positives tasks can share, rows are still not repeated per triple."""
    plan = evaluate.blend_search(scored[1], most_positives=3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_rows_are_not_multiplied(scored):
    plan = evaluate.blend_search(scored[1])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    plan = compare.correlation_matrix(scored[1], ["main", "recent"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_correlations_of_present_pairs(spark):
    draw = np.random.default_rng(1)
    rows = []
    for i in range(200):
        x = float(draw.normal())
        rows.append((1e9 + x, None if i % 3 == 0 else 2 * x + float(draw.normal()), float(i) if i % 7 else None, 0.1, 5.0 if i == 4 else None,
                     0.3 if i % 3 else float(i)))
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, once double, part double").repartition(4)
    names = df.columns
    got = {(r.col_a, r.col_b): r.corr for r in compare.correlation_matrix(df, names).collect()}
    assert len(got) == len(names) ** 2
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            pair = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
            if len(pair) < 2:
                assert got[a, b] is None
            elif np.ptp(pair[:, 0]) == 0 or np.ptp(pair[:, 1]) == 0:
                assert math.isnan(got[a, b])
            else:
                centred = pair - pair.mean(0)
                want = (centred[:, 0] * centred[:, 1]).sum() / np.sqrt((centred ** 2).sum(0).prod())
                assert got[a, b] == pytest.approx(want, abs=1e-6)
    assert compare.correlation_matrix(df.limit(0), names).count() == 0
