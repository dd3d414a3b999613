"""Whitening against a library's eigenvectors and exact numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgersight.llm import QUERIES, whitening
from tests.conftest import BASE

SCHEMA = "vec_id bigint, embedding array<double>, component string, n string, place int, v int"


def matrices():
    draw = np.random.default_rng(5)
    for n in (1, 2, 5, 30):
        a = draw.normal(size=(n, n))
        q = np.linalg.qr(a)[0]
        yield a @ a.T
        yield q @ np.diag(np.r_[[5.0] * (n // 2), [1.0] * (n - n // 2)]) @ q.T      # two clusters
        yield np.diag(np.arange(n) // 3).astype(float)                              # falls apart
        yield a[:, :max(1, n // 3)] @ a[:, :max(1, n // 3)].T                       # rank
        yield np.zeros((n, n))
    w = np.diag(np.abs(np.arange(-10, 11)).astype(float)) + np.eye(21, k=1) + np.eye(21, k=-1)
    yield w                                                                         # pairs that agree to 14 digits


@pytest.mark.parametrize("m", list(matrices()), ids=lambda m: f"{len(m)}")
def test_eigenpairs(m):
    m = (m + m.T) / 2
    values, x = whitening.leading(m, 32)
    size = max(1e-300, np.abs(m).max())
    assert np.abs(values - np.linalg.eigvalsh(m)[::-1][:32]).max() <= 1e-12 * size * len(m)
    assert np.abs(m @ x - x * values).max() <= 1e-12 * size * len(m)
    assert np.abs(x.T @ x - np.eye(len(values))).max() <= 1e-11


def brute(rows, k=32):
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, S = len(x), [sum(c) for c in zip(*x)]
    y = [[n * c - s for c, s in zip(r, S)] for r in x]
    centred = np.array([[float(Fraction(c, n)) for c in r] for r in y])
    V = centred.T @ centred / n
    return n, [i for i, _ in rows], [sum(c * c for c in r) for r in y], centred, V


def compare(df, rows, k=32):
    n, ids, deviation, centred, V = brute(rows)
    values, axes = np.linalg.eigh(V)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    got = df.collect()
    k = len(values)
    assert len(got) == n * k and {r.n for r in got} == {n}
    out = {}
    for r in got:
        out.setdefault(r.vec_id, {})[r.component] = r
    w = np.array([[out[i][c + 1].whitened for c in range(k)] for i in ids])
    assert [int(out[i][1].deviation) for i in ids] == deviation
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-8
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-8
    for c in range(k):
        assert all(abs(out[i][c + 1].explained / (values[c] / np.trace(V)) - 1) < 1e-8 for i in ids)
    gaps = np.abs(np.diff(np.r_[np.inf, values, -np.inf])) / values[0]
    for c in range(k):
        if min(gaps[c], gaps[c + 1]) > 1e-5:                # else any basis of the cluster will do
            want = centred @ axes[:, c] / math.sqrt(values[c])
            sign = 1 if want @ w[:, c] > 0 else -1
            assert np.abs(sign * w[:, c] - want).max() < 1e-6


def test_query_equals_the_library(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{BASE}/embeddings.parquet").collect()]
    out = QUERIES["op13_whitening"](spark, BASE)
    assert dict(out.dtypes)["deviation"] == "bigint"
    compare(out, rows)


@pytest.mark.parametrize("scale", [1, 1e-3, 1e12])
def test_scales_and_odd_rows(spark, scale):
    draw = np.random.default_rng(3)
    rows = [(i, (scale * draw.normal(size=5) * [30, 5, 5, 5, 20]).tolist()) for i in range(80)]
    odd = [(100, None), (101, [float("nan")] * 5), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("inf")] + [0.0] * 4)]
    repeated = [rows[0], rows[0]]
    df = spark.createDataFrame([(i + 200 * (k > 1), v, "a", "b", 1, 2) for k, (i, v) in enumerate([*rows, *odd])], SCHEMA).repartition(7)
    compare(whitening.whiten(df), [(i + 200 * (k > 1), v) for k, (i, v) in enumerate([*rows, *odd])])
    more = spark.createDataFrame([(i, v, "a", "b", 1, 2) for i, v in [*rows, *repeated, (None, rows[1][1]), (104, [1.0, 2.0])]], SCHEMA)
    out = whitening.whiten(more)
    assert out.count() == 83 * 5 and out.where("vec_id = 0").count() == 15 and out.where("vec_id is null").count() == 5
    assert out.where("vec_id = 104").count() == 0           # shorter: entries it lacks are null


def test_constant_and_empty(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], "a", "b", 1, 2)] * 4, SCHEMA)
    assert whitening.whiten(same).count() == whitening.whiten(same.limit(0)).count() == whitening.whiten(same.limit(1)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 1.0, -2.0 * i], "a", "b", 1, 2) for i in range(9)], SCHEMA)
    out = whitening.whiten(line)
    assert out.count() == 9 and out.agg(F.max("identity_error")).first()[0] < 1e-9      # one component
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id bigint, embedding array<double>")).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], "vec_id bigint, embedding array<double>"))


def test_states_are_added_in_rounds(spark):
    states = spark.range(0, 200, 1, 50).select(F.array(F.col("id"), F.lit(1).cast("bigint")).alias("state"))
    assert whitening.tree_sum(states, fan=3).tolist() == [199 * 100, 200]
    assert whitening.tree_sum(states.limit(0)) is None
