"""Vectors of extreme length and labels of one class."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgersight.llm import toxicity, vector_dedup
from tests.llm.test_operators import brute_links

SCHEMA = "vec_id bigint, embedding array<double>, label int, n bigint, cell string, first int"


def near(spark, rows):
    df = spark.createDataFrame([(i, v, a, 1, "x", 2) for i, v, a in rows], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect()}


def test_lengths_beyond_the_square_root_of_doubles(spark):
    rows = [(1, [1e-200, 0.0], 0), (2, [1e-200, 1e-210], 0), (3, [1.0, 0.0], 0), (4, [1e200, 1e190], 0), (5, [0.0, 1e308], 0), (6, [5e-324, 0.0], 0),
            (7, [0.0, -1.0], 0)]
    got = near(spark, rows)
    assert {i: n for i, (n, _, _) in got.items()} == {1: 4, 2: 4, 3: 4, 4: 4, 5: 0, 6: 4, 7: 0}
    assert {i for i, (_, c, _) in got.items() if c == 1} == {1, 2, 3, 4, 6} and got[5][1:] == (5, True)


def test_one_large_label_among_many_small(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).tolist(), 0) for i in range(300)]
    rows += [(300 + i, (np.array(rows[i % 7][1]) + draw.normal(size=8) * 0.03 * (i % 5)).tolist(), 0) for i in range(200)]
    rows += [(1_000 + i, draw.normal(size=8).tolist(), 1 + i // 2) for i in range(200)]
    want = brute_links([(i, v, a) for i, v, a in rows], 0.98)
    assert {i: n for i, (n, _, _) in near(spark, rows).items()} == {i: len(want.get(i, ())) for i, _, _ in rows}


def test_empty_and_repeated_rows(spark):
    assert near(spark, []) == {}
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, 1, "x", 2)] * 3 + [(2, [1.0, 2.0], 0, 1, "x", 2), (None, [2.0, 4.0], 0, 1, "x", 2)], SCHEMA)
    rows = vector_dedup.near_vectors(df).collect()
    assert len(rows) == 5 and {r.n_links for r in rows} == {4} and {r.component_id for r in rows} == {1}


@pytest.mark.parametrize("toxic, ordinary", [(49, 1), (50, 0), (0, 50), (0, 0), (7, 40)])
def test_too_few_labels_of_a_class_drop_nothing(spark, toxic, ordinary):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words here "), F.col("id")).alias("text"))
    ids = [i for i in range(2_000) if True][:toxic + ordinary]
    labels = spark.createDataFrame([(i, int(k < toxic)) for k, i in enumerate(ids)], "doc_id bigint, toxic int")
    fitted = toxicity.fit(docs, labels)
    assert toxicity.drop_toxic(docs, fitted).count() == 60
    assert toxicity.score(docs, fitted).where("score BETWEEN 0 AND 1").count() == 60


def test_both_sides_of_the_sample_hold_both_classes(spark):
    bad, good = "you are a vile horrible wretch", "a calm walk along the quiet river"
    docs = spark.createDataFrame([(i, f"{bad if i < 40 else good} number{i}") for i in range(80)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id bigint, toxic int")
    model, curve = toxicity.fit(docs, labels, max_per_class=8)
    assert model is not None
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, (model, curve)).collect()}
    assert kept == set(range(40, 80))
