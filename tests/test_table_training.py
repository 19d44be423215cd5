"""A model that stays a table is trained to the same numbers as one in arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import test_model
from tests.test_model import as_array, random_weights
from tidemark.functions import softmax
from tidemark.operators import weights as model
from tidemark.operators.prep import sparse_encode
from tidemark.plans import table_training, training


def examples_frame(spark, n):
    """Three groups of unlike size."""
    x, labels, df = test_model.examples_frame(spark, n=n)
    return x, labels, df.withColumn("shard", F.when(F.col("row_id") % 2 == 0, F.lit(0)).otherwise(F.col("row_id") % 3).cast("long"))


def fitted(df):
    return {(r["shard"], r["class"], r["feature"]): (r["delta"], r["loss"], r["rows"]) for r in df.collect()}


def assert_same(got, want):
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert np.allclose(got[key], values, rtol=1e-7, atol=1e-9), (key, got[key], values)


@pytest.mark.parametrize("iterations", [1, 2, 4])
def test_a_fit_of_tables_equals_a_fit_of_arrays(spark, iterations):
    _, _, df = examples_frame(spark, n=90)
    df = df.withColumn("features", F.concat("features", F.array(F.lit(2.5))))  # a constant feature
    start = random_weights(width=7)
    want = fitted(training.local_fit(df, start, iterations, bounded=True))
    assert_same(fitted(training.local_fit(df, model.weights_frame(spark, start), iterations)), want)


def test_own_weights_of_every_group(spark):
    _, _, df = examples_frame(spark, n=60)
    own = {g: random_weights(seed=g) for g in range(3)}
    want = fitted(training.local_fit(df, own, 2, bounded=True))
    tables = [model.weights_frame(spark, w).withColumn("shard", F.lit(g).cast("long")) for g, w in own.items()]
    assert_same(fitted(training.local_fit(df, tables[0].unionByName(tables[1]).unionByName(tables[2]), 2)), want)


def test_training_beyond_the_limit(spark, monkeypatch):
    """With a limit of ten weights nothing is held by the driver, and the numbers are the same."""
    _, _, df = examples_frame(spark, n=60)
    start = np.zeros((4, 7))
    fits = training.train_rounds(df, start, 2, 3)
    steps = training.train_rounds(df, start, 2, 3, rate=0.5)
    deltas = fitted(training.local_fit(df, start, 2))
    monkeypatch.setattr(model, "MAX_BROADCAST_WEIGHTS", 10)
    for want, got in ((fits, training.train_rounds(df, start, 2, 3)), (steps, training.train_rounds(df, start, 2, 3, rate=0.5))):
        assert all(np.allclose(as_array(g, "value", start.shape), w, atol=1e-8) for g, w in zip(got, want))
    assert_same(fitted(training.local_fit(df, start, 2)), deltas)
    with pytest.raises(ValueError):
        model.weight_arrays(model.weights_frame(spark, start))


def test_sparse_rows_and_small_groups(spark):
    """Feature maps, a feature that a group never has, and a group of one row."""
    _, _, df = examples_frame(spark, n=40)
    df = df.withColumn("shard", F.when(F.col("row_id") == 5, F.lit(2)).otherwise(F.col("shard") % 2).cast("long"))
    holes = df.withColumn("features", F.transform("features", lambda v, i: F.when((F.abs(v) < 1) | ((i == 2) & (F.col("shard") == 1)), F.lit(0.0)).otherwise(v)))
    maps = sparse_encode(holes, "features")
    start = random_weights()
    want = fitted(training.local_fit(maps, start, 3, bounded=True))
    assert_same(fitted(training.local_fit(maps, model.weights_frame(spark, start), 3)), want)


def test_no_rows(spark):
    _, _, df = examples_frame(spark, n=10)
    assert training.local_fit(df.limit(0), model.weights_frame(spark, np.zeros((4, 7))), 2).count() == 0


def test_the_recursion_on_products_is_the_recursion_on_vectors():
    rng = np.random.default_rng(4)
    for m in range(5):
        steps = [(rng.normal(size=20), rng.normal(size=20)) for _ in range(m)]
        steps = [(s, y if s @ y > 0 else -y) for s, y in steps]
        gradient = rng.normal(size=20)
        vectors = np.array([s for s, _ in steps] + [y for _, y in steps] + [gradient])
        mix = table_training.inverse_hessian_mix(vectors @ vectors.T, [True] * m)
        assert np.allclose(mix @ vectors, softmax._inverse_hessian_times(gradient, steps))


def test_many_versions_over_a_limit_of_three(spark, monkeypatch):
    """Fifty versions, three to a broadcast; then a limit that not even one fits."""
    _, _, df = examples_frame(spark, n=40)
    versions = {v: random_weights(seed=v) for v in range(50)}
    want = {tuple(r) for r in training.learning_curve(df, versions).collect()}
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    monkeypatch.setattr(model, "MAX_BROADCAST_WEIGHTS", 3 * 28)
    assert {tuple(r) for r in training.learning_curve(df, versions).collect()} == want
    assert len(sent) == 17 and all(sum(w.size for w in some.values()) <= 3 * 28 for some in sent)
    sent.clear()
    monkeypatch.setattr(model, "MAX_BROADCAST_WEIGHTS", 10)
    few = {v: versions[v] for v in (0, 7, 49)}
    assert {tuple(r) for r in training.learning_curve(df, few).collect()} == {r for r in want if r[0] in few}
    tables = {v: model.weights_frame(spark, w) for v, w in few.items()}
    assert {tuple(r) for r in training.learning_curve(df, tables).collect()} == {r for r in want if r[0] in few}
    assert not any(isinstance(value, dict) for value in sent)


def test_large_groups_beyond_the_limit(spark, monkeypatch):
    """Sums of all groups together over the limit: the fit stays in tables, with the same numbers."""
    _, _, df = examples_frame(spark, n=60)
    start = np.zeros((4, 7))
    want = fitted(training.local_fit(df, start, 2, bounded=False))
    monkeypatch.setattr(model, "MAX_BROADCAST_WEIGHTS", 3 * 28 - 1)
    monkeypatch.setattr(training, "_fit_over_rows", None)
    assert_same(fitted(training.local_fit(df, start, 2, bounded=False)), want)
