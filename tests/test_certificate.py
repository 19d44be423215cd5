"""The lower bound of a model's objective, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import softmax
from tidemark.operators import weights as model
from tidemark.operators.prep import long_vectors
from tidemark.plans import training
from tidemark.plans.certificate import certificate
from tests.test_model import examples_frame, random_weights

PENALTY = 0.3


def objective_and_slope(x, y, w):
    loss, slope = softmax.loss_and_gradient(softmax.with_bias(x), y, w)
    inner = w.copy()
    inner[:, 0] = 0
    return loss / len(y) + PENALTY / 2 * (inner**2).sum(), slope / len(y) + PENALTY * inner


def best_objective(x, y, classes):
    w = np.zeros((classes, x.shape[1] + 1))
    for _ in range(4000):
        value, slope = objective_and_slope(x, y, w)
        w -= slope / (0.5 * (1 + (x**2).sum(axis=1).mean()) + PENALTY)
    return value


def vectors_of(df):
    return long_vectors(df, "row_id", "label", bias=True)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_model_is_below_the_bound(spark, seed):
    x, y, df = examples_frame(spark)
    w = random_weights(seed=seed)
    got = certificate(vectors_of(df), model.weights_frame(spark, w), PENALTY).first()
    value, slope = objective_and_slope(x, y, w)
    assert got["rows"] == len(y)
    assert np.isclose(got["objective"], value) and np.isclose(got["gradient_norm"], np.sqrt((slope**2).sum()))
    assert got["lower_bound"] <= best_objective(x, y, 4) + 1e-9 and np.isclose(got["gap"], value - got["lower_bound"])


def test_the_bound_meets_the_best_model(spark):
    x, y, df = examples_frame(spark)
    fitted = training.reference_model(df, regParam=PENALTY, standardization=False, maxIter=300, tol=1e-9)
    got = certificate(vectors_of(df), training.reference_weights(spark, fitted), PENALTY).first()
    best = best_objective(x, y, 4)
    assert abs(got["gap"]) < 1e-5 and abs(got["objective"] - best) < 1e-5 and abs(got["lower_bound"] - best) < 1e-5


def test_a_class_without_rows_is_left_out_of_the_bound(spark):
    x, y, df = examples_frame(spark)
    kept = y != 1
    w = random_weights()
    got = certificate(vectors_of(df.filter("label <> 1")), model.weights_frame(spark, w), PENALTY).first()
    value, _ = objective_and_slope(x[kept], y[kept], w)
    narrow = best_objective(x[kept], np.searchsorted([0, 2, 3], y[kept]), 3)
    assert np.isclose(got["objective"], value) and np.isfinite(got["lower_bound"]) and got["lower_bound"] <= narrow + 1e-9


def test_without_penalty_or_rows_there_is_no_bound(spark):
    _, _, df = examples_frame(spark)
    w = model.weights_frame(spark, random_weights())
    free = certificate(vectors_of(df), w).first()
    assert free["lower_bound"] is None and free["gap"] is None and np.isclose(free["objective"], free["loss"])
    none = certificate(vectors_of(df.filter(F.lit(False))), w, PENALTY).first()
    assert none["rows"] == 0 and none["objective"] is None and none["lower_bound"] is None
