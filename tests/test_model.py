import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import softmax
from tidemark.operators import quality, scoring, weights as model
from tidemark.operators.prep import long_vectors, sparse_encode, to_sparse_vector
from tidemark.plans import training


def examples_frame(spark, n=120, width=6, classes=4, seed=0, shards=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(classes, width))
    labels = rng.integers(0, classes, n)
    x = centre[labels] + rng.normal(size=(n, width))
    rows = [(i, 0 if i % 3 else i % shards, int(y), [float(v) for v in r]) for i, (y, r) in enumerate(zip(labels, x))]
    return x, labels, spark.createDataFrame(rows, "row_id long, shard long, label int, features array<double>").repartition(4)


def random_weights(classes=4, width=6, seed=1):
    return np.random.default_rng(seed).normal(size=(classes, width + 1))


def as_array(df, value, shape, shard=None):
    out = np.zeros(shape)
    for r in (df if shard is None else df.filter(F.col("shard") == shard)).collect():
        out[r["class"], r["feature"] + 1] = r[value]
    return out


def test_block_and_table_forms_agree_with_numpy(spark):
    x, y, df = examples_frame(spark)
    w = random_weights()
    loss, want = softmax.loss_and_gradient(softmax.with_bias(x), y, w)
    frame = model.weights_frame(spark, w)
    block = scoring.gradient_sums(df.withColumn("shard", F.lit(0)), w)
    assert np.allclose(as_array(block, "gradient", w.shape), want)
    assert np.isclose(block.first()["loss"], loss) and block.first()["rows"] == len(y)
    vectors = long_vectors(df, "row_id", "shard", "label", bias=True)
    assert np.allclose(as_array(scoring.softmax_gradient(vectors, frame), "gradient", w.shape), want)
    assert np.isclose(scoring.log_loss(vectors, frame).first()["loss"], loss / len(y))
    best = (softmax.with_bias(x) @ w.T).argmax(axis=1)
    assert {r["row_id"]: r["prediction"] for r in scoring.predict(df, w).collect()} == dict(enumerate(best.tolist()))


def test_model_too_large_to_broadcast_uses_the_table_form(spark, monkeypatch):
    x, y, df = examples_frame(spark)
    w = random_weights()
    frame = model.weights_frame(spark, w)
    monkeypatch.setattr(model, "MAX_BROADCAST_WEIGHTS", 5)
    with pytest.raises(ValueError):
        model.weight_arrays(frame)
    vectors = long_vectors(df, "row_id", "shard", "label", bias=True)
    _, want = softmax.loss_and_gradient(softmax.with_bias(x), y, w)
    assert np.allclose(as_array(scoring.softmax_gradient(vectors, frame), "gradient", w.shape), want)


def test_partial_sums_are_passed_on_early(spark, monkeypatch):
    _, _, df = examples_frame(spark)
    w = random_weights()
    want = as_array(scoring.gradient_sums(df, w), "gradient", w.shape, 0)
    monkeypatch.setattr(scoring, "FLUSH_VALUES", 1)
    assert np.allclose(as_array(scoring.gradient_sums(df, w), "gradient", w.shape, 0), want)


def test_sparse_rows_give_the_same_block(spark):
    x, y, df = examples_frame(spark)
    holes = df.withColumn("features", F.transform("features", lambda v: F.when(F.abs(v) < 1, F.lit(0.0)).otherwise(v)))
    w = random_weights()
    dense = {r["row_id"]: r["prediction"] for r in scoring.predict(holes, w).collect()}
    maps = sparse_encode(holes, "features")
    assert {r["row_id"]: r["prediction"] for r in scoring.predict(maps, w).collect()} == dense
    vectors = to_sparse_vector(maps, "features", 6).select("vector").collect()
    assert any(type(r["vector"]).__name__ == "SparseVector" for r in vectors)


def test_sparse_vectors_of_great_width(spark):
    """Ten million wide, five entries a row; keys beyond the width, zeros, empty and NULL maps."""
    width = 10_000_000
    key = lambda k: (F.col("id") * 7919 + k * 1_999_993) % width
    entries = F.map_from_arrays(F.array(*[key(k).cast("int") for k in range(5)]), F.array(*[F.lit(k + 0.5) for k in range(5)]))
    wide = spark.range(5_000).select("id", entries.alias("features"))
    rows = to_sparse_vector(wide, "features", width).select("id", "vector").collect()
    assert all(r["vector"].size == width and len(r["vector"].indices) == 5 for r in rows)
    assert {r["id"]: float(r["vector"][(r["id"] * 7919 + 1_999_993) % width]) for r in rows} == {i: 1.5 for i in range(5_000)}
    odd = spark.createDataFrame([(1, {0: 1.0, 9: 2.0, -1: 3.0, 2: 0.0}), (2, {}), (3, None), (4, {0: 1.0, 1: 2.0, 2: 3.0})], "id long, features map<int,double>")
    got = {r["id"]: r["vector"].toArray().tolist() for r in to_sparse_vector(odd, "features", 4).collect()}
    assert got == {1: [1, 0, 0, 0], 2: [0] * 4, 3: [0] * 4, 4: [1, 2, 3, 0]}
    assert to_sparse_vector(odd.limit(0), "features", 4).count() == 0


def test_dense_block_of_slices_and_wrong_width():
    lists = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    assert softmax.dense_block(lists.slice(1), 2).tolist() == [[3, 4], [5, 6]]
    maps = pa.array([[(0, 1.0)], [], [(1, 5.0)]], pa.map_(pa.int32(), pa.float64()))
    assert softmax.dense_block(maps, 2).tolist() == [[1, 0], [0, 0], [0, 5]]
    assert softmax.dense_block(maps.slice(1), 2).tolist() == [[0, 0], [0, 5]]
    with pytest.raises(ValueError):
        softmax.dense_block(pa.array([[1.0], [2.0, 3.0, 4.0]]), 3)


def test_absent_label_and_zero_features(spark):
    rows = [(i, 0, i % 2, [0.0, 0.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, shard long, label int, features array<double>")
    sums = as_array(scoring.gradient_sums(df, np.zeros((4, 3))), "gradient", (4, 3))
    assert np.allclose(sums[:, 0], [-2.5, -2.5, 2.5, 2.5]) and np.allclose(sums[:, 1:], 0)
    delta = as_array(training.local_fit(df, np.zeros((4, 3))), "delta", (4, 3))
    assert np.allclose(delta[:, 1:], 0) and delta[0, 0] > 0 > delta[3, 0]


def test_local_fit_in_tasks_equals_passes_over_rows(spark):
    _, _, df = examples_frame(spark)
    w = {0: random_weights(seed=2), 1: random_weights(seed=3), 2: random_weights(seed=4)}
    a = training.local_fit(df, w, 3, bounded=True).collect()
    b = {(r["shard"], r["class"], r["feature"]): r for r in training.local_fit(df, w, 3, bounded=False).collect()}
    assert len(a) == len(b) > 0
    for r in a:
        other = b[r["shard"], r["class"], r["feature"]]
        assert np.isclose(r["delta"], other["delta"], atol=1e-8) and np.isclose(r["loss"], other["loss"]) and r["rows"] == other["rows"]


def test_local_fit_lowers_the_loss_and_matches_the_library(spark, tiny):
    table = spark.read.parquet(f"{tiny}/embeddings.parquet")
    df = table.select(F.lit(0).alias("shard"), "label", F.col("embedding").alias("features"))
    library = training.reference_model(df, maxIter=2).summary.objectiveHistory
    share = np.array([r["count"] for r in df.groupBy("label").count().orderBy("label").collect()], float)
    start = np.zeros((10, 65))
    start[:, 0] = np.log(share / share.sum())
    loss = training.local_fit(df, start, 2).first()["loss"]
    assert loss < library[0] and abs(loss - library[-1]) < 0.01


def test_one_plain_step_is_the_gradient_step(spark):
    x, y, df = examples_frame(spark)
    w = random_weights()
    step = as_array(scoring.gradient_step(df, w, 0.5), "delta", w.shape, 0)
    pick = np.array([0 if i % 3 else i % 3 for i in range(len(y))]) == 0
    _, g = softmax.loss_and_gradient(softmax.with_bias(x)[pick], y[pick], w)
    assert np.allclose(step, -0.5 * g / pick.sum())


def test_rounds_add_up_and_improve(spark):
    _, _, df = examples_frame(spark)
    history = training.train_rounds(df, np.zeros((4, 7)), 3, 3)
    f1 = {r["version"]: r["f1"] for r in training.learning_curve(df, dict(enumerate(history))).collect()}
    assert f1[3] > f1[0]
    deltas = as_array(training.local_fit(df, history[0]).groupBy("class", "feature").agg(F.sum("delta").alias("delta")), "delta", (4, 7))
    assert np.allclose(history[1], history[0] + deltas / 3)
    one = training.evaluate(df, history[2]).first()
    assert np.isclose(one["f1"], f1[2])


def test_lbfgs_reaches_the_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    goal = np.array([1.0, -2.0, 3.0])
    steps = softmax.lbfgs(np.zeros((1, 3)), 60)
    point = next(steps)
    try:
        while True:
            d = point.ravel() - goal
            point = steps.send((float(d @ a @ d) / 2, (a @ d).reshape(1, 3)))
    except StopIteration as stop:
        best, losses = stop.value
    assert np.allclose(best.ravel(), goal, atol=1e-3) and all(b <= a for a, b in zip(losses, losses[1:]))


def test_quality_by_hand(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(2, 1)] * 2
    df = spark.createDataFrame(pairs, "label int, prediction int")
    report = {r["class"]: r for r in quality.class_report(df).collect()}
    assert report["0"]["precision"] == 1.0 and report["0"]["recall"] == 0.75
    assert report["2"]["f1"] == 0.0 and report["2"]["support"] == 2
    f1 = {0: 2 * 3 / 7, 1: 2 * 2 / 7, 2: 0.0}
    whole = quality.f1_accuracy(df).first()
    assert np.isclose(whole["f1"], (f1[0] * 4 + f1[1] * 2) / 8) and whole["accuracy"] == 5 / 8
    assert np.isclose(report["macro"]["f1"], sum(f1.values()) / 3) and report["micro"]["f1"] == 5 / 8


def test_tie_goes_to_the_lowest_class(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>")
    assert df.select(scoring.best_class("z")).first()[0] == 1


def test_weight_table_forms(spark):
    w = random_weights()
    frame = model.weights_frame(spark, w)
    assert np.allclose(model.weight_arrays(model.from_flat(model.to_flat(frame, 4, 6), 4, 6)), w)
    matrix, intercepts = model.to_ml(frame)
    assert np.allclose(matrix.toArray(), w[:, 1:]) and np.allclose(intercepts.toArray(), w[:, 0])
    assert tuple(model.key_extent(model.to_flat(frame, 4, 6)).first()) == (0, 28)
    assert tuple(model.key_extent(model.to_flat(frame, 4, 6).limit(0)).first()) == (0, 1)
    assert model.init_weights(spark, 6, 1024).count() == 6150
    assert {len(r["values"]) for r in model.collect_weights(frame).collect()} == {7}


def test_hot_key_history_is_cut_into_ranges(spark):
    rows = [(0 if i % 3 else i % 4, -1, i, 0.25) for i in range(300)]
    deltas = spark.createDataFrame(rows, "class int, feature int, arrival long, delta double")
    frame = model.weights_frame(spark, np.zeros((4, 1)))
    plain = model.weight_history(frame, deltas, 4, ["arrival"])
    cut = model.weight_history(frame, deltas, 4, ["arrival"], rows_per_task=30)
    assert sorted(map(tuple, plain.select("arrival", "class", "value").collect())) == sorted(
        map(tuple, cut.select("arrival", "class", "value").collect())
    )


def test_wide_rows_come_in_small_blocks():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["x"])
    sizes = lambda width: {b.num_rows for b in scoring.row_blocks(batch, width)}
    assert max(sizes(64)) == 4096 and max(sizes(1_000_000)) == 4 and sum(b.num_rows for b in scoring.row_blocks(batch, 10**9)) == 10_000
