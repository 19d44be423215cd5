import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import lookup, same_message
from tidemark.operators import prep, runlog
from tidemark.sources import examples, messages, runlogs, streams


def test_labelled_csv_with_header(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("0,1,2,Score\n0.5,0,2,3\n0,0,0,1\n1,2,3,4,5\n")
    fields = examples.read_lines(spark, str(path))
    good, bad = prep.validate_width(fields, "fields", 4)
    assert bad.count() == 1
    rows = sorted((r["label"], r["features"]) for r in examples.to_numbers(good).collect())
    assert rows == [(1, {}), (3, {0: 0.5, 2: 2.0})]


def test_csv_with_schema_and_inferred(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("0,1,Score\n0.5,0,3\n1,2,1\n")
    rows = examples.read_examples(spark, str(path), 2).collect()
    assert [(list(r["features"]), r["label"]) for r in rows] == [([0.5, 0.0], 3), ([1.0, 2.0], 1)]
    inferred = examples.read_inferred(spark, str(path))
    assert dict(inferred.dtypes) == {"0": "double", "1": "int", "Score": "int"}
    vector = prep.as_examples(prep.assemble(inferred, ["0", "1"]), "features", "Score")
    assert [list(r["features"].toArray()) for r in vector.collect()] == [[0.5, 0.0], [1.0, 2.0]]


def test_csv_without_header_as_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("1983,1,8,0,12,1\n1984,2,9,1,3,0\n")
    stream = examples.to_numbers(examples.read_lines(spark, str(folder), header=False, stream=True))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["label"] for r in got) == [0, 1]
    assert {len(r["features"]) for r in got} == {4, 5}


def test_wrong_field_types_are_malformed(spark):
    bad = '{"_t":"gMsg","vectorClock":"abc","keyRange":{"_t":"keyRange","start":0,"end":1},"values":{"0":1.0},"partitionKey":2}'
    good = bad.replace('"abc"', "7")
    rows = messages.decode(records(spark, bad, good), strict=False).select("malformed", messages.GRADIENT).collect()
    assert [(r[0], r[1] is None) for r in rows] == [(True, True), (False, False)]
    with pytest.raises(Exception):
        messages.decode(records(spark, bad)).collect()


def records(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_messages_round_trip(spark):
    one = spark.range(1)
    values = F.create_map(F.lit(3), F.lit(0.5), F.lit(1), F.lit(-2.0))
    sent = {
        "LabeledData": messages.labeled(values, F.lit(4)),
        "wMsg": messages.weights_message(F.lit(2), F.lit(0), F.lit(5), values),
        "gMsg": messages.gradient_message(F.lit(2), F.lit(0), F.lit(5), values, F.lit(7)),
    }
    texts = {tag: one.select(messages.encode(m)).first()[0] for tag, m in sent.items()}
    assert json.loads(texts["wMsg"]) == {
        "_t": "wMsg", "vectorClock": 2, "keyRange": {"_t": "keyRange", "start": 0, "end": 5}, "values": {"3": 0.5, "1": -2.0},
    }
    assert list(json.loads(texts["gMsg"]))[0] == "_t"
    got = {r["tag"]: r for r in messages.decode(records(spark, *texts.values())).collect()}
    assert got["LabeledData"]["LabeledData"]["inputData"] == {3: 0.5, 1: -2.0}
    assert got["gMsg"]["gMsg"]["partitionKey"] == 7 and got["gMsg"]["wMsg"] is None
    assert got["wMsg"]["wMsg"]["keyRange"]["end"] == 5


def test_null_unknown_field_and_bad_records(spark):
    extra = '{"_t":"wMsg","vectorClock":1,"other":[1],"keyRange":{"start":0,"end":1},"values":{}}'
    ok = messages.decode(records(spark, None, extra)).collect()
    assert [r["tag"] for r in ok] == [None, "wMsg"] and ok[1]["wMsg"]["vectorClock"] == 1
    for bad in ("not json", '{"_t":"nobody"}', '{"label":1}'):
        with pytest.raises(Exception):
            messages.decode(records(spark, bad)).collect()
        loose = messages.decode(records(spark, bad, extra), strict=False).collect()
        assert [r["malformed"] for r in loose] == [True, False]


def test_null_message_stays_null(spark):
    row = spark.createDataFrame([(None,)], "m struct<a:int>").select(messages.encode(F.col("m"))).first()
    assert row[0] is None


def test_message_equality_and_lookup(spark):
    df = spark.createDataFrame(
        [
            ((1, (0, 2), {1: 2.0, 0: 1.0}), (1, (0, 2), {0: 1.0, 1: 2.0})),
            ((1, (0, 2), {1: 2.0}), (2, (0, 2), {1: 2.0})),
            ((1, (0, 2), {1: 2.0}), (1, (0, 3), {1: 2.0})),
            ((1, (0, 2), {1: 2.0}), (1, (0, 2), {1: 2.5})),
        ],
        "a struct<vectorClock:int,keyRange:struct<start:int,end:int>,values:map<int,double>>,"
        "b struct<vectorClock:int,keyRange:struct<start:int,end:int>,values:map<int,double>>",
    )
    assert [r[0] for r in df.select(same_message("a", "b")).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(lookup("a.values", 0)).collect()] == [1.0, None, None, None]


def test_stream_source_and_sink_keep_keys(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([(i % 3, f"m{i}") for i in range(10)], "key long, value string")
    streams.append_messages(rows, streams.INPUT_DATA, folder)
    stream = streams.read_messages(spark, streams.INPUT_DATA, folder=folder, max_per_trigger=1)
    streams.write_messages(stream, streams.WEIGHTS, f"{folder}/cp", folder=folder).awaitTermination()
    got = spark.read.parquet(f"{folder}/{streams.WEIGHTS}")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def log(spark, rows, columns="run string, partition int, vectorClock int, numTuplesSeen long"):
    return spark.createDataFrame(rows, columns)


def hand_made_logs(spark):
    worker = [(run, p, c, 10 * (c + 1) + p) for run in ("a", "b") for p in range(4) for c in range(5)]
    worker = [r for r in worker if r[:3] != ("b", 2, 4)]
    server = [(run, -1, c) for run in ("a", "b") for c in range(5) if (run, c) != ("a", 3)]
    return log(spark, worker), spark.createDataFrame(server, "run string, partition int, vectorClock int")


def test_run_log_analysis(spark):
    worker, server = hand_made_logs(spark)
    assert {tuple(r) for r in runlog.common_clock(worker).collect()} == {("a", 4), ("b", 3)}
    assert runlog.to_common_clock(worker).count() == 20 + 16
    seen = {(r["run"], r["vectorClock"]): r["total_seen"] for r in runlog.rows_seen(worker).collect()}
    assert seen["a", 0] == 46 and seen["b", 4] == 50 * 3 + 4
    attached = runlog.attach_rows_seen(server, worker)
    assert attached.count() == 9 and attached.filter("total_seen is null").count() == 0
    assert runlog.comparable_extent(attached).first()[0] == 166
    both = runlog.union_logs(server, worker)
    assert both.filter("partition = -1 and numTuplesSeen is not null").count() == 0 and both.count() == 48
    wide = runlog.series(runlog.relabel(both, -1, 4), ["numTuplesSeen"], range(5))
    row = wide.filter("run = 'b' and vectorClock = 4").first()
    assert row["numTuplesSeen2"] is None and row["numTuplesSeen0"] == 50
    last = runlog.latest(worker, ["run", "partition"], ["vectorClock"])
    assert last.count() == 8 and last.filter("run = 'b' and partition = 2").first()["vectorClock"] == 3


def test_metric_logs_as_csv(spark, tmp_path):
    rows = [(1584296644716, 0, 0, 1.4947, 0.185, 0.2977, 420), (1584296644724, 1, 0, 1.5465, 0.1967, 0.2708, 420)]
    frame = spark.createDataFrame(rows, runlogs.WORKER_LOG)
    path = str(tmp_path / "log")
    runlogs.write_worker_log(frame, path)
    runlogs.write_worker_log(frame.withColumn("vectorClock", F.lit(1)), path)
    back = runlogs.read_worker_log(spark, path)
    assert back.count() == 4 and sorted(map(tuple, back.filter("vectorClock = 0").collect())) == rows
    text = "".join(p.read_text() for p in (tmp_path / "log").glob("*.csv"))
    assert "timestamp;partition;vectorClock;loss;fMeasure;accuracy;numTuplesSeen" in text
    server = frame.select(*runlogs.SERVER_LOG.names)
    runlogs.write_server_log(server, str(tmp_path / "server"))
    assert runlogs.read_server_log(spark, str(tmp_path / "server")).count() == 2


def test_cap_keeps_exactly_k_of_a_hot_label(spark):
    df = spark.range(5000).select("id", (F.col("id") % 50 == 0).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in prep.label_histogram(prep.cap_per_label(df, "label", "id", 1200)).collect()}
    assert counts == {0: 1200, 1: 100}


def test_split_is_a_partition(spark):
    train, test = prep.split(spark.range(2000), "id", 0.3)
    assert train.count() + test.count() == 2000 and train.join(test, "id").count() == 0
    assert 500 < test.count() < 700


def test_hash_text_counts_whole_texts(spark):
    long_text = " ".join(["alpha"] * 3000 + ["beta"] * 2 + ["omega"])
    df = spark.createDataFrame([(1, long_text), (2, ""), (3, " \n\t ")], "id long, text string")
    rows = prep.hash_text(df, "text", "id").collect()
    assert {r["id"] for r in rows} == {1} and sum(r["x"] for r in rows) == 3003


def test_empty_tables_stay_empty(spark):
    df = spark.range(0).select("id", F.lit(1).alias("label"))
    assert prep.cap_per_label(df, "label", "id", 3).count() == 0
    worker, _ = hand_made_logs(spark)
    assert runlog.to_common_clock(worker.limit(0)).count() == 0


def test_a_small_side_is_broadcast_by_its_bytes(spark):
    from tidemark.storage import small_side

    plan = lambda: spark.range(50).join(small_side(spark.range(1000).withColumnRenamed("id", "k")), F.col("id") == F.col("k"))
    assert plan().count() == 50
    assert "BroadcastHashJoin" in plan()._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "BroadcastHashJoin" not in plan()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blank_texts_and_null_labels_stay(spark):
    from tidemark.operators import prep

    docs = spark.createDataFrame([(1, "b a a"), (2, " "), (3, None)], "id long, text string")
    got = {r.id: dict(r.features) for r in prep.hashed_maps(docs, "text", "id").collect()}
    assert got[2] == got[3] == {} and sorted(got[1].values()) == [1.0, 2.0]
    assert "Exchange" not in prep.hash_text(docs, "text", "id")._jdf.queryExecution().executedPlan().toString()
    labels = spark.createDataFrame([(i, None if i < 5 else i % 2) for i in range(40)], "id long, label int")
    kept = prep.cap_per_label(labels, "label", "id", 7).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in kept} == {None: 5, 0: 7, 1: 7}
    fit, rest = prep.validate_labels(spark.createDataFrame([(-1,), (0,), (2,), (3,), (None,)], "label int"), "label", 3)
    assert [r[0] for r in fit.collect()] == [0, 2] and rest.count() == 3


def test_only_gaps_are_filled(spark):
    from tidemark.operators.weights import missing_ids

    ids = spark.createDataFrame([(i,) for i in (3, 4, 4, 8, 10**12, -5, None)], "id long")
    assert [r[0] for r in missing_ids(ids, "id", 2, 9).orderBy("id").collect()] == [2, 5, 6, 7, 9]
    assert missing_ids(ids.limit(0), "id", 1, 3).count() == 3
