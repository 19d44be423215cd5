"""Empty tables, clashing columns, hubs, and folders that are given back."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import EXTRA
from tidemark.llm import bitslice, chat, components, mixing, neardup, shards, toxicity
from tidemark.llm.bpe_count import token_counts
from tidemark.storage import shared_folder

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def nothing(none):
    return none.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def test_empty_tables(spark, none, nothing):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert neardup.near_duplicates(none).count() == 0
    for kept in (neardup.deduplicated(nothing), mixing.mixed_documents(nothing), toxicity.without_toxic(nothing, labels)):
        assert kept.count() == 0 and kept.columns == nothing.columns
    assert toxicity.scored(none, labels).count() == token_counts(none).count() == shards.balanced_shards(none).count() == 0
    assert mixing.mix_documents(none).count() == 0
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted_conversations(talks).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bitslice.top_k(vectors, F.col("id") % 100 == 0).count() == 0


def test_the_pipeline_of_an_empty_table(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_without_labels_nothing_goes(spark, odd):
    empty = spark.createDataFrame([], LABELS)
    assert toxicity.without_toxic(odd, empty).count() == odd.count()


def test_clashing_columns_stay(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], LABELS)
    rows = toxicity.without_toxic(odd, labels).collect()
    assert all(r[k] == v for r in rows for k, v in EXTRA.items())
    assert all(r[k] == v for r in mixing.mixed_documents(odd).collect() for k, v in EXTRA.items())


def test_threads_with_clashing_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", None)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = talks.withColumns({k: F.lit("x") for k in ("msg_id", "parent_id", "score", "up", "rank", "leaf_id", "next", "root", "_c", "_m")})
    want = sorted(map(tuple, chat.formatted_conversations(talks).collect()))
    assert sorted(map(tuple, chat.formatted_conversations(extra).collect())) == want


def test_a_hub_of_many_pairs(spark, monkeypatch):
    """One text with links to all others: its pairs come in many pieces, and an id with two texts is one document."""
    monkeypatch.setattr(neardup, "HUB_PAIRS", 7)
    pick = random.Random(41)
    base = [f"w{i}" for i in range(200)]
    docs = [(0, " ".join(base))]
    for i in range(1, 80):
        own = list(base)
        for _ in range(pick.randrange(1, 12)):
            own[pick.randrange(200)] = f"x{pick.randrange(10_000)}"
        docs.append((i, " ".join(own)))
    pairs = spark.createDataFrame([(0, i) for i in range(1, 80)], "a long, b long")
    frame = spark.createDataFrame(docs + [(200, "other words"), (200, docs[0][1])], "doc_id long, text string").repartition(5)
    got = {(r.a, r.b) for r in neardup.confirmed(pairs.union(spark.createDataFrame([(3, 200)], "a long, b long")), frame, 3, 85).collect()}
    sets = {i: brute.shingles(t, 3) for i, t in docs}
    alike = lambda x, y: 100 * len(x & y) >= 85 * len(x | y)
    want = {(0, i) for i in range(1, 80) if alike(sets[0], sets[i])} | ({(3, 200)} if alike(sets[3], sets[0]) else set())
    assert got == want and 10 < len(want) < 80


def test_lists_of_long_texts(spark):
    """Long texts with all values in common: memory for a row of the lists does not grow with its text."""
    n, texts = 30_000, 40
    sets = spark.range(texts).select("id", F.lit(n).cast("long").alias("n"), F.sequence(F.lit(1), F.lit(n).cast("long")).alias("values"))
    short = spark.range(100, 102).select("id", F.lit(2).cast("long").alias("n"), F.array(F.lit(-1), F.lit(5)).cast("array<long>").alias("values"))
    rows = neardup.lists(sets.union(short), F.ceil(F.col("n") * 85 / 100))
    assert rows.columns == ["id", "n", "common", "v", "df", "listed"]
    got = rows.groupBy("id", "n", "common").agg(F.count("*").alias("rows"), F.count_if("listed").alias("listed"), F.max(F.when(F.col("listed"), F.col("v"))).alias("last"), F.min("df").alias("df"))
    # Value 5 is in 42 texts, all others of the long ones in 40, so it comes last; -1 is in two.
    want = {(i, n, n, n, 4_501, 4_502, 40) for i in range(texts)} | {(i, 2, 1, 2, 1, -1, 2) for i in (100, 101)}
    assert {tuple(r) for r in got.collect()} == want


def test_intermediate_tables_are_given_back(spark, small):
    def folders():
        return {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if not f.endswith(".crc")}

    before = folders()
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    found, _ = components.components(edges)
    assert {r.component for r in found.collect()} == {0} and len(folders() - before) == 1
    before = folders()
    neardup.near_duplicates(small, 3, 85).count()
    assert {f.split("-")[0] for f in folders() - before} == {"sketches", "classes", "labels"} and len(folders() - before) == 3
