"""Token counts, token files, fingerprints, near-duplicates, toxicity, search and the pipeline against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import bitslice, cws, dac
from tidemark.llm.bpe_count import MergeCounter, token_counts
from tidemark.llm.neardup import LONG, agreeing, deduplicated, near_duplicates
from tidemark.llm.subwords import SubwordSoftmax
from tidemark.llm.tokenizing import load, public_path
from tidemark.llm.toxicity import scored, without_toxic

PARTS = ["a", "Ab", "'s", "İ", "Σ", "é", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "<|endoftext|>", ".", "?", "123", "½", "日", "👨‍", "\x00", "﻿", "\r\n", "\x0b", "word", " the"]


def scrambled(n, seed):
    pick = random.Random(seed)
    return ["".join(pick.choices(PARTS, k=pick.randint(0, 14))) for _ in range(n)]


def ids_of(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))


def test_counts_are_the_library_s():
    path = public_path("word_bpe_49k.json")
    counter, library = MergeCounter(path), load(path)
    for text in scrambled(3_000, 1):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("name", ["odd", "small", "none"])
def test_token_counts(name, request):
    docs = request.getfixturevalue(name)
    library = load(public_path("word_bpe_49k.json"))
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in ids_of(docs)]
    assert sorted(map(tuple, token_counts(docs).collect()), key=repr) == sorted(want, key=repr)


def test_pieces_are_encoded_as_in_their_text():
    encoder = dac.PieceEncoder(public_path("byte_bpe_50k.json"))
    for text in scrambled(3_000, 2):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("n", [0, 1, 8, 511, 512, 513, 3000])
@pytest.mark.parametrize("high", [1, 255, 257, 70_000, 2**32 - 1])
def test_codes_give_back_every_id(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint32)
    code = dac.Dac(dac.dac_encode(ids))
    assert len(code) == n and (code.ids() == ids).all()
    assert [code[i] for i in range(0, n, 7)] == ids[::7].tolist()


@pytest.mark.parametrize("name", ["odd", "small", "none"])
def test_token_files(name, request, spark, tmp_path):
    docs = request.getfixturevalue(name)
    library = load(public_path("byte_bpe_50k.json"))
    want, start, every = [], 0, []
    for i, text in ids_of(docs):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every += ids
    path = str(tmp_path / "ids")
    dac.write_token_ids(docs.repartition(4), path, segment_ids=500)
    assert sorted(map(tuple, dac.read_documents(spark, path).collect()), key=repr) == sorted(want, key=repr)
    places = list(range(0, len(every), max(1, len(every) // 20)))
    if places:
        assert {r.place: r.id for r in dac.read_tokens(spark, path, places).collect()} == {p: every[p] for p in places}


@pytest.mark.parametrize("name", ["odd", "small", "none"])
def test_fingerprints(name, request):
    docs = request.getfixturevalue(name)
    rows, want = ids_of(docs), []
    for k, (i, text) in enumerate(rows):
        new = cws.edited(text, rows[(k + 1) % len(rows)][1])
        own, changed, following = cws.signatures([text, new, rows[(k + 1) % len(rows)][1]])
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), own.astype(">u2").tobytes().hex(), float((own == changed).mean()), float((own == following).mean())))
    got = cws.fingerprints(docs.repartition(3)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_samples_collide_as_often_as_texts_are_alike():
    weights = lambda t: {w: t.split().count(w) * len(w) for w in t.split()}
    pick = random.Random(3)
    for _ in range(5):
        a, b = [" ".join(pick.choices([f"w{i}" * (1 + i % 3) for i in range(40)], k=60)) for _ in "ab"]
        x, y = weights(a), weights(b)
        alike = sum(min(x.get(w, 0), y.get(w, 0)) for w in x | y) / sum(max(x.get(w, 0), y.get(w, 0)) for w in x | y)
        one, two = cws.signatures([a, b], samples=4_000)
        assert abs((one == two).mean() - alike) < 0.03


def test_sketch_bound_is_safe():
    for k, percent in ((32, 85), (32, 80), (64, 50)):
        c = agreeing(k, percent)
        draws = np.random.default_rng(0).binomial(k, percent / 100, 200_000)
        assert 0 < c <= draws.min()


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(small, width, percent):
    docs = {r.doc_id: r.text for r in small.collect()}
    want = brute.near_duplicates(docs, width, percent)
    got = near_duplicates(small, width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_crowds_of_near_copies(spark):
    """Groups larger than a list may be, a passage in many texts, and chains at the threshold."""
    pick, docs = random.Random(4), {}
    word = lambda: f"w{pick.randrange(10_000)}"
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    for i in range(3 * LONG):
        copy = list(base)
        for _ in range(pick.randrange(9)):
            copy[pick.randrange(len(copy))] = word()
        docs[len(docs)] = " ".join(copy)
        docs[len(docs)] = " ".join(passage + [word() for _ in range(pick.randrange(1, 40))])
        docs[len(docs)] = " ".join(word() for _ in range(pick.randrange(1, 30)))
    docs |= {1_000 + i: " ".join(base) for i in range(2 * LONG)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, 3, 85).collect()}
    assert got == brute.near_duplicates(docs, 3, 85)


def test_near_duplicates_of_odd_rows(odd):
    got = near_duplicates(odd, 3, 85).collect()
    assert len(got) == odd.count()
    component = {r.doc_id: r.component_id for r in got}
    assert component == {None: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 1, 9: 2, 10: 10, 11: 2}
    assert all(r.kept for r in got if r.doc_id is None)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id in (3, 4, 7, 2)} == {3: 0, 4: 0, 7: 0, 2: 1}
    kept = deduplicated(odd, width=3, percent=85)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, None, 1, 2, 3, 4, 5, 7, 10], key=str)


def test_an_id_with_two_texts_is_one_document(spark):
    texts = [(1, "a b c d"), (2, "a b c d"), (2, "e f g h"), (3, "e f g h")]
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()
    assert {r.component_id for r in got} == {1} and len(got) == 4
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def labelled_texts(n, seed):
    """Texts of invented words; toxic ones hold words of two stems with ever new endings."""
    pick = random.Random(seed)
    syllable = lambda k: "".join(pick.choice(["ta", "ro", "mi", "en", "lu", "so", "be", "ki"]) for _ in range(k))
    rows = []
    for i in range(n):
        words = [syllable(pick.randint(1, 3)) for _ in range(pick.randint(10, 60))]
        toxic = i % 3 == 0
        for _ in range(len(words) // 8 + 1 if toxic else 0):
            words[pick.randrange(len(words))] = pick.choice(["grozza", "vexxal"]) + syllable(pick.randint(0, 2))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rows = labelled_texts(600, 6)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows] + [(None, 1, 1), (3, 0, None), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_toxicity(toxic_tables):
    docs, labels, truth = toxic_tables
    got = scored(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(got) == len(truth)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_unseen_spellings_share_subwords():
    rows = labelled_texts(400, 8)
    model = SubwordSoftmax.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    assert model.score("lu grozzaq mi ta so") > 0.5 > model.score("lu tarokimi mi ta so")


def test_toxicity_of_odd_rows(odd, none, spark, toxic_tables):
    _, labels, _ = toxic_tables
    rows = scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 7)}) == 1
    assert scored(none, labels).count() == 0
    empty = spark.createDataFrame([], labels.schema)
    assert {r.score for r in scored(odd, empty).collect()} == {0.5}
    assert without_toxic(odd, labels).columns == odd.columns


def test_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 12)]) for i in range(700)]
    rows += [(i + 1_000, rows[i][1]) for i in range(0, 700, 50)]  # ties
    rows += [(200, rows[200][1]), (5_000, [float("nan")] * 12), (6_000, [None] * 12), (7_000, None), (8_000, [float("inf")] * 12), (9_001, [1.0, 2.0]), (9_100, [1.0]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    usable = [(r.vec_id, [int(np.floor(1024 * float(np.float32(x)))) for x in r.embedding]) for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    want = set()
    for q, a in {i: min(v for j, v in usable if j == i) for i, _ in usable if i % 100 == 0}.items():
        found = sorted((-int(np.dot(a, b)), j) for j, b in usable if j != q and len(a) == len(b))[:10]
        want |= {(q, k + 1, j, -s) for k, (s, j) in enumerate(found)}
    got = bitslice.top_k(df.withColumn("rank", F.lit("clash")), F.col("id") % 100 == 0)
    assert {tuple(r) for r in got.collect()} == want
    assert bitslice.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0


@pytest.mark.parametrize("high", [1, 300, 2**20])
def test_sums_of_slices_are_exact(high):
    rng = np.random.default_rng(high)
    values = rng.integers(0, high + 1, (130, 5))
    block = bitslice.SlicedBlock(values, slices=21)
    weights = rng.integers(0, 1000, 5)
    sums = block.weighted_sum(weights)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) for s in sums]
    got, want = sum(b << i for i, b in enumerate(bits)), values @ weights
    assert (got - got[0] == want - want[0]).all()  # complements add the same to every row


def test_pipeline_stages(spark, toxic_tables, tmp_path):
    docs, labels, truth = toxic_tables
    copies = docs.filter("doc_id < 90").withColumn("doc_id", F.col("doc_id") + 10_000)
    folder = str(tmp_path)
    docs.union(copies).union(docs.limit(0).union(spark.createDataFrame([(20_000, None, None, None, None), (20_001, "", None, None, 0)], docs.schema))).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    rows, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, folder)
        kept.append(rows)
    clean, unique, mixed_rows, packed = kept
    assert clean.columns == unique.columns == mixed_rows.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    wrong = [i for i, y in truth.items() if (i in left) == bool(y)]
    assert len(wrong) < 0.05 * len(truth)
    groups = brute.near_duplicates(left, 5, 80)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert packed.count() == mixed_rows.count()
    assert corpus_pipeline.run(spark, folder).count() == packed.count()
