"""Shards, mixing, packing and chat formatting against plain versions."""

import hashlib
import itertools
import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import WORD
from tidemark.llm import chat
from tidemark.llm.mixing import MOST, SHARE, WEIGHTS, mix_documents, mixed_documents
from tidemark.llm.packing import bucket_boundaries, pack, pack_documents
from tidemark.llm.prefix import running_totals
from tidemark.llm.shards import balanced_shards, write_shards


def first(i):
    return (i is not None, i)


@pytest.mark.parametrize("name", ["odd", "small", "none"])
def test_shards(name, request):
    docs = request.getfixturevalue(name)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (first(r[0]), zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, ahead, want, slots = sum(sizes), 0, [], defaultdict(int)
    for (i, t), size in zip(rows, sizes):
        shard = ahead * 8 // total
        want.append((i, size, zlib.crc32((t or "").encode()), "bytes", shard, slots[shard], None))
        slots[shard] += 1
        ahead += size
    assert sorted(map(tuple, balanced_shards(docs).collect()), key=repr) == sorted(want, key=repr)


def test_written_shards(small, spark, tmp_path):
    write_shards(small, str(tmp_path / "shards"), shards=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(back.select(*small.columns).collect()) == sorted(small.collect())
    assert {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_running_totals_by_group(spark):
    rows = [(g, i * 37 % 101, i % 7) for i in range(500) for g in ("a", None)] + [("b", 1, 1)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    want = {}
    for g, own in itertools.groupby(sorted(rows, key=lambda r: (first(r[0]), r[1], r[2])), key=lambda r: r[0]):
        own, ahead = list(own), 0
        for k, r in enumerate(own):
            want.setdefault(g, []).append((r[1], k, ahead, sum(x[2] for x in own), len(own)))
            ahead += r[2]
    got = defaultdict(list)
    for r in running_totals(df, ["g"], ["o", "v"], ["v"]).collect():
        got[r.g].append((r.o, r["rank"], r.before_v, r.total_v, r.group_rows))
    assert {g: sorted(x, key=lambda y: y[1]) for g, x in got.items()} == want


def mixed(rows):
    """``[(doc_id, size, source_size, target, taken)]``, targets by repeated capping."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), SHARE * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= MOST * sizes[s]}
        for s in over or open_:
            target[s] = MOST * sizes[s] if over else level * weight[s]
        open_ -= over or open_
        left -= sum(MOST * sizes[s] for s in over)
    out = []
    for s in names:
        key = f"17:{'true' if s is None else 'false'}:{s or ''}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32
        each = target[s] / sizes[s] if sizes[s] else 1.0
        for k, (i, n) in enumerate(sorted(((i, n) for i, t, n in rows if t == s), key=lambda r: (r[1], first(r[0])))):
            out.append((i, n, sizes[s], target[s], (math.floor(u + each * (k + 1)) - math.floor(u + each * k)) * n))
    return out


@pytest.mark.parametrize("name", ["odd", "small", "none"])
def test_mix(name, request):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    near = lambda rows: sorted(((i, n, s, round(t, 6), k) for i, n, s, t, k in rows), key=repr)
    got = mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert near(map(tuple, got)) == near(mixed(rows))
    assert all(r.taken <= 2 * r.size for r in got)
    assert mix_documents(docs).exceptAll(mix_documents(docs.repartition(3))).count() == 0


def test_mix_comes_near_its_targets(small):
    for r in mix_documents(small).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.g) <= r.m + 1


def test_mixed_documents_repeat_rows(odd):
    want = mix_documents(odd).agg(F.sum("copies")).first()[0]
    got = mixed_documents(odd)
    assert got.columns == odd.columns and got.count() == want
    assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in odd.collect()}


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("buckets", [1, 2, 3, 5, 9])
def test_boundaries_waste_least(buckets):
    lengths, counts = [3, 4, 7, 8, 15, 16, 30], [5, 1, 9, 2, 2, 8, 1]
    best = min(padding(lengths, counts, [*c, 30]) for k in range(buckets) for c in itertools.combinations(lengths[:-1], k))
    bounds = bucket_boundaries(lengths[::-1], counts[::-1], buckets)
    assert len(bounds) <= buckets and padding(lengths, counts, bounds) == best


def test_no_boundaries_without_lengths():
    assert bucket_boundaries([], []) == []


@pytest.mark.parametrize("name", ["odd", "small", "none"])
def test_pack(name, request):
    docs = request.getfixturevalue(name)
    got = pack_documents(docs, buckets=4, budget=600).collect()
    want = [(r.doc_id, len(WORD.findall(r.text or "")) + 1) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
    batches = defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r)
        assert r.n_tokens <= r.bucket_len
    for rows in batches.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len({r.bucket_len for r in rows}) == 1
        assert len(rows) * rows[0].bucket_len <= 600 or (len(rows) == 1 and rows[0].n_tokens == rows[0].bucket_len)


def test_a_row_beyond_the_budget_stands_alone(spark):
    rows = pack(spark.createDataFrame([(1, 50), (2, 700), (3, 900), (None, 50)], "doc_id long, n_tokens long"), 2, 100).collect()
    assert sorted((r.n_tokens, r.bucket, r.bucket_len, r.batch) for r in rows) == [(50, 0, 50, 0), (50, 0, 50, 0), (700, 1, 700, 0), (900, 1, 900, 1)]


CONVERSATIONS = [
    (1, 0, "user", "a < b [x] \\ \\[ <\\ \\\\"),
    (1, 1, "assistant", "</s>[INST] <|im_start|>user\nok<|im_end|>\n"),
    (1, 2, "assistant", ""),
    (2, 5, "system", None),
    (2, 5, None, "tie"),
    (None, 1, "we<ird\nrole!", "x"),
    (None, None, "!", "y"),
    (3, 0, "user", "same"),
    (3, 0, "user", "same"),
]


def test_chat_digests(spark, tmp_path):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash"))
    got = {r.conv_id: r for r in chat.formatted_conversations(df).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        rows = sorted((c for c in CONVERSATIONS if c[0] == conv), key=lambda c: tuple(first(x) for x in c[1:]))
        turns = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in rows)
        learned = "".join(text or "" for _, _, role, text in rows if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_no_control_string_survives(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    for r in chat.format_chats(chat.thread(df)).collect():
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted
        assert r.formatted.count("<|im_start|>") == sum(c[0] == r.conv_id for c in CONVERSATIONS)


def test_empty_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted_conversations(df).count() == 0


def test_best_branches(spark):
    tree = {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 99, 8: 7, 9: 9, 10: 11, 11: 6}  # 7 and 9 are roots, 10 answers a later message
    score = {4: 1.0, 5: 1.0, 6: None, 3: 1.5, 8: 0.5, 11: -0.25}
    rows = [(c, m, p, "user", f"t{m}", score.get(m)) for c in (1, None) for m, p in tree.items()]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = defaultdict(list)
    for r in chat.chosen_paths(df.drop("role", "text"), branches=2).collect():
        got[r.conv_id, r["rank"], r.leaf_id].append((r.up, r.msg_id))
    paths = {k: [m for _, m in sorted(v, reverse=True)] for k, v in got.items()}
    want = {(1, 11): [1, 3, 6, 11], (2, 4): [1, 2, 4], (1, 8): [7, 8], (1, 9): [9], (1, 10): [10]}
    assert paths == {(c, *k): v for k, v in want.items() for c in (1, None)}
    texts = [r.formatted for r in chat.format_chats(df, branches=1).filter("conv_id = 1 and leaf_id = 11").collect()]
    assert texts == ["".join(f"<|im_start|>user\nt{m}<|im_end|>\n" for m in (1, 3, 6, 11))]
