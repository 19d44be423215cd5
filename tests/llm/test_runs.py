"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_texts import ids_of
from tidemark.llm import runs
from tidemark.llm.queries import op13_branching_runs


def brute(words, least_length=6, least_periods=4):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = max(i, j) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least_length, least_periods * q))


def row(doc_id, text):
    """What the contract asks for, from plain loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    own = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *own, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (1, 3)])
def test_runs_of_random_texts(least):
    pick = random.Random(21)
    for _ in range(800):
        texts = []
        for _ in range(pick.randint(1, 5)):
            letters = pick.choice([1, 2, 3, 5])
            text = [pick.randrange(letters) for _ in range(pick.randint(0, 60))]
            if text and pick.random() < 0.5:
                a = pick.randrange(len(text))
                p = pick.randint(1, max(1, (len(text) - a) // 2))
                text = [text[a + (i - a) % p] if i >= a else text[i] for i in range(len(text))]
            texts.append(text)
        got = runs.runs_of_texts([np.array(t, dtype=np.int64) for t in texts], *least)
        assert [[tuple(r) for r in found.tolist()] for found in got] == [brute(t, *least) for t in texts], texts


def test_suffixes_and_what_they_share():
    pick = random.Random(22)
    for _ in range(100):
        words = [pick.randrange(3) for _ in range(pick.randint(1, 50))]
        order, ranks = runs.suffix_array(np.array([*words, 9]))
        want = sorted(range(len(words) + 1), key=lambda i: [*words, 9][i:])
        assert order.tolist() == want
        shared = [0] + [next(k for k in range(99) if ([*words, 9] + [-1])[a + k] != ([*words, 9] + [-2])[b + k]) for a, b in zip(want, want[1:])]
        assert runs.common_words(order, ranks).tolist() == shared


def test_long_runs():
    for text, want in (([0] * 50_000, (0, 50_000, 1)), ([0, 1] * 25_000, (0, 50_000, 2)), (list(range(700)) * 70, (0, 49_000, 700))):
        (found,) = runs.runs_of_texts([np.array(text)])
        assert [tuple(r) for r in found.tolist()] == [want]


@pytest.mark.parametrize("plant", [False, True])
def test_odd_rows(odd, none, plant):
    got = runs.run_digests(runs.periodic_runs(odd.repartition(2), plant=plant)).collect()
    assert runs.periodic_runs(none).count() == 0
    assert len(got) == odd.count()
    if plant:
        rows = [row(i, t) for i, t in ids_of(odd) if len(t) < 1_000]
        assert sorted((tuple(r) for r in got if r.doc_id not in (1, 8)), key=repr) == sorted(rows, key=repr)


def test_the_query(spark, tiny, small):
    want = sorted(row(i, t) for i, t in ids_of(small) if len(t) < 20_000)
    kept = {r[0] for r in want}
    got = sorted(tuple(r) for r in op13_branching_runs(spark, tiny).collect())
    assert [r for r in got if r[0] in kept] == want and len(got) == small.count()
    assert any(r[1] for r in want)


def test_batches_of_texts_do_not_meet(spark, monkeypatch):
    texts = ["a b a b a b a b", "a b a b a b a b", "", None, "x " * 40, "b a b a b a b a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()}
    assert got == {0: ([(0, 8, 2)], "a b"), 1: ([(0, 8, 2)], "a b"), 2: ([], ""), 3: ([], ""), 4: ([(0, 40, 1)], "x"), 5: ([(0, 9, 2)], "b a c")}
