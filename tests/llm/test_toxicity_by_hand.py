"""The subword softmax against plain loops: buckets, averages, training steps and scores."""

import math
import string
import zlib

import numpy as np
import pytest

from tests.llm.test_texts import labelled_texts
from tidemark.llm import subwords as S
from tidemark.llm.toxicity import scored

MASK = 2**64 - 1
MULTIPLIER = 0x9E3779B97F4A7C15


def plain_buckets(word):
    framed = "<" + (word.strip(string.punctuation) or word) + ">"
    found = []
    for n in (len(framed), 3, 4, 5):
        whole = not found
        for at in range(1 if whole else max(0, len(framed) - n + 1)):
            h, power = 0 if whole else n, 1
            for c in framed[at : at + n]:
                power = power * MULTIPLIER & MASK
                h = (h + (ord(c) + 1) * power) & MASK
            h = (h ^ (h >> 29)) * MULTIPLIER & MASK
            found.append((h >> 33) % S.BUCKETS)
    return found


def plain_average(vectors, text):
    """Mean over the words of a text, repeats counted, of the mean of each word's subword vectors."""
    words = text.lower().split()
    total = [0.0] * S.DIMENSIONS
    for word in words:
        buckets = plain_buckets(word)
        for b in buckets:
            for d in range(S.DIMENSIONS):
                total[d] += vectors.get(b, [0.0] * S.DIMENSIONS)[d] / len(buckets) / len(words)
    return total


def plain_softmax(average, weights, bias):
    logits = [sum(a * weights[d][c] for d, a in enumerate(average)) + bias[c] for c in (0, 1)]
    top = max(logits)
    e = [math.exp(z - top) for z in logits]
    return [x / sum(e) for x in e]


def plain_fit(texts, labels, rounds):
    """Adam on the balanced cross-entropy with a small weight on the squared vectors, every number its own slope."""
    rng = np.random.default_rng(S.SEED)
    start = rng.normal(0, 0.1, (S.BUCKETS, S.DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 1, (S.DIMENSIONS, 2)).astype(np.float32).tolist()
    inside = [{b for w in t.lower().split() for b in plain_buckets(w)} for t in texts]
    per_class = [labels.count(0), labels.count(1)]
    used = []
    for b in sorted(set().union(*inside)):
        count = [sum(b in own and y == c for own, y in zip(inside, labels)) for c in (0, 1)]
        if sum(count) >= 3 and not all(n > 0.4 * m for n, m in zip(count, per_class)):
            used.append(b)
    params = {("v", b, d): float(start[b, d]) for b in used for d in range(S.DIMENSIONS)}
    params |= {("w", d, c): weights[d][c] for d in range(S.DIMENSIONS) for c in (0, 1)} | {("b", c): 0.0 for c in (0, 1)}
    first, second = dict.fromkeys(params, 0.0), dict.fromkeys(params, 0.0)
    balance = [1 / max(1, per_class[y]) ** S.BALANCE for y in labels]
    balance = [b / sum(balance) for b in balance]
    firm = min(S.FIRMEST, S.FIRM / len(labels))
    unpack = lambda: (
        {b: [params["v", b, d] for d in range(S.DIMENSIONS)] for b in used},
        [[params["w", d, c] for c in (0, 1)] for d in range(S.DIMENSIONS)],
        [params["b", c] for c in (0, 1)],
    )
    for step in range(1, rounds + 1):
        vectors, w, bias = unpack()
        slope = {k: firm * v if k[0] == "v" else 0.0 for k, v in params.items()}
        for text, y, weight in zip(texts, labels, balance):
            average = plain_average(vectors, text)
            chance = plain_softmax(average, w, bias)
            words = text.lower().split()
            for c in (0, 1):
                wrong = (chance[c] - (y == c)) * weight
                slope["b", c] += wrong
                for d in range(S.DIMENSIONS):
                    slope["w", d, c] += average[d] * wrong
                for word in words:
                    buckets = plain_buckets(word)
                    for b in buckets:
                        if b in vectors:
                            for d in range(S.DIMENSIONS):
                                slope["v", b, d] += w[d][c] * wrong / len(buckets) / len(words)
        for k, g in slope.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            params[k] -= S.RATE * (first[k] / (1 - 0.9**step)) / (math.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return unpack()


def test_buckets():
    words = ["a", "it's", "(Grozza!)", "...", "ünïçödé", "日本語", "x" * 40, "-"]
    buckets, starts = S.subwords(words)
    assert [sorted(own.tolist()) for own in np.split(buckets, starts[1:])] == [sorted(plain_buckets(w)) for w in words]


@pytest.mark.parametrize("rounds", [1, 4])
def test_training_and_scores(rounds):
    rows = [(t, y) for _, t, y in labelled_texts(24, 31)] + [("", 0), ("... !", 1)]
    texts, labels = [t for t, _ in rows], [y for _, y in rows]
    model = S.SubwordSoftmax.fit(texts, labels, rounds)
    vectors, weights, bias = plain_fit(texts, labels, rounds)
    assert np.allclose(model.weights, weights, atol=2e-3) and np.allclose(model.bias, bias, atol=2e-3)
    for text in texts + ["never seen grozzaxy", "lu lu lu ta ro", ""]:
        want = plain_softmax(plain_average(vectors, text) if text.split() else [0.0] * S.DIMENSIONS, weights, bias)[1]
        assert abs(model.score(text) - want) < 2e-3, text


def test_scores_of_a_table(spark):
    """The query's rows are the plain scores of the model that the labels outside fold 0 give."""
    rows = labelled_texts(90, 32)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    fitted = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    model = S.SubwordSoftmax.fit([t for t, _ in fitted], [y for _, y in fitted])
    vectors = {b: model.vectors[b].tolist() for b in np.flatnonzero(model.vectors.any(1)).tolist()}
    for r in scored(docs, labels).collect():
        want = plain_softmax(plain_average(vectors, rows[r.doc_id][1]), model.weights.tolist(), model.bias.tolist())[1]
        assert abs(r.score - want) < 1e-5 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
