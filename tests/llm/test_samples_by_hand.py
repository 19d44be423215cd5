"""Consistent weighted samples against plain loops over words."""

import math
import random
from collections import Counter

from tests.llm.brute import WORD
from tests.llm.test_texts import ids_of
from tidemark.llm import cws

MASK = 2**64 - 1
BASE = 0x9E3779B97F4A7C15 | 1


def spread(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def word_hash(word):
    total, power = 0, 1
    for byte in word.encode():
        total = (total + (byte + 32 * (65 <= byte <= 90) + 1) * power) & MASK
        power = power * BASE & MASK
    return spread(total)


def plain_signature(text, samples):
    """Per sample, the word of the smallest c / (y exp(r)), and its step on the grid, as one 16-bit number."""
    weights = Counter()
    for word in WORD.findall(text):
        weights[word_hash(word)] += len(word.encode())
    out = []
    for k in range(1, samples + 1):
        best = None
        for h, weight in weights.items():
            seed = (h + spread(k)) & MASK
            draws = [spread((seed + j * 0xD1B54A32D192ED03) & MASK) for j in (1, 2, 3)]
            (u1, u2), (u3, u4), (b, _) = [(((d >> 32) + 0.5) / 2**32, ((d & 0xFFFFFFFF) + 0.5) / 2**32) for d in draws]
            r, c = -math.log(u1 * u2), -math.log(u3 * u4)
            step = math.floor(math.log(weight) / r + b)
            score = math.log(c) - r - r * (step - b)
            if best is None or score < best[0]:
                best = (score, h, step)
        out.append(spread((best[1] + spread(best[2] & MASK)) & MASK) % 65535 + 1 if best else 0)
    return out


def test_samples_are_those_of_plain_loops():
    """The fast form works in 32-bit numbers, so a sample in some thousands may fall to a near rival."""
    pick = random.Random(51)
    words = ["the", "The", "ß", "naïve", "x", "word", "日本", "a-b", "it's", "12"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(pick.choices(words, k=pick.randint(1, 80))) for _ in range(25)] + ["", " \t\n", "One", "one  ONE\x0bone"]
    got = cws.signatures(texts, 64)
    differ = sum(int(a) != b for text, row in zip(texts, got) for a, b in zip(row, plain_signature(text, 64)))
    assert differ <= 4
    assert (got[-1] != 0).all() and not got[-3].any() and not got[-4].any()


def test_fingerprints_of_a_table(small):
    """The table's fingerprints and likenesses, from plain samples."""
    rows = ids_of(small.filter("n_chars < 1500"))[:12]
    docs = small.filter(small["doc_id"].isin([i for i, _ in rows]))
    got = {r["doc_id"]: r for r in cws.fingerprints(docs).collect()}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        own, changed, after = (plain_signature(t, cws.SAMPLES) for t in (text, text[: len(text) - half] + following[:half], following))
        alike = lambda x: sum(a == b for a, b in zip(own, x)) / cws.SAMPLES
        assert abs(got[i]["near_edited"] - alike(changed)) <= 2 / cws.SAMPLES and abs(got[i]["near_next"] - alike(after)) <= 2 / cws.SAMPLES
        spelled = "".join(f"{x:04x}" for x in own)
        assert sum(got[i]["fingerprint"][4 * j : 4 * j + 4] != spelled[4 * j : 4 * j + 4] for j in range(cws.SAMPLES)) <= 2
