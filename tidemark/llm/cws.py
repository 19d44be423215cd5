"""Fingerprints by consistent weighted sampling.

A text is a bag of words; a word weighs its count times its bytes.  For every
word and sample, two gamma numbers r, c and a uniform b come from the word's
hash.  The weight is rounded down to the grid ``exp(r (t - b))``; the word with
the smallest ``c / (y exp(r))`` is the sample, together with its grid step t.
Two texts agree on a sample with the probability that is their generalised
Jaccard similarity: the sum of the smaller weights over that of the larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tidemark.llm.shingles import mix, word_hashes
from tidemark.llm.tasks import map_batches, map_stream
from tidemark.storage import written

SAMPLES = 64
CHUNK = 1 << 21  # bytes of text whose words are drawn for together
RESULT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _draws(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c - r and b of each word and sample."""
    seeds = hashes[:, None] + mix(np.arange(1, samples + 1, dtype=np.uint64))[None, :]

    def uniform(k):
        bits = mix(seeds + np.uint64(k * 0xD1B54A32D192ED03 % 2**64))
        high = (bits >> np.uint64(32)).astype(np.float32)
        low = (bits & np.uint64(0xFFFFFFFF)).astype(np.float32)
        return (high + np.float32(0.5)) * np.float32(2**-32), (low + np.float32(0.5)) * np.float32(2**-32)

    (u1, u2), (u3, u4), (b, _) = uniform(1), uniform(2), uniform(3)
    r, c = -np.log(u1 * u2), -np.log(u3 * u4)
    return np.maximum(r, np.float32(1e-6)), np.log(np.maximum(c, np.float32(1e-30))) - r, b


def signatures(texts: Sequence[str], samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples per text; 0 stands for a text without words."""
    hashes, lengths, counts = word_hashes([t.encode() for t in texts])
    words, first, where = np.unique(hashes, return_index=True, return_inverse=True)
    size = lengths[first].astype(np.float64)
    r, q, b = _draws(words, samples)
    out, at, column = np.zeros((len(texts), samples), dtype=np.uint16), 0, np.arange(samples)
    for i, n in enumerate(counts.tolist()):
        if n:
            own, times = np.unique(where[at : at + n], return_counts=True)
            weight = np.log(times * size[own]).astype(np.float32)[:, None]
            step = np.floor(weight / r[own] + b[own])
            best = np.argmin(q[own] - r[own] * (step - b[own]), axis=0)
            chosen = mix(words[own[best]] + mix(step[best, column].astype(np.int64).view(np.uint64)))
            out[i] = chosen % np.uint64(65535) + np.uint64(1)
        at += n
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of samples on which signatures agree."""
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """The second half of a text (by characters, rounded down) replaced by the start of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_rows(ids: Sequence, texts: Sequence[str], samples: int) -> dict:
    """Result columns of all but the last of consecutive documents."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    both = signatures([*texts, *changed], samples)
    own, new = both[: len(texts)], both[len(texts) :]
    spelled = [row.astype(">u2").tobytes().hex() for row in both]
    return {
        "doc_id": list(ids[:-1]),
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": spelled[: len(texts) - 1],
        "edited_fingerprint": spelled[len(texts) :],
        "near_edited": likeness(own[:-1], new),
        "near_next": likeness(own[:-1], own[1:]),
    }


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, in ascending id order; the first follows the last.

    Documents are dealt out by id range and each task reads its range in
    order; only the last document of a range needs another range's first, and
    these few are matched afterwards.  Null texts are empty, null ids come
    first, rows of equal id are in text order, other columns play no part.  A
    text without words has the fingerprint of zeros.  A single row follows
    itself; an empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    result = RESULT.format(id=rows.schema["doc_id"].dataType.simpleString())
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]

    def work(batches):
        ids, texts, size, first = [], [], 0, None
        edge = {"part": None, "first_text": None, "last_text": None}

        def results():
            made = fingerprint_rows(ids, texts, samples)
            n = len(ids) - 1
            return made | {k: [None] * n for k in edge}

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                first = text if first is None else first
                ids.append(name)
                texts.append(text)
                size += len(text)
                if size > CHUNK and len(ids) > 1:
                    yield results()
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield results()
        if ids:
            empty = {k: [None] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            yield {"doc_id": ids[-1:], "part": [TaskContext.get().partitionId()], "first_text": [first], "last_text": texts[-1:]} | empty

    ranges = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    made = written(map_stream(ranges, work, f"{result}, part int, first_text string, last_text string"), "fingerprints")
    edges = made.filter("part is not null")
    # One short row per range: its number, and that of the next range that has rows.
    parts = edges.select("part")
    in_order = Window.partitionBy(F.lit(1)).orderBy("part")
    follows = parts.select("part", F.coalesce(F.lead("part").over(in_order), F.first("part").over(in_order)).alias("next"))
    starts = edges.select(F.col("part").alias("next"), F.col("first_text").alias("next_text"))
    last = edges.select("doc_id", "part", "last_text").join(follows, "part").join(starts, "next")

    def close(batch):
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "last_text", "next_text")]
        each = [fingerprint_rows([name, None], [text, following], samples) for name, text, following in zip(*columns)]
        return {k: [value for row in each for value in row[k]] for k in fingerprint_rows([None, None], ["", ""], samples)}

    closed = map_batches(last.select("doc_id", "last_text", "next_text"), close, result)
    return made.filter("part is null").select(*closed.columns).union(closed)
