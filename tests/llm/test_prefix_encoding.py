"""Byte-pair encoding by prefixes against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.test_texts import PARTS, ids_of, scrambled
from tidemark.llm import bpe_prefix
from tidemark.llm.queries import op11_prefix_encoding

MORE = PARTS + ["'ll", "''", "-", "(", "ing", "tion", "x", "aaaa", "Ж", "　", "5́", "<|endoftext|>x"]


@pytest.fixture(scope="module")
def library():
    ranks = bpe_prefix.read_ranks(public_tokenizers.path(bpe_prefix.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe_prefix.coder(bpe_prefix.VOCABULARY)


def ids(encoded):
    return np.frombuffer(encoded, "<u4").tolist()


def test_ids_are_the_library_s(library, coder):
    pick = random.Random(12)
    texts = scrambled(2_000, 11) + ["".join(pick.choices(MORE, k=pick.randint(0, 20))) for _ in range(2_000)]
    for text in texts + ["a" * 5_000, "ab" * 3_000, " " * 1_000, "é" * 1_000]:
        assert ids(coder.encode(text)) == library.encode_ordinary(text), repr(text)
        assert coder.decode(coder.encode(text)).decode() == text


def test_every_character_is_cut_as_in_the_library(library, coder):
    for code in [*range(0xD800), *range(0xE000, 0x30000, 7)]:
        text = f"a{chr(code)}{chr(code)}1 {chr(code)}."
        assert ids(coder.encode(text)) == library.encode_ordinary(text), hex(code)


def test_small_vocabularies(coder):
    """Every string over two letters, under merges that compete with each other."""
    for merges in (["ab", "ba", "aa", "aab", "abab"], ["bb", "abb", "ab", "ba", "bbb", "aba"], ["aa", "aaaa", "ba", "baa"]):
        ranks = {bytes([b]): b for b in range(256)} | {m.encode(): 256 + i for i, m in enumerate(merges)}
        own = bpe_prefix.PrefixCoder(ranks)
        library = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for n in range(1, 12):
            for bits in range(1 << n):
                text = "".join("ab"[bits >> i & 1] for i in range(n))
                assert own.encode_piece(text.encode()) == library.encode_ordinary(text), (merges, text)


def test_appends_and_edits_are_exact(library, coder):
    pick = random.Random(13)
    for _ in range(300):
        kept = bpe_prefix.PrefixText(coder, "".join(pick.choices(MORE, k=pick.randint(0, 60))))
        for _ in range(6):
            new = "".join(pick.choices(MORE, k=pick.randint(0, 3)))
            if pick.random() < 0.3:
                kept.append(new)
            else:
                kept.replace(pick.randint(0, len(kept.text) + 1), pick.randint(0, 4), new)
            assert kept.ids() == library.encode_ordinary(kept.text), repr(kept.text)


def test_an_edit_works_near_itself_only(coder):
    words = " ".join(f"word{i}" for i in range(5_000))
    kept = bpe_prefix.PrefixText(coder, words)
    before = kept.worked
    kept.replace(20_000, 3, "xyz")
    kept.append("more")
    assert kept.worked - before < 100 and before == len(words)
    run = bpe_prefix.PrefixText(coder, "ab" * 10_000)
    run.append("ab")
    assert run.worked == 20_002  # one piece: an append adds the numbers of its own bytes


@pytest.mark.parametrize("name", ["odd", "small", "none"])
def test_round_trips(name, request, library):
    docs = request.getfixturevalue(name)
    rows = bpe_prefix.round_trips(docs.repartition(3)).collect()
    want = [(i, library.encode_ordinary(t), t) for i, t in ids_of(docs)]
    assert sorted(((r.doc_id, ids(r.ids), bytes(r.decoded).decode()) for r in rows), key=repr) == sorted(want, key=repr)
    parts = bpe_prefix.decode_ids(bpe_prefix.encode_texts(docs))
    assert sorted(map(tuple, parts.collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_the_query(spark, tiny, small, library):
    got = {r.doc_id: r for r in op11_prefix_encoding(spark, tiny).collect()}
    for i, text in ids_of(small):
        own = library.encode_ordinary(text)
        assert got[i].n_tokens == len(own) and got[i].ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encode_edits(spark, library):
    rows = [
        (1, "The cat sat", [(4, 3, "dog"), (11, 0, " down")]),
        (2, None, [(0, 0, "new")]),
        (3, "kept", None),
        (4, "odd", [None, (None, None, None), (99, 5, "!")]),
        (None, "", []),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at: int, removed: int, inserted: string>>")
    got = {r.doc_id: ids(r.ids) for r in bpe_prefix.encode_edits(df).collect()}
    want = {1: "The dog sat down", 2: "new", 3: "kept", 4: "odd!", None: ""}
    assert got == {i: library.encode_ordinary(t) for i, t in want.items()}
    assert bpe_prefix.encode_edits(df.limit(0)).count() == 0
