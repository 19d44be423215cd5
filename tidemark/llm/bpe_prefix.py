"""Byte-pair encoding by the last token of every byte prefix.

The encoding of a byte string ends in one token, and what stands before that
token is the encoding of a shorter prefix.  So one number per prefix, its last
token, holds the encodings of all prefixes.  A token may follow another if
merging their joined bytes would give just these two; a prefix's last token is
the only token at its end that may follow the last token of what is left.
Bytes at the end add numbers and change none, so an append is exact, and an
edit needs new numbers only from the edit to where old and new agree again.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterable
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from tidemark.llm.tasks import map_batches
from tidemark.llm.tokenizing import MAX_CACHED, PIECE, UNUSUAL, public_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: What the pattern calls white space.
SPACE = "\t-\r \x85\xa0  -     　"
#: A fixed value: the public pattern that cuts texts before merging, with its white space spelled out.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
LOOKAHEAD = 2  # characters behind a cut that the pattern may have looked at
MAX_PAIRS = 1 << 19  # pairs of tokens a worker remembers
PAIR = NONE = 1 << 32  # above any rank
_coders: dict[str, "PrefixCoder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file; a rank is the token's id and its place in the order of merges."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixCoder:
    """Encodes byte strings under a table of ranks.

    The tokens that end at a byte come from an automaton whose state is the
    longest beginning of any token that the bytes so far end with; states are
    made when they are first met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.beginnings = {token[:i] for token in ranks for i in range(1, len(token) + 1)}
        self.states, self.state_of = [b""], {b"": 0}
        self.moves: dict[int, int] = {}
        self.ending: list[list[tuple[int, int]]] = [[]]  # by state: tokens that end there and their sizes, longest first
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self)
        self.halves = cache(self._halves)

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes ``token``; None if merging its bytes does not end there."""
        parts = [bytes([b]) for b in self.bytes_of[token]]
        while len(parts) > 2:
            rank, i = min(((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if rank == NONE:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def stands_alone(self, token: int) -> bool:
        """Whether merging a token's bytes gives that token."""
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the joined bytes of two tokens that stand alone merge to these two again.

        They do unless a merge over their border would have come earlier than
        one inside them.  So inner merges next to the border are undone, the
        latest first, and each time the two tokens at the border must not have
        a merge that precedes the one undone last.  Of equal merges the left
        one comes first.
        """
        left, right, before = first, second, NONE
        while True:
            over = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if over is not None and over < before:
                return False
            made_left = left if len(self.bytes_of[left]) > 1 else -1
            made_right = right if len(self.bytes_of[right]) > 1 else -1
            if made_left == made_right == -1:
                return True
            if made_left > made_right:
                before, left = made_left, self.halves(left)[1]
            else:
                before, right = made_right + 1, self.halves(right)[0]

    def _known_pair(self, first: int, second: int) -> bool:
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        known = self.pairs[first * PAIR + second] = self.may_follow(first, second)
        return known

    def _state(self, seen: bytes) -> int:
        """The state after ``seen``."""
        while seen and seen not in self.beginnings:
            seen = seen[1:]
        if seen not in self.state_of:
            self.state_of[seen] = len(self.states)
            self.states.append(seen)
            ends = [self.ranks[seen[i:]] for i in range(len(seen)) if seen[i:] in self.ranks]
            self.ending.append([(t, len(self.bytes_of[t])) for t in ends if self.stands_alone(t)])
        return self.state_of[seen]

    def _move(self, state: int, byte: int) -> int:
        made = self.moves[state << 8 | byte] = self._state(self.states[state] + bytes([byte]))
        return made

    def extend(self, data: bytes, last: list[int]) -> None:
        """Add to ``last``, the last tokens of the first prefixes of ``data``, those of all longer ones."""
        moves, ending, pairs = self.moves, self.ending, self.pairs
        end = len(last)
        state = self._state(data[max(0, end - self.longest) : end])
        for byte in data[end:]:
            end += 1
            key = state << 8 | byte
            state = moves[key] if key in moves else self._move(state, byte)
            for token, size in ending[state]:
                if size == end:
                    break
                before = last[end - size - 1]
                known = pairs.get(before * PAIR + token)
                if known or (known is None and self._known_pair(before, token)):
                    break
            last.append(token)

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding of ``data`` from its prefixes' last tokens; bytes that are a token are that token."""
        if data in self.ranks:
            return [self.ranks[data]]
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        last: list[int] = []
        if data not in self.ranks:
            self.extend(data, last)
        return self.tokens(data, last)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if len(self.pieces) > MAX_CACHED // 2:
            self.pieces.clear()
        # The quick cuts are cuts of the pattern too; what they leave whole, the pattern cuts on.
        cut = PATTERN if UNUSUAL.search(text) else PIECE
        return b"".join(map(self.pieces.__getitem__, cut.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Ids of pieces met before."""

    def __init__(self, coder: PrefixCoder):
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        ids = [t for own in PATTERN.findall(piece) for t in self.coder.encode_piece(own.encode())]
        made = self[piece] = np.array(ids, dtype="<u4").tobytes()
        return made


class PrefixText:
    """A text that keeps the last tokens of its prefixes, for appends and edits.

    ``worked`` counts the bytes whose last token was worked out so far.
    """

    def __init__(self, coder: PrefixCoder, text: str = ""):
        self.coder, self.text, self.worked = coder, "", 0
        self.starts: list[int] = []  # of the pieces, in characters
        self.pieces: list[tuple[bytes, list[int]]] = []  # their bytes, and the last tokens of these bytes' prefixes
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), 0, text)

    def replace(self, at: int, removed: int, inserted: str) -> None:
        """Put ``inserted`` in the place of ``removed`` characters from character ``at`` on.

        Pieces that end well before the edit stay, and so do all from the first
        old cut behind it that is a cut again.  A piece that changed keeps the
        numbers of the bytes that it still begins with.
        """
        old = len(self.text)
        at = min(max(at, 0), old)
        removed = min(max(removed, 0), old - at)
        self.text = self.text[:at] + inserted + self.text[at + removed :]
        ends = [*self.starts[1:], old] if self.starts else []
        first = bisect_right(ends, at - LOOKAHEAD)
        shift, behind = len(inserted) - removed, at + len(inserted)
        old_cuts = {start + shift: i for i, start in enumerate(self.starts) if start >= at + removed and i >= first}
        starts, pieces, again = [], [], len(self.starts)
        for found in PATTERN.finditer(self.text, self.starts[first] if first < len(ends) else (ends[-1] if ends else 0)):
            if found.start() >= behind and found.start() in old_cuts:
                again = old_cuts[found.start()]
                break
            data, k = found[0].encode(), first + len(pieces)
            last: list[int] = []
            if k < len(self.pieces):
                was, known = self.pieces[k]
                same = next((i for i, (a, b) in enumerate(zip(was, data)) if a != b), min(len(was), len(data)))
                last = known[:same]
            self.worked += len(data) - len(last)
            self.coder.extend(data, last)
            starts.append(found.start())
            pieces.append((data, last))
        self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[again:]]
        self.pieces = self.pieces[:first] + pieces + self.pieces[again:]

    def ids(self) -> list[int]:
        return [token for data, last in self.pieces for token in self.coder.tokens(data, last)]


def coder(vocabulary: str) -> PrefixCoder:
    """This worker's coder for a public rank file or a path; it outlives the task."""
    path = vocabulary if "/" in vocabulary else public_path(vocabulary)
    if path not in _coders:
        _coders[path] = PrefixCoder(read_ranks(path))
    return _coders[path]


def _id_type(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def encode_texts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text, the ids as little-endian unsigned 32-bit numbers.

    A null text is empty and has no ids.  Ids of documents may be null or
    repeat; every row gives a row, an empty table none, and other columns play
    no part.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def work(batch):
        own = coder(vocabulary)
        return {"doc_id": batch.column("doc_id"), "ids": [own.encode(t or "") for t in batch.column("text").to_pylist()]}

    return map_batches(rows, work, f"doc_id {_id_type(rows)}, ids binary")


def decode_ids(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``decoded``, the bytes that ``ids`` stand for (null ids: none), to ``doc_id, ids``; other columns go."""
    rows = encoded.select("doc_id", "ids")

    def work(batch):
        own = coder(vocabulary)
        decoded = [own.decode(ids or b"") for ids in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "decoded": decoded}

    return map_batches(rows, work, f"doc_id {_id_type(rows)}, ids binary, decoded binary")


def round_trips(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: :func:`encode_texts`, and :func:`decode_ids` of what it gives, in one pass."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def work(batch):
        own = coder(vocabulary)
        ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [own.decode(i) for i in ids]}

    return map_batches(rows, work, f"doc_id {_id_type(rows)}, ids binary, decoded binary")


def encode_edits(edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids, worked`` of edited texts, each encoded from the encoding of the text before.

    ``edits`` has ``doc_id, text`` and ``edits array<struct<at, removed,
    inserted>>``, applied in their order; places count characters and are moved
    into the text.  ``worked`` counts the bytes whose last token the edits made
    anew.  Null texts, edits, and insertions are empty; a null number is 0.
    """
    rows = edits.select("doc_id", "text", "edits")

    def work(batch):
        own, out = coder(vocabulary), {"ids": [], "worked": []}
        for text, changes in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
            kept = PrefixText(own, text or "")
            before = kept.worked
            for change in _present(changes):
                kept.replace(change["at"] or 0, change["removed"] or 0, change["inserted"] or "")
            out["ids"].append(np.array(kept.ids(), dtype="<u4").tobytes())
            out["worked"].append(kept.worked - before)
        return {"doc_id": batch.column("doc_id")} | out

    return map_batches(rows, work, f"doc_id {_id_type(rows)}, ids binary, worked long")


def _present(changes: Iterable[dict | None] | None) -> list[dict]:
    return [c for c in changes or [] if c is not None]
