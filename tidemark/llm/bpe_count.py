"""Token counts by merging, without making identifiers."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame

from tidemark.llm.tasks import map_batches
from tidemark.llm.tokenizing import MAX_CACHED, UNUSUAL, public_path

LIMIT = 2_048
VOCABULARY = "word_bpe_49k.json"
_counters: dict[str, "MergeCounter"] = {}


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others take the characters from
    256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


PAIR = 1 << 20  # above any symbol's number
PLACE = 1 << 32  # above any place in a word


def merge_table(merges: list[list[str]], symbols: list[str]) -> tuple[dict[str, int], dict[int, int], list[int]]:
    """Numbers of all symbols, rank by pair (first * PAIR + second), and what each rank's merge makes."""
    number: dict[str, int] = {s: i for i, s in enumerate(symbols)}
    ranks, made = {}, []
    for rank, (a, b) in enumerate(merges):
        first, second = number.setdefault(a, len(number)), number.setdefault(b, len(number))
        ranks.setdefault(first * PAIR + second, rank)
        made.append(number.setdefault(a + b, len(number)))
    return number, ranks, made


def count_merged(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Symbols left after merging, always the pair of lowest rank first, leftmost of equals.

    The symbols form a linked list, the candidate pairs a heap of rank and
    place.  A popped pair counts only if the two symbols that stand there now
    still have that rank.
    """
    n = len(symbols)
    heap = [rank * PLACE + i for i in range(n - 1) if (rank := ranks.get(symbols[i] * PAIR + symbols[i + 1])) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    symbols, left, right = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    merges = 0
    while heap:
        rank, i = divmod(heapq.heappop(heap), PLACE)
        j = right[i]
        if j >= n or symbols[i] < 0 or ranks.get(symbols[i] * PAIR + symbols[j]) != rank:
            continue
        merges += 1
        symbol = symbols[i] = made[rank]
        symbols[j] = -1
        after = right[i] = right[j]
        if after < n:
            left[after] = i
            if (rank := ranks.get(symbol * PAIR + symbols[after])) is not None:
                heapq.heappush(heap, rank * PLACE + i)
        before = left[i]
        if before >= 0 and (rank := ranks.get(symbols[before] * PAIR + symbol)) is not None:
            heapq.heappush(heap, rank * PLACE + before)
    return n - merges


class MergeCounter:
    """Counts the tokens of texts under a word-end byte-pair vocabulary file.

    Texts are composed (NFC) and lower-cased, cut by the file's pattern, and
    every cut's bytes are merged.  The file's special strings are one token
    each and are found before anything else.  No token crosses white space, so
    counts are remembered per run of other characters.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        end = spec["model"]["end_of_word_suffix"] or ""
        inner = byte_symbols()
        number, self.ranks, self.made = merge_table(spec["model"]["merges"], inner + [s + end for s in inner])
        self.inner, self.last = [number[s] for s in inner], [number[s + end] for s in inner]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.cut = regex.compile(split["pattern"]["Regex"])
        specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.specials = re.compile("|".join(map(re.escape, specials)))
        self.words: dict[str, int] = {}
        self.runs: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if UNUSUAL.search(text):
            return self._count_run(text)
        runs = self.runs
        if len(runs) > MAX_CACHED // 2:
            runs.clear()
        total = 0
        for run, times in Counter(text.split()).items():
            tokens = runs.get(run)
            if tokens is None:
                tokens = runs[run] = self._count_run(run)
            total += tokens * times
        return total

    def _count_run(self, run: str) -> int:
        plain = self.specials.split(run)
        return len(plain) - 1 + sum(self._count_plain(p) for p in plain if p)

    def _count_plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text)
        # Character by character: a capital sigma at a word's end stays a plain sigma.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return sum(map(self._count_word, self.cut.findall(text)))

    def _count_word(self, word: str) -> int:
        tokens = self.words.get(word)
        if tokens is None:
            if len(self.words) > MAX_CACHED:
                self.words.clear()
            coded = word.encode()
            symbols = [self.inner[b] for b in coded]
            symbols[-1] = self.last[coded[-1]]
            tokens = self.words[word] = count_merged(symbols, self.ranks, self.made)
        return tokens


def counter(path: str) -> MergeCounter:
    """This worker's counter for a file; it outlives the task."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    ``vocabulary`` names a public vocabulary file or is a path.  A null text is
    empty: no bytes, no tokens.  Ids may be null or repeat; every row gives a
    row, an empty table none, and other columns play no part.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def work(batch):
        tokens = counter(vocabulary if "/" in vocabulary else public_path(vocabulary))
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counts = [tokens.count(t) for t in texts]
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
        }

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, work, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
