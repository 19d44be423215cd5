"""Periodic runs of words, found from branching squares on an enhanced suffix array.

Many texts are worked on together as one sequence of numbers.  A word's number
is its text's own and every text ends in a number that nothing else has, so no
two texts share anything.  Where neighbours of the suffix array agree on d
words, the suffixes on both sides that agree on as many form a node of depth d.
For each suffix i of the smaller side, i + d or i - d on the other side makes a
square that cannot be moved to the right: it branches.  A run of period d ends
in exactly one such square, so rotating the squares to the left gives all runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.tasks import map_stream

LEAST_LENGTH = 6
LEAST_PERIODS = 4
BATCH_WORDS = 1 << 17  # words of texts worked on together; a longer text is on its own
CELLS = 1 << 20  # words compared at one time while squares are rotated


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and each suffix's rank by its first 1, 2, 4 ... words.

    ``words`` has numbers from 0 whose last, and whose value at the end of each
    text, occurs once.  Only suffixes that still share a rank are sorted again.
    """
    order = np.argsort(words, kind="stable")
    rank = np.empty(len(words), dtype=np.int32)
    fresh = _changes(words[order])
    rank[order] = _group_starts(fresh, np.arange(len(words)))
    ranks, width = [rank], 1
    open_ = _shared(fresh)
    while len(open_):
        rank = rank.copy()
        suffixes = order[open_]
        key = rank[suffixes].astype(np.int64) * (len(words) + 1) + rank[suffixes + width]
        sort = np.argsort(key, kind="stable")
        order[open_] = suffixes = suffixes[sort]
        fresh = _changes(key[sort])
        rank[suffixes] = _group_starts(fresh, open_)
        ranks.append(rank)
        open_, width = open_[_shared(fresh)], 2 * width
    return order, ranks


def _changes(keys: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return fresh


def _group_starts(fresh: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For every element of sorted groups, the place of its group's first."""
    starts = np.flatnonzero(fresh)
    return np.repeat(places[starts], np.diff(np.append(starts, len(fresh))))


def _shared(fresh: np.ndarray) -> np.ndarray:
    """Elements whose group has more than one."""
    return np.flatnonzero(~(fresh & np.append(fresh[1:], True)))


def common_words(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix of the order shares with the one before it (the first: 0)."""
    common = np.zeros(len(order), dtype=np.int32)
    # From the widest ranks down: neighbours of equal rank share at least that many more words.
    for level in reversed(range(len(ranks))):
        near = np.flatnonzero(_equal_neighbours(order, ranks[0])) if level == len(ranks) - 1 else near
        first, second, done = order[near - 1], order[near], common[near]
        same = ranks[level][first + done] == ranks[level][second + done]
        common[near[same]] += np.int32(1 << level)
    return common


def _equal_neighbours(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    equal = np.zeros(len(order), dtype=bool)
    equal[1:] = rank[order[1:]] == rank[order[:-1]]
    return equal


def _reach(common: np.ndarray, places: np.ndarray, strict: bool) -> np.ndarray:
    """The first place behind each of ``places`` whose value is smaller (or, unless ``strict``, equal).

    The last value must be below all others.  Steps double while the least
    value of the stretch ahead is large enough, then halve again.
    """
    least = common[places] + np.int32(not strict)  # values from it on are passed over
    mins, at = [common], places + 1
    going, up = np.arange(len(places)), np.zeros(len(places), dtype=np.int8)
    level = 0
    while len(going):
        if level == len(mins):
            half = 1 << (level - 1)
            wide = np.full(len(common), -1, dtype=common.dtype)
            np.minimum(mins[-1][:-half], mins[-1][half:], out=wide[:-half])
            mins.append(wide)
        going = going[mins[level][at[going]] >= least[going]]
        at[going] += 1 << level
        level += 1
        up[going] = level
    for level in reversed(range(level)):
        down = np.flatnonzero(up > level)
        down = down[mins[level][at[down]] >= least[down]]
        at[down] += 1 << level
    return at


def branching_squares(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares whose next word breaks the period."""
    order, ranks = suffix_array(words)
    place = ranks[-1]
    # A value below all others at both ends stops the search for a node's ends.
    common = np.concatenate([[-1], common_words(order, ranks)[1:], [-1]]).astype(np.int32)
    inner = np.flatnonzero(common > 0)
    ends = len(common) - 1
    left, right = ends - _reach(common[::-1], ends - inner, False), _reach(common, inner, True)
    fewer_left = inner - left <= right - inner
    lo, hi = np.where(fewer_left, left, inner), np.where(fewer_left, inner, right)
    other_lo, other_hi = np.where(fewer_left, inner, left), np.where(fewer_left, right, inner)
    sizes = hi - lo
    node = np.repeat(np.arange(len(inner)), sizes)
    suffix = order[np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[node]]
    depth = common[inner][node]
    starts, periods = [], []
    for sign in (1, -1):
        partner = suffix + sign * depth
        at = place[np.maximum(partner, 0)]
        square = np.flatnonzero((partner >= 0) & (at >= other_lo[node]) & (at < other_hi[node]))
        starts.append(np.minimum(suffix, partner)[square])
        periods.append(depth[square])
    return np.concatenate(starts), np.concatenate(periods)


def _rotate(words: np.ndarray, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """How far each square can move to the left: the start of its run."""
    starts, moving, width = starts.copy(), np.arange(len(starts)), 4
    while len(moving):
        stopped = []
        for part in np.array_split(moving, max(1, len(moving) * width // CELLS)):
            at = starts[part][:, None] - np.arange(1, width + 1)
            there = np.maximum(at, 0)
            same = (at >= 0) & (words[there] == words[there + periods[part][:, None]])
            steps = np.where(same.all(1), width, same.argmin(1))
            starts[part] -= steps
            stopped.append(part[steps == width])
        moving, width = np.concatenate(stopped), min(2 * width, CELLS)
    return starts


def merged_runs(words: np.ndarray, starts: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of the runs that branching squares belong to.

    Of the squares with one end, that of the smallest period is rotated first.
    Squares of a multiple of its period that lie in its run say nothing new.
    """
    ends = starts + 2 * periods
    sort = np.lexsort((periods, ends))
    ends, periods = ends[sort], periods[sort]
    runs = []
    while len(ends):
        first = _changes(ends)
        start = _rotate(words, (ends - 2 * periods)[first], periods[first])
        runs.append((start, ends[first], periods[first]))
        group = np.cumsum(first) - 1
        inside = (periods % periods[first][group] == 0) & (ends - 2 * periods >= start[group])
        ends, periods = ends[~inside], periods[~inside]
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([empty, *column]).astype(np.int64) for column in zip(*runs)) if runs else (empty, empty, empty)


def runs_of_texts(texts: list[np.ndarray], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[np.ndarray]:
    """Per text, its runs as rows of start, length and period, by start and period.

    A text is an array of word numbers from 0.  A run is a longest stretch of a
    smallest period of which it holds at least ``least_periods``, of at least
    ``least_length`` words.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return [np.zeros((0, 3), dtype=np.int64) for _ in texts]
    # Numbers of a text begin where those of the one before end; the last is the text's end mark.
    used = np.array([t.max(initial=-1) + 2 for t in texts], dtype=np.int64)
    base, begins = np.cumsum(used) - used, np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(int(sizes.sum()) + len(texts), dtype=np.int64)
    for text, first, at, n in zip(texts, base, begins, used):
        words[at : at + len(text)] = text + first
        words[at + len(text)] = first + n - 1
    start, end, period = merged_runs(words, *branching_squares(words))
    long = end - start >= np.maximum(least_length, least_periods * period)
    start, end, period = start[long], end[long], period[long]
    sort = np.lexsort((period, start))
    start, end, period = start[sort], end[sort], period[sort]
    owner = np.searchsorted(begins, start, side="right") - 1
    found = np.stack([start - begins[owner], end - start, period], axis=1)
    return np.split(found, np.searchsorted(owner, np.arange(1, len(texts))))


def without_repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when every run is cut to its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words that stand at the ``n`` places of a text after a tail of one in ten texts is made periodic.

    Which texts, from where on and with which period follow from the id alone;
    None for the other texts, blank ones and those without an id.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def _numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 0."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)


def periodic_runs(docs: DataFrame, plant: bool = False, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` of every whole text.

    Words are maximal stretches without ASCII white space.  ``runs`` is an array
    of start (word number), length and period by start, then period;
    ``collapsed`` has, one blank apart, the words that no run holds after its
    first period.  ``plant`` first makes the tails of some texts periodic, see
    :func:`planted`.  Null and blank texts have no words, no runs and an empty
    collapsed text; ids may be null or repeat, every row gives a row, an empty
    table none; other columns play no part.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def done(names: list, texts: list[list[bytes]]) -> dict:
        found = runs_of_texts([_numbered(t) for t in texts], least_length, least_periods)
        collapsed = []
        for words, runs in zip(texts, found):
            if len(runs):
                words = [words[i] for i in np.flatnonzero(without_repeats(len(words), runs)).tolist()]
            collapsed.append(b" ".join(words).decode())
        return {"doc_id": names, "runs": [_rows_of(r) for r in found], "collapsed": collapsed}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        names, texts, held = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id"), batch.column("text")):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                places = planted(name.as_py(), len(words)) if plant else None
                if places is not None:
                    words = [words[i] for i in places.tolist()]
                if texts and held + len(words) > BATCH_WORDS:
                    yield done(names, texts)
                    names, texts, held = [], [], 0
                names.append(name.as_py())
                texts.append(words)
                held += len(words) + 1
        if texts:
            yield done(names, texts)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_stream(rows, work, f"doc_id {id_type}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _rows_of(runs: np.ndarray) -> list[dict]:
    return [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of runs, the longest one and hashes of the runs and of the collapsed text.

    The longest run is the first of greatest length, then of smallest period;
    its four columns are null where there is none.
    """
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
