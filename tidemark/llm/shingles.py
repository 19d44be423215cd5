"""Word shingles of whole texts as sorted arrays of 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

CHUNK = 1 << 20  # bytes hashed together; a longer text is a chunk of its own
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, UNBASE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(coded: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bytes of every word of these texts in order, ``A-Z`` lower-cased, and words per text.

    Words are runs of anything but ASCII white space.  A word's hash is a
    polynomial in its bytes, taken from running sums over the joined texts.
    """
    joined = np.frombuffer(b"\n".join([b"", *coded, b""]), dtype=np.uint8)
    up, down = _power_tables(len(joined) + 1)
    space = _SPACE[joined]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]  # the text begins and ends with white space
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_LOWER[joined] * up[: len(joined)], dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    borders = np.cumsum([1, *[len(c) + 1 for c in coded]])
    return hashes, ends - starts, np.diff(np.searchsorted(starts, borders))


def _chunk_sets(coded: Sequence[bytes], width: int) -> list[np.ndarray]:
    words, _, counts = word_hashes(coded)
    spread = mix(np.arange(1, width + 2, dtype=np.uint64) * BASE) | np.uint64(1)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * spread[k]
    rolled = mix(rolled).view(np.int64)
    sets, at = [], 0
    for count in counts.tolist():
        if count >= width:
            own = np.unique(rolled[at : at + count - width + 1])
        elif count:  # fewer words: the whole sequence is one shingle
            parts = np.append(words[at : at + count] * spread[:count], spread[width:] * np.array([count], dtype=np.uint64))
            own = mix(parts.sum(keepdims=True)).view(np.int64)
        else:
            own = np.zeros(0, dtype=np.int64)
        sets.append(own)
        at += count
    return sets


def shingle_sets(texts: Sequence[str | None], width: int) -> list[np.ndarray]:
    """The set of distinct ``width``-word shingles of each text; null and blank texts have none."""
    sets, held, size = [], [], 0
    for text in texts:
        coded = (text or "").encode()
        if held and size + len(coded) > CHUNK:
            sets += _chunk_sets(held, width)
            held, size = [], 0
        held.append(coded)
        size += len(coded)
    return sets + (_chunk_sets(held, width) if held else [])
