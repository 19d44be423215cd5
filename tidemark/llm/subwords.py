"""A linear softmax over averaged subword vectors, trained in numpy."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Sequence

import numpy as np

BUCKETS = 1 << 17
SIZES = (3, 4, 5)  # characters of an n-gram
DIMENSIONS = 4
ROUNDS = 60
RATE = 0.3
FIRM, FIRMEST = 0.02, 1e-5  # weight of the squared vectors in the loss: FIRM over the rows, FIRMEST at most
SEED = 5
BALANCE = 0.5  # 1: both classes weigh the same; 0: each row does
LEAST_TEXTS = 3  # fitted texts, of either class, that a subword must be in
MOST_SHARE = 0.4  # of the fitted texts of each class
MAX_CACHED = 300_000
PAIRS = 1 << 18  # pairs of owner and row that are summed together
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bag(text: str | None) -> Counter:
    """Lower-case words of a whole text with their counts."""
    return Counter((text or "").lower().split())


def subwords(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and where each word's begin.

    A word without its outer punctuation, framed by marks, has its n-grams and
    itself as subwords.  Buckets come from the characters alone, so a word
    never seen shares those of the n-grams that it has in common with others.
    """
    framed = [f"<{w.strip(string.punctuation) or w}>" for w in words]
    codes = np.frombuffer("".join(framed).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(w) for w in framed])
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    owner = np.repeat(np.arange(len(framed)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    powers = np.cumprod(np.full(max(1, lengths.max(initial=1)), _MULTIPLIER, dtype=np.uint64))
    owners, hashes = [np.arange(len(framed))], [np.add.reduceat(codes * powers[place], starts)]
    for n in SIZES:
        gram = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
        for k in range(n):
            gram += codes[k : k + len(gram)] * powers[k] if k < len(powers) else np.uint64(0)
        whole = owner[: len(gram)] == owner[n - 1 :] if len(gram) else np.zeros(0, dtype=bool)
        owners.append(owner[: len(gram)][whole])
        hashes.append(gram[whole] + np.uint64(n))
    owners, hashes = np.concatenate(owners), np.concatenate(hashes)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * _MULTIPLIER
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(framed))
    return ((hashes >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int32)[order], np.concatenate([[0], np.cumsum(counts)])[:-1]


class _Sums:
    """Weighted sums of rows by owner, and the same backwards; both orders are sorted once.

    A weight belongs to a pair (``weights``) or to an owner (``scale``).  Sums
    are taken some owners at a time, so no more than ``PAIRS`` rows (or the
    rows of one owner) are laid out together.
    """

    def __init__(self, owners: np.ndarray, rows: np.ndarray, n_owners: int, n_rows: int, weights: np.ndarray | None = None, scale: np.ndarray | None = None):
        self.shape, self.scale = (n_owners, n_rows), None if scale is None else scale[:, None]
        self.forward = self._plan(owners, rows, weights)
        self.backward = self._plan(rows, owners, weights)

    @staticmethod
    def _plan(to, of, weights):
        if (to[1:] < to[:-1]).any():
            order = np.argsort(to, kind="stable").astype(np.int32)
            to, of, weights = to[order], of[order], None if weights is None else weights[order]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, dtype=int)
        ends = np.append(starts[1:], len(to))
        pieces, first = [], 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + PAIRS, side="right")))
            pieces.append((first, last, int(starts[first]), int(ends[last - 1])))
            first = last
        return to[starts], starts, pieces, of, None if weights is None else weights[:, None]

    @staticmethod
    def _apply(plan, values, n):
        to, starts, pieces, of, weights = plan
        out = np.zeros((n, values.shape[1]), dtype=np.float32)
        for first, last, lo, hi in pieces:
            part = values.take(of[lo:hi], axis=0)
            if weights is not None:
                part *= weights[lo:hi]
            out[to[first:last]] = np.add.reduceat(part, starts[first:last] - lo)
        return out

    def up(self, values):
        out = self._apply(self.forward, values, self.shape[0])
        return out if self.scale is None else out * self.scale

    def down(self, values):
        return self._apply(self.backward, values if self.scale is None else values * self.scale, self.shape[1])


class SubwordSoftmax:
    """Subword vectors averaged over a text's words, then a two-class softmax; vectors and softmax are trained together."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, fitted: bool = True):
        self.fitted = fitted
        self.vectors, self.weights, self.bias = vectors, weights, bias
        # The score's margin is linear in the average, so each subword adds one number.
        self.margins = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float64)
        self.shift = float(bias[1] - bias[0])
        self.words: dict[str, float] = {}

    @classmethod
    def fit(cls, texts: Sequence[str], labels: Sequence[int], rounds: int = ROUNDS) -> "SubwordSoftmax":
        """Train on whole texts.  Without rows every score is one half."""
        rng = np.random.default_rng(SEED)
        vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        weights = rng.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32)
        bias = np.zeros(2, dtype=np.float32)
        labels = np.asarray(labels, dtype=np.int64)
        if not len(labels):
            return cls(vectors * 0, weights, bias, fitted=False)
        words: dict[str, int] = {}
        inside, share, sizes = [], [], []
        for text in texts:
            counts = bag(text)
            inside.append(np.array([words.setdefault(w, len(words)) for w in counts], dtype=np.int32))
            share.append(np.array([*counts.values()], dtype=np.float32) / max(1, counts.total()))
            sizes.append(len(counts))
        by_word, used = cls._known_subwords(list(words), inside, labels)
        owner, inside, share = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.concatenate(inside), np.concatenate(share)
        by_text = _Sums(owner, inside, len(sizes), len(words), weights=share)
        truth = np.eye(2, dtype=np.float32)[labels]
        balance = (truth / np.maximum(truth.sum(0), 1) ** BALANCE).sum(1, keepdims=True)
        balance /= balance.sum()
        firm = min(FIRMEST, FIRM / len(labels))
        params = [vectors[used], weights, bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, rounds + 1):
            text = by_text.up(by_word.up(params[0]))
            logits = text @ params[1] + params[2]
            logits -= logits.max(1, keepdims=True)
            chance = np.exp(logits)
            wrong = (chance / chance.sum(1, keepdims=True) - truth) * balance
            slopes = [
                by_word.down(by_text.down(wrong @ params[1].T)) + firm * params[0],
                text.T @ wrong,
                wrong.sum(0),
            ]
            for i, (p, g, (m, v)) in enumerate(zip(params, slopes, moments)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[i] = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        vectors[:] = 0
        vectors[used] = params[0]
        return cls(vectors, params[1], params[2])

    @staticmethod
    def _known_subwords(words: list[str], texts: list[np.ndarray], labels: np.ndarray) -> tuple[_Sums, np.ndarray]:
        """Averages of subword vectors by word, over subwords that are neither rare nor everywhere, and their buckets.

        A subword of one or two texts says more about these texts than about
        the class, one of most texts of both classes says nothing; their
        vectors stay zero.  The first is a number of texts and the second a
        share inside each class, so that many texts of one class never hide
        the words of a few of the other.
        """
        parts = [subwords(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
        counts = np.concatenate([np.zeros(0, dtype=np.int64), *[np.diff(np.append(starts, len(found))) for found, starts in parts]])
        buckets = np.concatenate([np.zeros(0, dtype=np.int32), *[found for found, _ in parts]])
        of_word = np.split(buckets, np.cumsum(counts)[:-1]) if len(words) else []
        texts_with = np.zeros((2, BUCKETS), dtype=np.int64)
        for own, label in zip(texts, labels):
            if len(own):
                texts_with[label, np.unique(np.concatenate([of_word[w] for w in own]))] += 1
        del of_word, parts
        everywhere = (texts_with > MOST_SHARE * np.bincount(labels, minlength=2)[:, None]).all(0)
        number = np.cumsum((texts_with.sum(0) >= LEAST_TEXTS) & ~everywhere, dtype=np.int32)
        used = np.flatnonzero(np.diff(number, prepend=np.int32(0)))
        known = np.isin(np.arange(BUCKETS), used)[buckets]
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), counts)[known]
        found = number[buckets[known]] - np.int32(1)
        del buckets, known
        return _Sums(word_of, found, len(words), len(used), scale=(1 / np.maximum(counts, 1)).astype(np.float32)), used

    def score(self, text: str | None) -> float:
        """Chance of class 1; a text without words gets that of the bias alone."""
        counts = bag(text)
        new = [w for w in counts if w not in self.words]
        if new:
            if len(self.words) > MAX_CACHED:
                self.words.clear()
                new = list(counts)
            buckets, starts = subwords(new)
            sums = np.add.reduceat(self.margins[buckets], starts) / np.diff(np.append(starts, len(buckets)))
            self.words.update(zip(new, sums.tolist()))
        n = counts.total()
        margin = self.shift + (sum(c * self.words[w] for w, c in counts.items()) / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))
