"""Exact top-k search by integer inner product over a bit-sliced index.

A block of rows keeps, for every attribute, bitmaps of the leading bits of its
values.  A query's score is approximated by adding these slices, each shifted
by the query's weights, with bitmap arithmetic; no row is visited.  From the
most significant slice of the sum downward the k-th largest sum is found, then
all rows that the rounding could still lift above it; these few are resolved
with the exact values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidemark.llm.tasks import map_stream
from tidemark.storage import written

K = 10
SCALE = 1_024
SLICES = 6  # leading bits kept per attribute
WEIGHT_BITS = 10  # leading bits of a query's weights that are added
BLOCK = 8_192  # rows of an index block
QUERY_BLOCK = 256


class SlicedBlock:
    """Slices, and the exact integers, of a block of rows."""

    def __init__(self, values: np.ndarray, slices: int = SLICES):
        self.values = values.astype(np.int64)
        n, d = self.values.shape
        self.low = int(self.values.min())
        span = int(self.values.max()) - self.low
        self.shift, self.bits = max(0, span.bit_length() - slices), slices
        coarse = (self.values - self.low) >> self.shift
        self.top = int(coarse.max())
        width = -(-n // 64)
        self.rows = self._bitmap(np.ones(n, dtype=bool), width)
        maps = np.stack([self._bitmap((coarse[:, k] >> b) & 1, width) for k in range(d) for b in range(slices)])
        # Attribute k's slice b is row k * slices + b; its complement lies d * slices further.
        self.maps = np.concatenate([maps, ~maps & self.rows])

    @staticmethod
    def _bitmap(flags: np.ndarray, width: int) -> np.ndarray:
        packed = np.zeros(width * 8, dtype=np.uint8)
        bits = np.packbits(np.asarray(flags, dtype=bool), bitorder="little")
        packed[: len(bits)] = bits
        return packed.view(np.uint64)

    def _columns(self, weights: np.ndarray) -> list[np.ndarray]:
        """For each power of two, the bitmaps to add there.

        A weight is written with digits 1 and -1, no two of them adjacent; a
        negative digit adds the complement.
        """
        size = np.abs(weights).astype(np.int64)
        half = size >> 1
        triple = size + half
        ones = np.where(weights > 0, triple & (triple ^ half), half & (triple ^ half))
        minus = np.where(weights > 0, half & (triple ^ half), triple & (triple ^ half))
        last = len(self.maps) // 2
        digits = int(triple.max()).bit_length() if len(size) else 0
        at = [
            np.concatenate([np.flatnonzero(ones >> j & 1) * self.bits, last + np.flatnonzero(minus >> j & 1) * self.bits]) for j in range(digits)
        ]
        return [
            np.concatenate([np.zeros(0, dtype=np.int64), *[at[c - b] + b for b in range(self.bits) if 0 <= c - b < digits]])
            for c in range(digits + self.bits)
        ]

    def weighted_sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum of all attributes times weights, complements in place of negative terms."""
        out, carried = [], []
        columns = self._columns(weights)
        while columns or carried:
            chosen = self.maps[columns.pop(0)] if columns else np.zeros((0, len(self.rows)), dtype=np.uint64)
            stack, carried = np.concatenate([chosen, *carried]), []
            while len(stack) > 2:
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                odd = a ^ b
                carried.append((a & b) | (odd & c))
                stack = np.concatenate([odd ^ c, stack[3 * third :]])
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros_like(self.rows))
        return out

    @staticmethod
    def kth_largest(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
        """The k-th largest sum among ``rows``, found slice by slice from the top; 0 if there are fewer."""
        value, open_ = 0, rows
        for i in range(len(slices) - 1, -1, -1):
            upper = open_ & slices[i]
            n = int(np.bitwise_count(upper).sum())
            if n >= k:
                value, open_ = value | 1 << i, upper
            else:
                k, open_ = k - n, open_ & ~slices[i]
        return value if int(np.bitwise_count(open_).sum()) >= k else 0

    @staticmethod
    def at_least(slices: list[np.ndarray], rows: np.ndarray, bound: int) -> np.ndarray:
        """Rows whose sum is ``bound`` or more."""
        if bound <= 0:
            return rows
        if bound >> len(slices):
            return np.zeros_like(rows)
        above, equal = np.zeros_like(rows), rows
        for i in range(len(slices) - 1, -1, -1):
            if bound >> i & 1:
                equal = equal & slices[i]
            else:
                above, equal = above | (equal & slices[i]), equal & ~slices[i]
        return above | equal

    def search(self, query: np.ndarray, k: int, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of all rows but ``without`` that can be among the ``k`` best."""
        query = query.astype(np.int64)
        rows = self.rows.copy()
        for i in without.tolist():
            rows[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        cut = max(0, int(np.abs(query).max(initial=0)).bit_length() - WEIGHT_BITS)
        weights = (query + (1 << cut >> 1)) >> cut
        rest = query - (weights << cut)
        # What is left out: the weights' rest times the slices, and the values' rest times the query.
        width = (self.top << self.shift) * int(np.abs(rest).sum()) + ((1 << self.shift) - 1) * int(np.abs(query).sum())
        sums = self.weighted_sum(weights)
        bound = self.kth_largest(sums, rows, k) - -(-width >> (self.shift + cut)) - 1
        places = np.flatnonzero(np.unpackbits(self.at_least(sums, rows, bound).view(np.uint8), bitorder="little"))
        return places, self.values[places] @ query


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, ints``: floor(scale * x) of every component; rows without an id or with a null or non-finite component are left out."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ints = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).filter(finite)
    return usable.select(F.col(id_col).cast("long").alias("id"), ints.cast("array<long>").alias("ints"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of equal width packed to blocks ``n, ids, ints`` of at most ``size`` rows."""

    def work(batches):
        held: dict[int, tuple[list, list]] = {}

        def block(d):
            ids, ints = held.pop(d)
            return {"n": [len(ids)], "ids": [np.array(ids, "<i8").tobytes()], "ints": [np.array(ints, "<i8").tobytes()]}

        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column("ints").to_pylist()):
                ids, ints = held.setdefault(len(x), ([], []))
                ids.append(i)
                ints.append(x)
                if len(ids) == size:
                    yield block(len(x))
        for d in list(held):
            yield block(d)

    return map_stream(rows, work, "n int, ids binary, ints binary")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def top_k(vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best rows for every row that ``queries`` selects, by integer inner product.

    ``queries`` is a condition on ``id``.  Every block of queries meets every
    block of the index; a task keeps k rows per query, and these are ranked
    over all tasks.  A query's candidates are all rows of its width but those
    of its own id; repeated rows are candidates of their own, repeated query
    ids count once (the smallest vector).  Ties go to the smaller id.  Vectors
    that are null, empty or hold a null or non-finite component and rows without
    an id take no part; an empty table gives no rows.  Returns ``query_id, rank,
    vec_id, score``.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    index = written(blocks(rows, BLOCK), "index")
    asked = rows.filter(queries).groupBy("id").agg(F.min("ints").alias("ints"))
    asked = written(blocks(asked, QUERY_BLOCK), "queries").toDF("m", "query_ids", "query_ints")

    def work(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        last, block, ids = None, None, None

        def flush():
            out = {
                "query_id": np.repeat(np.array([*best], dtype=np.int64), [len(s) for s, _ in best.values()]),
                "vec_id": np.concatenate([np.zeros(0, dtype=np.int64), *[i for _, i in best.values()]]),
                "score": np.concatenate([np.zeros(0, dtype=np.int64), *[s for s, _ in best.values()]]),
            }
            best.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                values = np.frombuffer(row["ints"], "<i8").reshape(row["n"], -1)
                asked = np.frombuffer(row["query_ints"], "<i8").reshape(row["m"], -1)
                if values.shape[1] != asked.shape[1]:
                    continue
                if row["ids"] != last:
                    last, block, ids = row["ids"], SlicedBlock(values), np.frombuffer(row["ids"], "<i8")
                for query_id, query in zip(np.frombuffer(row["query_ids"], "<i8").tolist(), asked):
                    places, scores = block.search(query, k, np.flatnonzero(ids == query_id))
                    found = ids[places]
                    if query_id in best:
                        scores, found = np.concatenate([best[query_id][0], scores]), np.concatenate([best[query_id][1], found])
                    keep = best_of(scores, found, k)
                    best[query_id] = scores[keep], found[keep]
            if len(best) > 64 * QUERY_BLOCK:
                yield flush()
        yield flush()

    # Blocks meet blocks: the query set is stated, and each pair is one unit of work.
    found = map_stream(index.crossJoin(asked), work, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
