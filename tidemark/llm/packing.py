"""Length buckets that waste the fewest padding tokens, and token-budget batches inside them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.prefix import running_totals
from tidemark.llm.words import count_words
from tidemark.storage import written

BUCKETS = 12
BUDGET = 8_192  # tokens of a padded batch


def bucket_boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int = BUCKETS) -> list[int]:
    """The at most ``buckets`` upper bounds with the least padding for this histogram.

    ``best[j]`` is the least padding of the ``j`` shortest distinct lengths in
    k buckets; the last bucket starts after length ``i``, and every document in
    it is padded to length ``j``.  Of equal splits the smallest ``i`` wins, of
    equal totals the fewest buckets.
    """
    if not len(lengths):
        return []
    order = np.argsort(np.asarray(lengths, dtype=np.int64), kind="stable")
    length = np.asarray(lengths, dtype=np.int64)[order]
    count = np.asarray(counts, dtype=np.int64)[order]
    n = np.concatenate([[0], np.cumsum(count)])
    s = np.concatenate([[0], np.cumsum(count * length)])
    size = len(length)
    best = np.concatenate([[0], length * n[1:] - s[1:]])
    layers, ends = [np.zeros(size + 1, dtype=np.int64)], [best[size]]
    for k in range(2, min(buckets, size) + 1):
        new, prev = np.zeros_like(best), np.zeros(size + 1, dtype=np.int64)
        for j in range(k, size + 1):
            i = np.arange(k - 1, j)
            cost = best[i] + length[j - 1] * (n[j] - n[i]) - (s[j] - s[i])
            at = int(np.argmin(cost))
            new[j], prev[j] = cost[at], i[at]
        best = new
        layers.append(prev)
        ends.append(best[size])
    k, j, bounds = int(np.argmin(ends)), size, []
    while k >= 0:
        bounds.append(int(length[j - 1]))
        j, k = int(layers[k][j]), k - 1
    return bounds[::-1]


def pack(rows: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Batches of rows ``doc_id, n_tokens`` (at least 1) under a token budget.

    The histogram covers all rows of up to ``budget`` tokens, so at most
    ``budget`` counts reach the driver.  A bucket's batches hold
    ``budget div bucket_len`` rows in id order, so a batch padded to
    ``bucket_len`` keeps the budget.  A row longer than the budget is a batch
    of its own, unpadded, in the bucket after the last: nothing is cut.
    Returns ``doc_id, n_tokens, bucket, bucket_len, batch, slot``, batches
    numbered from 0 in each bucket.  Null ids come first; repeated rows are
    packed one by one; an empty table gives no rows.
    """
    rows = written(rows.select("doc_id", "n_tokens"), "lengths")
    histogram = rows.filter(F.col("n_tokens") <= budget).groupBy("n_tokens").count().toPandas()
    bounds = bucket_boundaries(histogram["n_tokens"].to_numpy(), histogram["count"].to_numpy(), buckets)
    tokens = F.col("n_tokens")
    bucket = F.coalesce(*[F.when(tokens <= b, F.lit(i)) for i, b in enumerate(bounds)], F.lit(len(bounds)))
    bucket_len = F.coalesce(*[F.when(tokens <= b, F.lit(b).cast("long")) for b in bounds], tokens)
    placed = running_totals(rows.withColumns({"bucket": bucket, "bucket_len": bucket_len}), ["bucket"], ["doc_id", "n_tokens"])
    fit = F.expr(f"greatest(1, {budget} div bucket_len)")
    return placed.withColumn("_fit", fit).select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.expr("rank div _fit").alias("batch"),
        F.expr("cast(rank % _fit as int)").alias("slot"),
    )


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``pack`` over documents: a token per word of the text and one for its end (null text: the end alone)."""
    return pack(docs.select("doc_id", (count_words("text") + 1).alias("n_tokens")), buckets, budget)
