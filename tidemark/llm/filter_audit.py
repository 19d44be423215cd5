"""What each of a set of filters removes, in every order in which they may run.

A document is known by the mask of the filters that it fails.  The orders,
ranked as words in a dictionary, make all orders with a common beginning
neighbours, and the filter that removes a mask is settled by such a beginning:
filters that the mask passes, then one that it fails.  So a mask's removals at
one step are a few intervals of ranks.  The counts go in at both ends of each
interval, and running sums over the ranks give every order's figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidemark.llm.words import WORD
from tidemark.storage import written

LETTERS = "ABCDE"
LEAST_WORDS = 200
MOST_CAPITALS = 2  # per cent of the characters
LEAST_DISTINCT = 50  # per cent of the words
FIGURES = ("n", "good", "toxic")


def text_failures(text: str = "text") -> dict[str, Column]:
    """Failure of the filters that look at one text; a null text is empty."""
    text = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def lehmer_rank(order: str, letters: str = LETTERS) -> int:
    """The place, from 0, of ``order`` or of the first order that begins with it, among all orders of ``letters``."""
    left, rank = list(letters), 0
    for letter in order:
        rank += left.index(letter) * factorial(len(left) - 1)
        left.remove(letter)
    return rank


def removal_intervals(letters: str = LETTERS) -> Iterator[tuple[int, int, int, int]]:
    """``mask, step, lo, hi``: the mask's removal is at ``step`` (from 1) in the orders ranked ``lo`` to ``hi - 1``.

    Bit i of a mask stands for letter i.
    """
    for mask in range(1, 1 << len(letters)):
        failed = [c for i, c in enumerate(letters) if mask >> i & 1]
        passed = [c for c in letters if c not in failed]
        for ahead in range(len(passed) + 1):
            for begin in permutations(passed, ahead):
                for last in failed:
                    lo = lehmer_rank("".join(begin) + last, letters)
                    yield mask, ahead + 1, lo, lo + factorial(len(letters) - ahead - 1)


def _inline(spark, names: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table."""
    values = ", ".join(f"({', '.join(repr(v) for v in row)})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def mask_counts(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by source and by the filters that they fail.

    ``failures`` are the filters that look at a row; the last filter fails a
    text that some document of a smaller id has too.  Texts are compared by
    their SHA-256.  A null source is the empty string; a null id is smaller
    than none and greater than none; rows of equal text and id are rows of
    their own, none of which is a copy of the other; an id with several labels
    is good or toxic if any label says so.  Other columns play no part.

    The texts are read once and never shuffled.  Equal texts meet only as
    counts by source and label, so a text that fills the table is no hot group.
    """
    failures = failures or text_failures()
    mask = sum((F.coalesce(f, F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(failures.values())), F.lit(0))
    rows = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        mask.cast("int").alias("mask"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    rows = written(rows, "masks")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    no = F.lit(False)
    known = rows.filter("doc_id is not null").join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, no) for c in ("good", "toxic")})
    own = ["digest", "part", "mask", "good", "toxic"]
    each = known.groupBy("doc_id", *own).agg(F.count(F.lit(1)).alias("n"))
    # Per text, source and label: all documents, and those of the smallest id.
    classes = each.groupBy(*own).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    classes = classes.withColumn("firsts", F.when(first, F.col("n_least")).otherwise(0))
    copy = 1 << len(failures)
    either = [F.struct(F.col("firsts").alias("n"), F.col("mask")), F.struct((F.col("n") - F.col("firsts")).alias("n"), (F.col("mask") + copy).alias("mask"))]
    split = classes.select("part", "good", "toxic", F.explode(F.array(*either)).alias("e")).select("part", "good", "toxic", "e.*")
    nameless = rows.filter("doc_id is null").select("part", no.alias("good"), no.alias("toxic"), F.lit(1).cast("long").alias("n"), "mask")
    marked = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return split.union(nameless).filter("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), *marked)


def order_figures(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per ``part``, order of the filters and step: what :func:`mask_counts` says is kept, removed, and so on.

    ``counts`` has at most ``2 ** len(letters)`` rows per part, the result has
    ``len(letters)! * len(letters)``, zeros included.  No part, no rows.
    """
    spark, bits = counts.sparkSession, range(len(letters))
    counts = written(counts, "mask-counts")  # at most 32 rows a part, read several times
    intervals = _inline(spark, "mask, step, lo, hi", list(removal_intervals(letters)))
    ends = F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign"))))
    changes = counts.join(F.broadcast(intervals), "mask").select("part", "step", ends.alias("end"), *FIGURES)
    changes = changes.groupBy("part", "step", F.col("end.rank").alias("rank")).agg(*[F.sum(F.col(f) * F.col("end.sign")).alias(f) for f in FIGURES])

    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in bits]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in bits]
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])  # in the order of their ranks
    grid = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(len(letters)) - 1))))
    grid = grid.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))).withColumn("filter_order", F.element_at(orders, F.col("rank") + 1))
    grid = grid.withColumn("filter", F.instr(F.lit(letters), F.col("filter_order").substr(F.col("step"), F.lit(1))))

    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = grid.join(changes, ["part", "step", "rank"], "left").withColumns({f: F.coalesce(F.sum(f).over(along), F.lit(0)) for f in FIGURES})
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy("part", "filter"))
    return run.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - gone).alias("kept"),
        F.col("n").alias("removed"),
        (F.element_at("fails", F.col("filter")) - F.col("n")).alias("redundant"),
        F.element_at("alone", F.col("filter")).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        total.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The figures of the five filters for every source, all 120 orders and their steps."""
    return order_figures(mask_counts(docs, labels))
