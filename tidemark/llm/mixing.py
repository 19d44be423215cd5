"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidemark.llm.prefix import running_totals
from tidemark.llm.words import count_words
from tidemark.storage import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # times a source's own words
SEED = 17


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to one row per source with its ``source_size``.

    Sources in code point order (null last) weigh ``weights`` in turn.  The
    cap ``most * source_size`` binds for the sources with the smallest cap per
    weight, so the level at which the excess is shared out follows from
    running sums in that order: no rounds are needed.
    """
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    open_ = F.when(F.col("cap") / F.col("weight") > F.col("_level"), F.col("_level"))
    leveled = caps.withColumn("_level", level).withColumn("level", F.max(open_).over(whole))
    # Levels only fall after the first source that stays below its cap, so the largest is that one's.
    target = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def source_offset(source: str, seed: int = SEED) -> Column:
    """A number in [0, 1) that hangs on source and seed alone."""
    name = F.concat(F.lit(f"{seed}:"), F.col(source).isNull().cast("string"), F.lit(":"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, ties: Sequence[str] = ()) -> DataFrame:
    """How often the mix takes each row of ``doc_id, source, size``.

    Inside a source, rows stand in order of size and id; row i adds
    ``target / source_size`` expected copies to a running sum that starts at
    the source's offset, and is taken once per whole number crossed.  As sizes
    grow along the order, the words taken miss the target by at most the
    largest document.  Adds ``source_size, target, copies, taken``; every
    number follows from the rows and the seed, so reruns agree.  A source
    without words has target 0 and each of its rows is taken once, for 0 words.
    Null sources are one source; repeated rows are rows of their own; no rows
    give none.  ``ties``
    are more columns of ``rows``: they order those of equal size and id, and stay.
    """
    rows = written(rows.select("doc_id", "source", "size", *ties), "sizes")
    targets = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    placed = running_totals(rows, ["source"], ["size", "doc_id", *ties])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    offset = source_offset("source", seed)
    copies = F.floor(offset + each * (F.col("rank") + 1)) - F.floor(offset + each * F.col("rank"))
    named = targets.withColumnRenamed("source", "_source")
    joined = placed.join(named, placed["source"].eqNullSafe(named["_source"]))
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *ties
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``mix`` over documents whose size is the words of their text (null text: 0)."""
    return mix(docs.select("doc_id", "source", count_words("text").alias("size")), **options)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it.

    Rows that share id, source and size stand in the order of a hash of their
    texts.  Each row is written once with a key of its own, which goes through
    the mix in the place of the row, so no key has more than one row.  Null and
    blank texts have no words and come once where their source has none, else
    as often as their place in it says.  All columns stay, whatever they are
    called; an empty table stays empty.
    """
    text = F.xxhash64(F.col("text").isNull(), "text")
    numbered = docs.select(F.struct("*").alias("_row"), "doc_id", "source", count_words("text").alias("size"), text.alias("_text"), F.monotonically_increasing_id().alias("_key"))
    keyed = written(numbered, "keyed")
    taken = mix(keyed.drop("_row"), ties=("_text", "_key"), **options).filter("copies > 0").select("_key", "copies")
    copies = keyed.select("_row", "_key").join(taken, "_key")
    return copies.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
