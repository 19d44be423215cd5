"""Near duplicates from bottom-k sketches.

One hash function orders all shingles.  A text keeps its k smallest hashes, and
two texts of Jaccard similarity t agree on each of the k smallest of their
union with probability t, so they agree on at least ``agreeing(k, t)`` of them
but for a chance below 1e-8.  Inverted lists of the kept values find the pairs
that overlap, the union sketch drops those that do not agree enough, and the
full sets of those that remain are compared.

What keeps lists short and nothing lost:

* Texts with equal sets are one class; only one text of a class goes on.
* A pair that agrees on c of k values shares one of the k - c + 1 that are
  rarest over all texts, so only these are listed.
* A list of more than ``LONG`` texts (a passage in many documents, a large
  group of copies) is not used.  Texts that stand in one are listed again by
  their full sets, where the threshold itself bounds how many of the rarest
  shingles must be listed, and no chance is involved.
* In a list that is long even then, each text is compared with the one that
  has the fewest rare shingles.  Texts that this leaves in other components are
  compared with the list's texts if they can still reach the threshold: a pair
  that shares no rare shingle shares at most the common ones of either.
* Components are what is asked for, so pairs inside one are not compared again.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_sets
from tidemark.llm.tasks import ROWS, map_batches, map_stream
from tidemark.storage import dropped, written

WIDTH, PERCENT = 5, 80
SKETCH = 32
LONG = 32
LOST = 1e-8
HUB_PAIRS = 256  # pairs of one text that are compared in one piece


def agreeing(k: int, percent: int) -> int:
    """The most values of a union's k smallest that a pair at the threshold has in common but for a chance of ``LOST``."""
    t, tail = percent / 100, 0.0
    for c in range(k + 1):
        tail += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if tail > LOST:
            return max(1, c)
    return k


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """``doc_id, n, digest, sketch`` of whole texts; ``digest`` names the full set."""

    def work(batch):
        sets = shingle_sets(batch.column("text").to_pylist(), width)
        return {
            "doc_id": batch.column("doc_id"),
            "n": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            "sketch": [s[:k] for s in sets],
        }

    return map_batches(docs, work, "doc_id long, n long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``id, n, values``: the full set of each document."""

    def work(batch):
        sets = shingle_sets(batch.column("text").to_pylist(), width)
        return {"id": batch.column("doc_id"), "n": [len(s) for s in sets], "values": sets}

    return map_batches(docs, work, "id long, n long, values array<long>")


def lists(sets: DataFrame, needed: Column) -> DataFrame:
    """Inverted lists of ``id, n, values``: one row ``id, n, common, v, df, listed`` per value that another text has.

    ``listed`` marks the values that must be listed if partners agree on
    ``needed`` (of ``n``) of them; ``common`` counts the text's values in long
    lists.

    A text's values stay rows throughout.  Held in one row and made rows again,
    each would carry all others: memory by the square of a text's length.
    """
    rows = sets.select("id", "n", F.explode("values").alias("v"))
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # Dealt to a stated number of tasks: few bytes here become many rows below, which Spark would leave to few tasks.
    dealt = rows.join(counts, "v").repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    rarest_first = Window.partitionBy("id", "n").orderBy("df", "v")
    text = rarest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Of all values the rarest but ``needed - 1`` are listed; those that no other text has are the rarest and need no list.
    most = F.count(F.lit(1)).over(text) - needed + 1
    common = F.count(F.when(F.col("df") > LONG, 1)).over(text)
    return dealt.select("id", "n", common.alias("common"), "v", "df", (F.row_number().over(rarest_first) <= most).alias("listed"))


def near_size(a: str, b: str, percent: int) -> Column:
    """Whether two set sizes allow the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hub_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each text of a list with the list's text that has the largest share of common shingles."""
    share = F.struct((F.col("common") / F.col("n")).alias("share"), (-F.col("id")).alias("minus"), "id", "n")
    hubs = entries.groupBy("v").agg(F.max(share).alias("hub"))
    both = entries.join(hubs.select("v", F.col("hub.id").alias("b"), F.col("hub.n").alias("m")), "v")
    return ordered(both.filter((F.col("id") != F.col("b")) & near_size("n", "m", percent)).select(F.col("id").alias("a"), "b"))


def crossing_pairs(entries: DataFrame, percent: int, long: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of a list that lie in different components; at least one lies outside the list's largest.

    Texts of ``long`` lists share many of them; a pair is made in the first.
    Also gives the written table that the pairs come from.
    """
    if long:
        entries = entries.join(entries.groupBy("id").agg(F.collect_list("v").alias("held")), "id")
    else:
        entries = entries.withColumn("held", F.lit(None).cast("array<long>"))
    sizes = entries.groupBy("v", "component").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("v").agg(F.max(F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    split = written(entries.join(main.select("v", F.col("main.component").alias("main")), "v"), "lists")
    one = split.filter("component <> main").select("v", F.col("id").alias("a"), F.col("n").alias("n"), F.col("common").alias("h"), F.col("component").alias("c"), F.col("held").alias("held_a"))
    other = split.select("v", F.col("id").alias("b"), F.col("n").alias("m"), F.col("common").alias("g"), F.col("component").alias("d"), F.col("held").alias("held_b"), "main")
    # Two texts outside the largest component meet once.
    meet = (F.col("c") != F.col("d")) & ((F.col("d") == F.col("main")) | (F.col("a") < F.col("b"))) & near_size("n", "m", percent)
    if long:
        most = F.least("h", "g")
        meet = meet & (most * 100 >= (F.col("n") + F.col("m") - most) * percent)
        meet = meet & (F.array_min(F.array_intersect("held_a", "held_b")) == one["v"])
    return ordered(one.join(other, (one["v"] == other["v"]) & meet).select("a", "b")), split


def promising(pairs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose union sketch agrees often enough; sets no larger than the sketch are compared as they are."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.array_sort(F.array_union("s_a", "s_b"))
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    same = F.array_intersect("s_a", "s_b")
    agree = F.size(F.array_intersect(F.slice(union, 1, k), same))
    enough = F.when(whole, F.size(same) * 100 >= F.size(union) * percent).otherwise(agree >= agreeing(k, percent))
    return both.filter(enough).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets, made anew from the texts, reach the threshold.

    Of a pair, the text with more pairs is the hub.  A hub's pairs are dealt
    into pieces of ``HUB_PAIRS``; its text goes to each piece once, ahead of
    the others, so neither a task nor the copies of a text grow with a hub.
    """
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    degrees = written(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    side = lambda x: degrees.select(F.col("id").alias(x), F.col("degree").alias(f"d_{x}"))
    a_leads = (F.col("d_a") > F.col("d_b")) | ((F.col("d_a") == F.col("d_b")) & (F.col("a") < F.col("b")))
    hub, other = F.when(a_leads, F.col("a")).otherwise(F.col("b")), F.when(a_leads, F.col("b")).otherwise(F.col("a"))
    piece = F.pmod(F.xxhash64("id"), F.ceil(F.col("degree") / HUB_PAIRS))
    led = pairs.join(side("a"), "a").join(side("b"), "b").select(hub.alias("hub"), other.alias("id"), F.greatest("d_a", "d_b").alias("degree"))
    led = led.select("hub", piece.alias("piece"), F.lit(1).alias("place"), "id")
    heads = led.select("hub", "piece").distinct().select("hub", "piece", F.lit(0).alias("place"), F.col("hub").alias("id"))
    rows = heads.union(led).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    dealt = rows.repartition("hub", "piece").sortWithinPartitions("hub", "piece", "place")

    def work(batches):
        key, hubs = None, {}  # an id whose rows differ has several sets
        for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            found = {"a": [], "b": []}
            sets = shingle_sets(part.column("text").to_pylist(), width)
            for first, piece, place, other, own in zip(*(part.column(c).to_pylist() for c in ("hub", "piece", "place", "id")), sets):
                if key != (first, piece):
                    key, hubs = (first, piece), {}
                if place == 0:
                    hubs[own.tobytes()] = own
                elif any(_alike(known, own, percent) for known in hubs.values()):
                    found["a"].append(min(first, other))
                    found["b"].append(max(first, other))
            yield found

    links = written(map_stream(dealt.select("hub", "piece", "place", "id", "text"), work, "a long, b long").distinct(), "links")
    dropped(pairs, degrees)
    return links


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with the component of their text (its own id where it has no link)."""
    return entries.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, k: int = SKETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents under Jaccard similarity of word shingles, ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id, kept`` for every row.  Words
    are runs of anything but ASCII white space, ``A-Z`` lower-cased; a text of
    fewer than ``width`` words is one shingle; null and blank texts have an
    empty set and no links.  ``component_id`` is the smallest id reachable.
    Rows of one id count as one document.  A row without an id stands alone
    (``component_id`` null, ``kept`` true).  An empty table gives no rows.
    Other columns play no part.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = written(sketches(docs, width, k), "sketches")
    classes = features.filter("n > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    reps = written(classes, "classes")

    # A set no larger than the sketch is kept whole; a larger partner's sketch may lack some of it.
    n = F.col("n")
    cut = F.greatest(F.lit(0), F.floor(n * 100 / percent) - k)
    whole = F.greatest(F.lit(1), F.ceil(n * percent / 100) - cut)
    first = written(lists(reps.select("id", "n", F.col("sketch").alias("values")), F.when(n <= k, whole).otherwise(F.lit(agreeing(k, percent)))), "lists")
    short = first.filter(f"listed and df <= {LONG}")
    # From here on only texts that share a listed value are read.
    listed = first.filter("listed").groupBy("id").agg((F.max("df") > LONG).alias("again"))
    named = written(docs.join(listed.withColumnRenamed("id", "doc_id"), "doc_id"), "texts")
    second = written(lists(full_sets(named.filter("again").select("doc_id", "text"), width), F.ceil(n * percent / 100)), "lists")
    long = second.filter(f"listed and df > {LONG}")
    dense = long.select("id").distinct()
    # Texts of long lists meet by any rare shingle: the bound in crossing_pairs counts on it.
    rare = second.filter(f"df <= {LONG}")
    short_again = rare.filter("listed").union(rare.filter("not listed").join(dense, "id", "left_semi"))
    short = written(short.union(short_again.select(short.columns)), "lists")

    pairs = ordered(hub_pairs(short, percent).union(hub_pairs(long, percent)))
    links = confirmed(promising(pairs, reps, percent, k), named, width, percent)
    labels, early = components(links)
    (few, split), (many, split_long) = (crossing_pairs(labelled(rows, labels), percent, long=rows is long) for rows in (short, long))
    more_links = confirmed(promising(ordered(few.union(many)), reps, percent, k), named, width, percent)

    # An id whose rows have different sets ties their classes together.
    twice = features.filter("doc_id is not null").groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("differ")).filter("differ")
    ties = features.join(twice, "doc_id", "left_semi").join(reps.select("digest", "id"), "digest")
    ties = ties.filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    labels, _ = components(links.union(more_links).union(ties))
    dropped(first, named, second, short, early, split, split_long, links, more_links)

    found = features.select("doc_id", "n", "digest").join(reps.select("digest", "id"), "digest", "left")
    joined = found.withColumn("id", F.coalesce("id", "doc_id")).join(labels, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest id, of rows of that id the first in text order.

    Rows without an id or without words stay; of equal rows of one id one stays.
    An empty table stays empty.
    """
    kept = near_duplicates(docs, **options).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("_n"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    joined = rows.join(kept.withColumnRenamed("doc_id", "_id"), "_id")
    first = F.row_number().over(Window.partitionBy("_id").orderBy(F.col("_row.text").asc_nulls_last()))
    chosen = joined.withColumn("_first", first).filter("_first = 1 or _n = 0")
    return chosen.select("_row.*").union(docs.filter("doc_id is null"))
