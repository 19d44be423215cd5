"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.storage import dropped, written


def components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, component`` (the smallest id reached) for every id in edges ``a, b``, and the written table that holds them.

    Each round every id takes the smallest label among its neighbours, then the
    label of its label, so a chain shortens by half a round.  Rounds go on
    until no label changes; each is a table in the shared folder, and the one
    before it goes.  A hub's neighbours are reduced before the shuffle.  No
    edges, no rows.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    held = labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        own = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        jump = labels.select(F.col("id").alias("step"), F.col("component").alias("jump"))
        new = written(own.join(jump, "step").select("id", "old", F.least("step", "jump").alias("component")), "labels")
        dropped(held)
        held, labels = new, new.select("id", "component")
        if not new.filter("component <> old").limit(1).count():
            dropped(both)
            return labels, new
