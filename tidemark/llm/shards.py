"""Contiguous shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.prefix import running_totals
from tidemark.storage import written

SHARDS = 8


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all documents, in ascending id order, to ``shards`` contiguous shards of near equal bytes.

    A document's size is the UTF-8 bytes of its text plus one (a null text has
    none).  Sizes are summed over the whole order from per-partition totals,
    and a document goes to the shard in whose equal share of the total its
    first byte lies, so a shard is off its share by less than one document.
    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; slots
    count from 0 in each shard.  Equal ids are ordered by checksum and size;
    null ids come first; repeated rows keep a slot each; other columns play no
    part; an empty table gives no rows.  A shard is empty only if a single
    document covers its whole share.
    """
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        ),
        "sizes",
    )
    placed = running_totals(rows, [], ["doc_id", "text_crc32", "size"], ["size"])
    placed = placed.withColumn("shard", F.expr(f"cast(before_size * {shards} div total_size as int)"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # at most one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as one folder per shard, rows in id order inside a file.

    Documents are matched to their shard by id, so ids must be unique here.
    """
    placed = balanced_shards(docs, shards, id_col, text_col).select(F.col("doc_id").alias(id_col), "shard")
    rows = docs.join(placed, id_col).repartitionByRange("shard", id_col).sortWithinPartitions("shard", id_col)
    rows.write.partitionBy("shard").parquet(path)
