"""Contiguous shards of near-equal bytes, from global prefix sums of sizes.

Native: DataFrame and SQL functions only.  The rows that move are (doc_id, size, checksum), never texts.

1. The small rows are dealt by ranges of (doc_id, size, checksum), so that rows of one doc_id can be split, into more pieces
   than tasks and written once, each with the number of its piece, so that later passes see the same pieces even after executors
   are lost.
2. Per-piece totals, one row a piece, get their prefix sums; their number is bounded by ``pieces``.
3. Inside a piece, running sums start from the piece's base; a row belongs to the shard in whose equal share of all bytes
   the middle of the row lies.
4. Shards and global positions are written; where each shard starts is one row a shard, and slots count from there.

Defined results: a null text weighs ``overhead``; a null doc_id sorts first; rows with equal doc_id stand side by side in
the order of size and checksum; an empty table gives no rows.  ``sizes near equal``: a shard's bytes differ from the mean
by at most the largest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import documents, partitions
from attesta.scratch import written

#: Bytes that a row weighs beyond its text.
OVERHEAD = 16


def sized(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )


def balanced_shards(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD, pieces: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards 0..shards - 1 in the order of doc_id, slots without gaps from 0."""
    spark = docs.sparkSession
    pieces = pieces or 4 * partitions(spark)
    order = ["doc_id", "size", "text_crc32"]
    dealt = written(sized(docs, overhead).repartitionByRange(pieces, *order).withColumn("piece", F.spark_partition_id()), "sizes")

    totals = dealt.groupBy("piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "piece",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    running = Window.partitionBy("piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.select("piece", *order, F.coalesce(F.sum("size").over(running), F.lit(0)).alias("bytes_before"), F.coalesce(F.count(F.lit(1)).over(running), F.lit(0)).alias("rows_before"))
        .join(F.broadcast(bases), "piece")  # one row a piece
        .select(
            *order,
            (F.col("base_rows") + F.col("rows_before")).alias("position"),
            # floor((prefix + size / 2) * shards / total) in whole numbers
            F.least(
                F.lit(shards - 1),
                F.expr(f"cast(floor((2 * (base_bytes + bytes_before) + size) * {shards}BD / (2BD * all_bytes)) as int)"),
            ).alias("shard"),
        )
    )
    placed = written(placed, "positions")
    firsts = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(*order, "shard", (F.col("position") - F.col("first")).alias("slot"))


def op5_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents in one of 40 contiguous shards of near-equal bytes (law ``bytes``)."""
    return balanced_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
