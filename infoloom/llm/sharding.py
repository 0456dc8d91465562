"""Contiguous byte-balanced sharding from global prefix sums (operator 5, native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, parallelism


def prefix_sums(keys: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add ``row_no`` (0-based global rank) and ``bytes_before`` (global exclusive byte prefix sum).

    The rows are range-partitioned by ``order`` plus a tie-breaker, so equal keys, even a third
    of all rows, spread over partitions. Each partition's totals, one row a partition, give
    the partition's offsets; ranks and sums inside a partition come from a window over that partition alone.
    ``keys`` must hold slim rows only: they are written to the checkpoint folder once, since
    range bounds are sampled and may not be drawn twice.
    """
    n = parallelism(keys.sparkSession)
    tied = keys.withColumn("_tie", F.monotonically_increasing_id())
    placed = checkpointed(
        tied.repartitionByRange(n, *order, "_tie").withColumn("_part", F.spark_partition_id())
    )
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_b"), F.count(F.lit(1)).alias("_n"))
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_b").over(upto), F.lit(0)).alias("_b0"),
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"),
    )
    inside = W.partitionBy("_part").orderBy(*order, "_tie")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.withColumn("_r", F.row_number().over(inside) - 1).withColumn(
        "_c", F.coalesce(F.sum(size).over(before), F.lit(0))
    )
    # one row a partition: the size of this side is the number of partitions, not of rows
    return (
        ranked.join(F.broadcast(offsets), "_part")
        .withColumn("row_no", (F.col("_n0") + F.col("_r")).cast("long"))
        .withColumn("bytes_before", (F.col("_b0") + F.col("_c")).cast("long"))
        .drop("_part", "_tie", "_r", "_c", "_b0", "_n0")
    )


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cut the documents, in id order, into ``n_shards`` contiguous shards of near equal bytes.

    Returns ``doc_id, size, text_crc32, shard, slot``. A row's size is its UTF-8 bytes plus 1;
    a null text counts as empty. A row belongs to the shard in which the middle of its bytes
    falls, so a shard misses its target by half a document at most at either cut. Null ids sort
    first; repeated ids and repeated rows are ordered by checksum and size and keep one row
    each. An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    ranked = prefix_sums(slim, ["doc_id", "text_crc32", "size"], "size")
    total = ranked.agg(F.sum("size").alias("_total"))
    middle = F.col("bytes_before") * 2 + F.col("size")
    cut = ranked.join(F.broadcast(total)).withColumn(
        "shard",
        F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / (F.col("_total") * 2))).cast("int"),
    )
    first = cut.groupBy("shard").agg(F.min("row_no").alias("_first"))  # n_shards rows
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_no") - F.col("_first")).alias("slot")
    )
