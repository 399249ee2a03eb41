"""Byte-balanced contiguous shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staging import staged

#: Rows that one range of the global order holds, about; a range is one window partition.
RANGE_ROWS = 500_000


def byte_balanced_shards(docs: DataFrame, n_shards: int = 8, min_ranges: int = 48, max_ranges: int = 4096) -> DataFrame:
    """Cut the documents, in order of ``doc_id``, into contiguous shards of near-equal bytes.

    The order is range-partitioned once over narrow rows (id, size, checksum; never the text). Each range
    gives one row of totals; their prefix sums give every range its global byte and row offset, and a
    running sum inside the range gives each document its global byte interval. A document belongs to
    the shard whose target interval holds its middle byte, so a shard misses its target by at
    most the longest document.

    Null text: no bytes, size 1, checksum 0. Null ``doc_id`` comes first. Repeated rows are kept, each with its
    own slot. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    n = min(max_ranges, max(min_ranges, docs.select("doc_id").count() // RANGE_ROWS))
    ranged = staged(rows.repartitionByRange(n, "doc_id", "text_crc32", "size").withColumn("_range", F.spark_partition_id()), "shard-ranges")

    # at most max_ranges rows, whatever the input
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select("_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"), F.sum("_bytes").over(everything).alias("_total"))

    inside = W.partitionBy("_range").orderBy("doc_id", "text_crc32", "size")
    target = F.ceil(F.col("_total") / n_shards)
    placed = (
        ranged.withColumns({"_end": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)), "_rn": F.row_number().over(inside)})
        .join(F.broadcast(offsets), "_range")
        .withColumn("_mid", F.col("_byte0") + F.col("_end") - F.ceil(F.col("size") / 2))
        .select("doc_id", "size", "text_crc32", F.least(F.floor(F.col("_mid") / target), F.lit(n_shards - 1)).cast("int").alias("shard"), (F.col("_row0") + F.col("_rn") - 1).alias("_global"))
    )
    placed = staged(placed, "shard-placed")
    first = placed.groupBy("shard").agg(F.min("_global").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_global") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)


#: The checksum is folded over the bytes with the usual table of the reflected polynomial 0xEDB88320.
ORACLE = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0,0,0,0,0,0,0,0]::UBIGINT[]),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c
    FROM range(256) r(i))),
base AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS txt FROM documents),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS e, sum(size) OVER () AS total FROM base),
cut AS (
  SELECT *, least(floor((e - ceil(size / 2)) / ceil(total / 8)), 7)::INT AS shard FROM summed)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(regexp_extract_all(hex(encode(txt)), '..'), lambda h: ('0x' || h)::UBIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32,
  'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot,
  NULL::INT AS grown_shard
FROM cut, tab
"""
