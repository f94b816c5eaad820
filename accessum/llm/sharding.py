"""Contiguous shards of nearly equal bytes from global prefix sums.

Documents in id order are dealt to ranges; each range's total gives the sum ahead of it, a running sum within the range
gives each document its place on the byte line, and the line is cut at equal targets. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import parallelism, stage

SHARDS, ROW_BYTES = 40, 16
RANGES_A_PARTITION, MOST_RANGES = 4, 8192


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and row_bytes more), text_crc32."""
    body = F.encode(F.coalesce(text_col, F.lit("")), "utf-8")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + row_bytes).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))


def prefix_sums(rows: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """rows with `ahead` (the sizes before a row, in the order given), `rank` (from 0) and `total`.

    rows are staged once, as their ranges come from a sample of them. What is broadcast has one row for each of at most
    MOST_RANGES ranges. Rows alike in all of `order` fall into one range.
    """
    spark = rows.sparkSession
    ranges = min(MOST_RANGES, RANGES_A_PARTITION * parallelism(spark))
    dealt = stage(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = dealt.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows")).select(
        "_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_ahead"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_ahead"),
        F.sum("_bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    placed = dealt.withColumn("_running", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_nth", F.row_number().over(inside))
    joined = placed.join(F.broadcast(totals), "_range")
    ahead = F.col("_bytes_ahead") + F.col("_running") - F.col(size)
    return joined.withColumn("ahead", ahead).withColumn("rank", F.col("_rows_ahead") + F.col("_nth") - 1).drop("_range", "_running", "_nth", "_bytes_ahead", "_rows_ahead")


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Rows are in order of id (no id first), then size and crc; a row goes to the shard in whose equal share of all bytes
    its middle lies, so shards are contiguous and their sizes differ from the target by less than one row at each end.
    slot counts a shard's rows from 0, without a gap. Null text: no bytes, row_bytes in all. Rows that repeat an id
    follow one another. Empty table: no rows. Fewer rows than shards leave shards empty.
    """
    placed = prefix_sums(sized(docs, id_col, text_col, row_bytes), ["doc_id", "size", "text_crc32"])
    middle = (2 * F.col("ahead") + F.col("size")).cast("decimal(38,0)") * shards
    shard = F.floor(middle / (2 * F.col("total")).cast("decimal(20,0)"))
    placed = placed.withColumn("shard", F.least(F.greatest(shard, F.lit(0)), F.lit(shards - 1)).cast("int"))
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # one row a shard
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
