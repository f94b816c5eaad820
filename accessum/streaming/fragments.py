"""Fragments that arrive in files over time: running counts per barcode, with the batch operators' meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("cb", T.StringType()), T.StructField("score", T.IntegerType())])


def fragment_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Tab-separated fragment files as they appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("sep", "\t").option("maxFilesPerTrigger", files_a_batch).csv(folder)


def running_counts(stream: DataFrame) -> DataFrame:
    """cb, total_fragments_count, unique_fragments_count so far; the state is one row a barcode."""
    return stream.groupBy("cb").agg(F.sum("score").alias("total_fragments_count"), F.count("*").alias("unique_fragments_count"))


def to_table(counts: DataFrame, path: str, checkpoint: str):
    """Each batch replaces the table at path; a restart goes on from the checkpoint."""

    def put(df: DataFrame, _: int) -> None:
        df.write.parquet(path, mode="overwrite")

    return counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).start()
