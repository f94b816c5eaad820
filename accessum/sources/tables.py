"""Matrices, model tables and the files a quality-control run leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import Dataset, counts_of_matrix
from . import feather


def read_count_matrix(spark: SparkSession, path: str, **options) -> Dataset:
    """A dataset from a tab-separated matrix, regions by cells, whose first column holds region ids."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    return Dataset.create(counts_of_matrix(df, df.columns[0]), **options)


def read_model(spark: SparkSession, cell_topic: str, topic_region: str) -> tuple[DataFrame, DataFrame]:
    """cell_topic (cell_id, topic, p) and topic_region (region_id, topic, p) from Feather files of topics by cells and topics
    by regions: a row a topic, in order, a column a cell or region. Columns that hold no numbers are left out."""
    named = lambda path, key: feather.read_matrix(spark, path).select(F.col("name").alias(key), F.col("row").alias("topic"), F.col("value").alias("p"))
    return named(cell_topic, "cell_id"), named(topic_region, "region_id")


def write_qc(tables: dict[str, DataFrame], prefix: str) -> None:
    """Each table as zstd Parquet under prefix; `thresholds` and `barcodes` as tab-separated text too."""
    for name, df in tables.items():
        df.write.parquet(f"{prefix}.{name}.parquet", mode="overwrite", compression="zstd")
        if name in ("thresholds", "barcodes"):
            df.write.csv(f"{prefix}.{name}.tsv", sep="\t", header=name == "thresholds", mode="overwrite")


def write_pseudobulk(labelled: DataFrame, path: str, label: str) -> None:
    """Fragments of each label in a folder of its own."""
    labelled.repartition(label, F.col("chrom")).sortWithinPartitions("chrom", "lo", "hi").write.partitionBy(label).csv(path, sep="\t", mode="overwrite", compression="gzip")


def write_exploration(values: DataFrame, cells: DataFrame, path: str, embeddings: DataFrame | None = None, markers: DataFrame | None = None) -> None:
    """What a browser of cells shows, as Parquet tables: matrix, cells (with dense cluster ids), embeddings, markers."""
    values.write.parquet(f"{path}/matrix", mode="overwrite")
    cells.write.parquet(f"{path}/cells", mode="overwrite")
    for name, df in (("embeddings", embeddings), ("markers", markers)):
        if df is not None:
            df.write.parquet(f"{path}/{name}", mode="overwrite")


def cluster_ids(cells: DataFrame, label: str) -> DataFrame:
    """cells with cluster: labels numbered from 0 in order."""
    levels = cells.select(label).distinct()
    from pyspark.sql import Window

    numbered = levels.withColumn("cluster", F.row_number().over(Window.orderBy(label)) - 1)  # a row a label
    return cells.join(F.broadcast(numbered), label)


def regulons(topic_region: DataFrame, binarized: DataFrame) -> DataFrame:
    """region_id, topic: regions above the lowest score that their topic's binarization kept."""
    low = binarized.groupBy("topic").agg(F.min("score").alias("_low"))
    return topic_region.join(F.broadcast(low), "topic").filter(F.col("p") > F.col("_low")).select("region_id", "topic")  # a row a topic
