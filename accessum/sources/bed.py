"""BED-like text files: fragments, regions, barcodes, narrow peaks; plain or gzipped by suffix, as Spark reads them.

Block-gzipped ones are read by bgzf.py, a file in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fragments import with_scores
from . import bgzf

#: Columns of BED and of narrowPeak files, by this package's names.
BED = ("chrom", "lo", "hi", "name", "score", "strand", "thick_lo", "thick_hi", "item_rgb", "block_count", "block_sizes", "block_starts")
NARROW_PEAK = ("chrom", "lo", "hi", "name", "score", "strand", "fold_change", "minus_log10_p", "minus_log10_q", "summit")
_INTS, _DOUBLES = {"lo", "hi", "thick_lo", "thick_hi", "block_count", "summit"}, {"fold_change", "minus_log10_p", "minus_log10_q"}


def _kind(name: str) -> T.DataType:
    return T.IntegerType() if name in _INTS else T.DoubleType() if name in _DOUBLES else T.StringType()


def _blocked(path: str) -> bool:
    """Whether a file is block-gzipped; names with patterns, and files that Spark alone can open, are left to Spark."""
    try:
        return path.endswith((".gz", ".bgz")) and bgzf.is_bgzf(path)
    except (OSError, ValueError):
        return False


def _columns(spark: SparkSession, path: str, blocked: bool) -> int:
    if blocked:
        line = bgzf.first_line(path)
        return len(line.split("\t")) if line else 0
    first = spark.read.text(path).filter(F.trim("value") != "").filter(~F.col("value").startswith("#")).first()
    return len(first[0].split("\t")) if first else 0


def read_bed(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """As many of BED's columns as the first data line has; blank and # lines are left out.

    A block-gzipped file is read in many tasks, and filters on chrom, lo and hi use the .tbi index beside it. score
    stays text unless all of a file's scores are whole numbers. Fewer than `least` columns: ValueError. Empty
    file: no rows of `least` columns.
    """
    blocked = _blocked(path)
    n = _columns(spark, path, blocked)
    if 0 < n < least:
        raise ValueError(f"{path} has {n} columns; {least} are needed")
    names = BED[: max(n, least)]
    schema = T.StructType([T.StructField(c, _kind(c)) for c in names])
    df = bgzf.read_bgzf(spark, path, schema) if blocked else spark.read.csv(path, sep="\t", schema=schema, comment="#", quote="", mode="PERMISSIVE").filter(F.col("chrom").isNotNull())
    if "score" in names and df.filter(~F.col("score").rlike(r"^-?\d+$") | F.col("score").isNull()).isEmpty():
        df = df.withColumn("score", F.col("score").cast("int"))
    return df


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """chrom, lo, hi, cb, score (whole numbers): where the file has no such score, equal fragments are counted."""
    return with_scores(read_bed(spark, path, 4).withColumnRenamed("name", "cb"))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """cb: the first column."""
    return spark.read.csv(path, sep="\t", quote="").select(F.col("_c0").alias("cb"))


def read_narrow_peaks(spark: SparkSession, path: str, skip_empty: bool = False) -> DataFrame:
    """narrowPeak files; one without rows is an error unless skip_empty."""
    df = spark.read.csv(path, sep="\t", schema=T.StructType([T.StructField(c, _kind(c)) for c in NARROW_PEAK]), quote="").withColumn("score", F.col("score").cast("double"))
    if not skip_empty and df.isEmpty():
        raise ValueError(f"{path} has no peaks")
    return df


def write_bed(df: DataFrame, path: str, columns: tuple[str, ...] = ("chrom", "lo", "hi")) -> None:
    """Columns as tab-separated text without a header."""
    df.select(*columns).write.csv(path, sep="\t", quote="", emptyValue="", mode="overwrite")
