"""Shared plumbing: shared-folder staging, Arrow streaming, long-text-safe batching."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees (`spark.checkpoint.dir`); one of our own only where that is unset and all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="accessum-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table that stage() wrote and that no later plan reads."""
    path = getattr(df, "_staged_at", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: str = "text"):
    """A text column as bytes, null as empty."""
    return F.encode(F.coalesce(F.col(column), F.lit("")), "utf-8")


def free_name(name: str, *frames: DataFrame) -> str:
    """name, lengthened until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written once, and the number's column name (clashing with none of docs').

    A number is stored beside its row, so every later reading of the table agrees on it, however the table is split
    into tasks then. Numbers follow the order of the partitions of this one reading.
    """
    row = free_name("_row", docs)
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def without_rows(table: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """A numbered() table without the rows whose number is in gone's one column, and without the number.

    Only gone's side is held in memory, a partition at a time, so that long rows aren't sorted.
    """
    return table.join(gone.hint("shuffle_hash"), F.col(row) == F.col(gone.columns[0]), "left_anti").drop(row)


def unsent(df: DataFrame) -> DataFrame:
    """df as a side of a join that never sends a side whole through the driver.

    Spark goes by the size of files and, of columns of arrays, by one element; a table of rows that repeat takes some
    forty times its files' size in memory, so one below the threshold for broadcasts can fill the driver.
    """
    return df.hint("merge")


def in_pieces(batches, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column's strings or bytes sum to at most limit bytes; a longer one stands alone."""
    for batch in batches:
        for i, j in slices(pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist(), limit):
            yield batch.slice(i, j - i)


def split_pieces(body: bytes, table: bytes, piece: int) -> Iterator[list[bytes]]:
    """The words of body after bytes are replaced by table, which leaves spaces alone between words: of piece bytes and
    what is left of a word at a time."""
    body, at = body.translate(table), 0
    while at < len(body):
        end = body.find(b" ", at + piece) if at + piece < len(body) else -1
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch; f may give None for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def slices(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows whose lengths sum to at most limit; a longer row stands alone."""
    i = total = 0
    for j, n in enumerate(lengths):
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(lengths):
        yield i, len(lengths)
