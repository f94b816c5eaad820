"""Feather (Arrow IPC) matrices as long tables: a task for a record batch and a stretch of columns, read in place."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bgzf import _open

COLUMNS = 4096


@dataclass
class Piece(InputPartition):
    """A record batch's columns from first on, before last; before: rows in the batches ahead of it."""

    batch: int
    before: int
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: int, schema: StructType):
        self.path, self.columns, self.schema = path, columns, schema

    def partitions(self):
        with _open(self.path) as f:
            file = pa.ipc.open_file(f)
            out, before, width = [], 0, len(file.schema)
            # rows of a batch are known from the batch without its columns
            counted = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=[0])) if width else None
            for b in range(file.num_record_batches if counted else 0):
                out += [Piece(b, before, i, min(width, i + self.columns)) for i in range(0, width, self.columns)]
                before += counted.get_batch(b).num_rows
        return out or [Piece(-1, 0, 0, 0)]

    def read(self, partition: Piece):
        if partition.batch < 0:
            return
        schema, p = to_arrow_schema(self.schema), partition
        with _open(self.path) as f:
            names = pa.ipc.open_file(f).schema.names[p.first : p.last]
            batch = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=list(range(p.first, p.last)))).get_batch(p.batch)
            rows = pa.array(range(p.before + 1, p.before + 1 + batch.num_rows), pa.int32())
            for name, column in zip(names, batch.columns):
                if pa.types.is_floating(column.type) or pa.types.is_integer(column.type):
                    same = pa.array([name] * len(column), pa.string())
                    yield pa.RecordBatch.from_arrays([rows, same, column.cast(pa.float64())], schema=schema)


class FeatherSource(DataSource):
    """format("feather_matrix"): option path, and columns (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "feather_matrix"

    def schema(self) -> str:
        return "row int, name string, value double"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("columns", COLUMNS)), schema)


def read_matrix(spark: SparkSession, path: str, columns: int = COLUMNS) -> DataFrame:
    """row (from 1), name (the column's), value: the cells of a Feather file's numeric columns; others are left out. Nulls stay."""
    spark.dataSource.register(FeatherSource)
    return spark.read.format("feather_matrix").option("columns", columns).load(path)
