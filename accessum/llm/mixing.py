"""Mixing sources to target weights by systematic sampling.

A source's target divided by its size is the number of copies each of its documents is expected to give. Along a
source's documents, ordered by size, those expectations are summed; with one random offset added, a document is
emitted once for every integer that its stretch of the sum crosses. Prefix sums come from counts: of a source's
documents of each size, of those in each of SALTS parts, and within a part; so no task needs a whole source.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import free_name, in_pieces, numbered, stage

WEIGHTS, CAP, SEED, SALTS = (5, 2, 1), 3, "mix-1", 64


def _digest_number(column, digits: int):
    """The first hexadecimal digits of a text's md5, as a number."""
    return F.conv(F.substring(F.md5(column), 1, digits), 16, 10).cast("long")


def _count_words(batches):
    for batch in in_pieces(batches, 1, 8 << 20):
        sizes = pa.array([len(t.split()) for t in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes], ["key", "size"])


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: str | None = None) -> DataFrame:
    """doc_id, row_id (column row, else the place in docs), none and source (no source: true and ''), size (words)."""
    key = F.struct(
        F.col(id_col).alias("doc_id"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"), F.col(source_col).isNull().alias("none"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
    )
    texts = docs.select(key.alias("key"), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(_count_words, f"key struct<doc_id:{kind},row_id:bigint,none:boolean,source:string>, size bigint").select("key.*", "size")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """none, source, source_size, target: one row a source.

    Sources in code point order, no source last, weigh `weights`, repeating, and share the total size; a target stops
    at cap times its source's size and the excess is shared again by weight. All uncapped targets are one multiple of
    their weights, so with sources ordered by the multiple at which they meet their cap, that multiple is the first one
    that fits the sources not yet capped. The one-task windows here hold a row for each source.
    """
    everything = Window.orderBy("none", "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sizes.groupBy("none", "source").agg(F.sum("size").alias("source_size")).withColumn("weight", w).withColumn("top", cap * F.col("source_size"))
    by_cap = Window.orderBy(F.col("top") / F.col("weight"), "none", "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    steps = sources.withColumn("total", total).withColumn("left", F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0))).withColumn("of", F.sum("weight").over(rest))
    fits = F.col("left") / F.col("of") <= F.col("top") / F.col("weight")
    level = F.first(F.when(fits, F.struct("left", "of")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.col("weight") * F.col("level.left") / F.col("level.of")
    return steps.withColumn("level", level).select("none", "source", "source_size", F.least(F.col("top").cast("double"), F.coalesce(share, F.col("top").cast("double"))).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, row_id, source, size (words), source_size, target (the source's), copies, taken (copies * size).

    copies differ by one at most within a source and never exceed cap; a source's taken words miss its target by about
    one document. The offset and the order depend on seed, source, sizes and ids only, so reruns agree. Null text: size
    0. Null source: a source of its own, last. Null ids come first among equals; rows alike in id, size and source are
    interchangeable. A source of size 0 gives no copies. Empty table: no rows.
    """
    salt = F.pmod(_digest_number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 4), F.lit(SALTS)).cast("int")
    rows = stage(word_sizes(docs, id_col, text_col, source_col, row).withColumn("salt", salt), "sizes")
    targets = source_targets(rows, weights, cap)
    offset = _digest_number(F.concat(F.lit(seed), F.when(F.col("none"), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))), 5) / F.lit(2.0**20)
    parts = rows.groupBy("none", "source", "size", "salt").agg(F.count("*").alias("n"))
    in_size = Window.partitionBy("none", "source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("none", "source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    of_size = rows.groupBy("none", "source", "size").agg(F.count("*").alias("n")).withColumn("smaller", F.coalesce(F.sum("n").over(in_source), F.lit(0))).drop("n")
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(in_size), F.lit(0))).drop("n")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of_size = of_size.join(targets, ["none", "source"]).withColumn("each", each).withColumn("offset", offset)
    placed = parts.join(of_size, ["none", "source", "size"]).withColumn("ahead", F.col("before") + F.col("smaller"))
    part = Window.partitionBy("none", "source", "size", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "row_id")
    ranked = rows.withColumn("nth", F.row_number().over(part)).join(placed, ["none", "source", "size", "salt"])
    rank = F.col("ahead") + F.col("nth")
    crossed = (F.floor(F.col("each") * rank + F.col("offset")) - F.floor(F.col("each") * (rank - 1) + F.col("offset"))).cast("long")
    source = F.when(~F.col("none"), F.col("source")).alias("source")
    return ranked.withColumn("copies", F.least(crossed, F.lit(cap).cast("long"))).select(
        "doc_id", "row_id", source, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, **columns: str) -> DataFrame:
    """docs with each row repeated as often as mix_plan() says; rows of no copies go; all columns stay."""
    table, row = numbered(docs)
    copy, times = free_name("_copy", table), free_name("_times", table)
    plan = mix_plan(table, weights, cap, seed, row=row, **columns).filter("copies > 0").select(F.col("row_id").alias(row), F.col("copies").alias(times))
    rows = table.join(plan.hint("shuffle_hash"), row)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[docs_column(c) for c in docs.columns])


def docs_column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")
