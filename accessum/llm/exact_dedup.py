"""Exact dedup by content-defined chunk recipes.

Each normalised text is cut into chunks at positions that its own bytes decide. Distinct chunks travel once per task
to get verified identifiers; a text's recipe is the ordered list of its chunks' identifiers, and texts are compared by
recipe, so long documents themselves never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import free_name, in_pieces, numbered, stage, without_rows

MIN_CHUNK, MAX_CHUNK, CUT_BITS, WINDOW = 512, 16384, 11, 32
ID_BYTES = 16
_GEAR = np.random.default_rng(20240101).integers(0, 2**32, 256, dtype=np.uint32)


def _rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the WINDOW bytes that end at each position, built by doubling."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def cut_points(lengths: list[int], data: np.ndarray) -> Iterator[list[int]]:
    """For texts that lie one after another in data: each text's chunk ends, relative to its start.

    Cuts lie MIN_CHUNK to MAX_CHUNK bytes apart and depend on the text's own bytes only, as MIN_CHUNK exceeds the
    hash window. An empty text has no chunk.
    """
    hits = np.flatnonzero(_rolling(data) >> np.uint32(32 - CUT_BITS) == 0) + 1 if len(data) else np.empty(0, np.int64)
    start = at = 0
    hits = hits.tolist()
    for n in lengths:
        end, ends, last = start + n, [], start
        while at < len(hits) and hits[at] <= start:
            at += 1
        while at < len(hits) and hits[at] < end:
            cut = hits[at]
            while cut - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last - start)
            if cut - last >= MIN_CHUNK:
                last = cut
                ends.append(cut - start)
            at += 1
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last - start)
        if end > last:
            ends.append(n)
        yield ends
        start = end


def _batches(batches, limit=4 << 20):
    """(rows' ids, texts as bytes, chunk ends) of at most limit bytes at a time, or one long text."""
    for batch in in_pieces(batches, 1, limit):
        part = batch.column(1).to_pylist()
        data = np.frombuffer(b"".join(part), np.uint8)
        yield batch.column(0), part, list(cut_points([len(t) for t in part], data))


def _chunk_id(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=ID_BYTES).digest()


def _recipes(batches):
    for ids, texts, cuts in _batches(batches):
        recipes = [b"".join(_chunk_id(t[a:b]) for a, b in zip([0, *ends], ends)) for t, ends in zip(texts, cuts)]
        shas = [hashlib.sha256(t).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([ids, pa.array(recipes, pa.binary()), pa.array(shas)], ["key", "recipe", "text_sha256"])


def _chunks(batches):
    """Chunks, each once per few batches: what a task has sent already it need not send again."""
    sent: set[bytes] = set()
    for _, texts, cuts in _batches(batches):
        ids, bodies = [], []
        for t, ends in zip(texts, cuts):
            for a, b in zip([0, *ends], ends):
                key = _chunk_id(body := t[a:b])
                if key not in sent:
                    sent.add(key)
                    ids.append(key)
                    bodies.append(body)
        if len(sent) > 500_000:
            sent.clear()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(bodies, pa.binary())], ["chunk_id", "body"])


def normalised(column: str = "text"):
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, row_id (column row, else the place in docs), recipe (its chunks' identifiers, ID_BYTES each, in order), text_sha256 of the normalised text."""
    key = F.struct(F.col(id_col).alias("doc_id"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"))
    texts = docs.select(key.alias("key"), F.encode(normalised(text_col), "utf-8").alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = texts.mapInArrow(_recipes, f"key struct<doc_id:{kind},row_id:bigint>, recipe binary, text_sha256 string")
    return out.select("key.*", "recipe", "text_sha256")


def chunk_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """chunk_id, variants (distinct bodies that share the identifier): distinct chunks, compared as bytes.

    Bodies of one identifier meet and are compared, so an identifier with variants = 1 stands for one byte string.
    """
    texts = docs.select(F.lit(0).alias("doc_id"), F.encode(normalised(text_col), "utf-8").alias("body"))
    sent = texts.mapInArrow(_chunks, "chunk_id binary, body binary").repartition("chunk_id")
    return sent.dropDuplicates(["chunk_id", "body"]).groupBy("chunk_id").agg(F.count("*").alias("variants"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, row_id.

    Texts are equal when identical after replacing each run of ASCII white space by one space (no trimming). The row
    with the smallest id of a group stays, and of rows that repeat that id the one of the smallest row_id; exactly one
    row of a group stays. row_id is docs' column `row`, else the row's place, stored once. Null text: equal to empty.
    Null id: after every other id, so such a row stays only in a group without ids, with keep_id null. Empty table: no
    rows. Other columns are ignored. Should different chunks ever share an identifier, their texts are told apart by
    the whole text's SHA-256.
    """
    clash = not chunk_store(docs, text_col).filter("variants > 1").isEmpty()
    rows = stage(recipes(docs, id_col, text_col, row), "recipes")
    same = F.concat("recipe", F.unhex("text_sha256")) if clash else F.col("recipe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    groups = rows.groupBy(same.alias("same")).agg(first.alias("keep"), F.count("*").alias("group_size"))
    groups = stage(groups, "groups")  # a join of two tables can be split where one group is large
    joined = rows.join(groups, same == F.col("same"))
    n_chunks = (F.octet_length("recipe") / ID_BYTES).cast("int")
    kept = F.col("row_id") == F.col("keep.row_id")
    return joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", n_chunks.alias("n_chunks"), "row_id")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() doesn't keep; all columns stay."""
    table, row = numbered(docs)
    gone = exact_groups(table, id_col, text_col, row).filter(~F.col("kept")).select(F.col("row_id").alias(free_name("_gone", table)))
    return without_rows(table, row, gone)
