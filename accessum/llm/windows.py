"""Substring dedup by words: repeated windows found level by level, each level twice as long as the one before.

At the first length every window is a candidate. A level counts its candidates; those that occur once are done with, as
no longer window from their place can repeat, and two repeated ones side by side are one candidate of twice the
length. The last level, windows of the length asked for, decides where each first occurs.

Texts are kept as chunks of word codes, in a table bucketed by chunk that every level reads in place. A level sends, for
each chunk and each range of window identifiers, the sorted identifiers as differences; what comes back is one bit for
each of them, in the same order, which the chunk's next reading puts to its places again. So neither texts nor places
are shuffled, and identifiers only of windows whose halves repeat.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import in_pieces, parallelism, shared_dir, split_pieces, stage, utf8

WORDS = 20

CHUNK = "chunk bigint, n_words bigint, ids array<bigint>, lengths array<int>, vocabulary binary, codes binary"
SENT = "bucket int, chunk bigint, n int, ids binary, more binary, least bigint, docs binary"
MARK = "chunk bigint, bucket int, marks binary"
DONE = "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept binary"

#: White space of words as a space, all else as it is.
_SPACES = bytes(32 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b for b in range(256))
_LAST = np.iinfo(np.int64).max
_U = np.uint64


@dataclass(frozen=True)
class Limits:
    """Sizes that bound a task's memory and change no result."""

    #: Bytes of text in a chunk; a longer text is a chunk of its own, of some 80 bytes a word while it is read.
    chunk: int = 8 << 20
    #: Windows' identifiers that meet in one call, on average.
    bucket: int = 2_000_000


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers (unsigned, 64 bits) as compressed bytes, all lowest bytes first."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(body: bytes, n: int) -> np.ndarray:
    width = body[0]
    planes = np.frombuffer(pa.decompress(body[1:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on every bit (Steele, Lea and Flood's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * _U(0x9E3779B97F4A7C15) + b)


def _chunks(batches, limits: Limits) -> Iterator[pa.RecordBatch]:
    """CHUNK rows of a task's texts (doc_id, body)."""
    number = count(TaskContext.get().partitionId() << 32)
    held: list[tuple[int | None, np.ndarray]] = []
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    size = 0

    def chunk() -> pa.RecordBatch:
        held.sort(key=lambda x: (x[0] is None, x[0] or 0))  # stable: rows of one id stay as they came
        codes = np.concatenate([c for _, c in held])
        row = {"chunk": next(number), "n_words": len(codes), "ids": [i for i, _ in held], "lengths": [len(c) for _, c in held], "vocabulary": pa.compress(b" ".join(vocabulary), codec="zstd", asbytes=True), "codes": _packed(codes)}
        row["vocabulary"] = sum(map(len, vocabulary), max(0, len(vocabulary) - 1)).to_bytes(8, "little") + row["vocabulary"]
        return pa.RecordBatch.from_pylist([row], CHUNK_ARROW)

    for batch in in_pieces(batches, 1, 1 << 20):
        for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and size + len(body) > limits.chunk:
                yield chunk()
                held, size = [], 0
                vocabulary = defaultdict(count().__next__)
            parts = [np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)) for words in split_pieces(body, _SPACES, 4 << 20)]
            held.append((i, np.concatenate(parts) if parts else np.zeros(0, np.uint32)))
            size += len(body)
    if held:
        yield chunk()


CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("n_words", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("codes", pa.binary())])
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("more", pa.binary()), ("least", pa.int64()), ("docs", pa.binary())])
MARK_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("marks", pa.binary())])
DONE_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


class _Chunk:
    """A chunk's words and the candidates of a level: at (places of their first words, ascending) and ids."""

    def __init__(self, row: dict, first: int, bucket_bits: int):
        self.lengths = np.array(row["lengths"], np.int64)
        self.ids = np.array([_LAST if i is None else i for i in row["ids"]], np.int64)
        self.names = row["ids"]
        blob = row["vocabulary"]
        words = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        self.words = words.split(b" ") if words else []
        self.codes = _unpacked(row["codes"], row["n_words"]).astype(np.int64)
        ends = np.repeat(np.cumsum(self.lengths), self.lengths)
        self.left = ends - np.arange(len(ends))  # words from here to the text's end
        self.first, self.bits = first, bucket_bits
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], _U)

    def start(self, lane: int) -> None:
        """All windows of the first length, with identifiers of their own for each lane."""
        w = _mixed(self.hashes + _U(lane))[self.codes] if len(self.codes) else np.zeros(0, _U)
        n = max(0, len(w) - self.first + 1)
        ids = w[:n]
        for j in range(1, self.first):
            ids = _joined(ids, w[j : j + n])
        self.length = self.first
        self.at = np.flatnonzero(self.left[:n] >= self.first)
        self.window = ids[self.at]

    def halves(self, keep: np.ndarray) -> None:
        """Candidates of twice the length: kept ones with a kept one right behind."""
        at, ids = self.at[keep], self.window[keep]
        next_ = np.searchsorted(at, at + self.length)
        inside = next_ < len(at)
        inside[inside] = at[next_[inside]] == at[inside] + self.length
        self.length *= 2
        inside &= self.left[at] >= self.length
        self.at, self.window = at[inside], _joined(ids[inside], ids[next_[inside]])

    def buckets(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """bucket, from, to of sorted identifiers by their leading bits."""
        of = (ids >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(ids), np.int64)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        yield from zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)])

    def told(self, ids: np.ndarray, marks: dict[int, bytes]) -> np.ndarray:
        """The bits that came back for sorted identifiers."""
        out = np.zeros(len(ids), bool)
        for bucket, lo, hi in self.buckets(ids):
            out[lo:hi] = np.unpackbits(np.frombuffer(marks[bucket], np.uint8), count=hi - lo)
        return out

    def climb(self, levels: list[dict[int, bytes]]) -> list[np.ndarray]:
        """To the level after those whose marks are given: at, window, and the candidates kept at each."""
        self.start(0)
        kept = []
        for marks in levels:
            ids, where, n = np.unique(self.window, return_inverse=True, return_counts=True)
            repeated = self.told(ids, marks) | (n > 1)
            kept.append(repeated[where])
            self.halves(kept[-1])
        return kept

    def exact(self, kept: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the last level: the order of candidates by identifier and place, where each different one begins in that
        order, and 32 more bits of its identifier, from the second lane."""
        window = self.window
        self.start(1)
        for keep in kept:
            self.halves(keep)
        more, self.window = self.window >> _U(32), window
        order = np.lexsort((self.at, more, window))
        a, b = window[order], more[order]
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else [])
        return order, starts, b[starts]


def _rows(batches, levels: int) -> Iterator[tuple[dict, list[dict[int, bytes]]]]:
    """Chunks one by one, with the marks of each level by bucket."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            marks: list[dict[int, bytes]] = [{} for _ in range(levels)]
            for m in row.get("marks") or ():
                marks[m["level"]][m["bucket"]] = m["marks"]
            yield row, marks


def _sent(batches, levels: int, first: int, last: bool, bucket_bits: int, id_bits: int) -> Iterator[pa.RecordBatch]:
    for row, marks in _rows(batches, levels):
        c = _Chunk(row, first, bucket_bits)
        kept = c.climb(marks)
        if last:
            order, starts, more = c.exact(kept)
            ids = c.window[order][starts]
            docs = c.ids[np.searchsorted(np.cumsum(c.lengths), c.at[order][starts], "right")]
        else:
            ids = np.unique(c.window)
        out = []
        for bucket, lo, hi in c.buckets(ids):
            x = ids[lo:hi] >> _U(0 if last else 64 - id_bits)
            body = {"bucket": bucket, "chunk": row["chunk"], "n": hi - lo, "ids": x[:1].tobytes() + _packed(np.diff(x))}
            if last:
                least = int(docs[lo:hi].min())
                body |= {"more": _packed(more[lo:hi]), "least": least, "docs": _packed(docs[lo:hi].view(_U) - np.int64(least).view(_U))}
            out.append(body)
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_pylist(out[i : i + 64], SENT_ARROW)


def _decoded(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray]:
    """For a bucket: numbers of identifiers by chunk, each one's chunk (by place in the table), and the identifiers."""
    n = table.column("n").to_pylist()
    ids = [np.cumsum(np.concatenate([np.frombuffer(b[:8], _U), _unpacked(b[8:], k - 1)]), dtype=_U) for b, k in zip(table.column("ids").to_pylist(), n)]
    return n, np.repeat(np.arange(len(n)), n), np.concatenate(ids)


def _answers(table: pa.Table, n: list[int], marked: np.ndarray) -> pa.Table:
    ends = np.cumsum(n)
    marks = [np.packbits(marked[hi - k : hi]).tobytes() for k, hi in zip(n, ends)]
    return pa.table([table.column("chunk"), table.column("bucket"), pa.array(marks, pa.binary())], MARK_ARROW)


def _repeated(table: pa.Table) -> pa.Table:
    """Marks of identifiers that several chunks sent."""
    n, _, ids = _decoded(table)
    _, where, times = np.unique(ids, return_inverse=True, return_counts=True)
    return _answers(table, n, times[where] > 1)


def _owned(table: pa.Table) -> pa.Table:
    """Marks of identifiers whose first occurrence, by document and then chunk, is in the chunk that gets the mark."""
    table = table.sort_by("chunk")
    n, chunk, ids = _decoded(table)
    more = np.concatenate([_unpacked(b, k) for b, k in zip(table.column("more").to_pylist(), n)])
    docs = np.concatenate([(_unpacked(b, k) + np.int64(x).view(_U)).view(np.int64) for b, k, x in zip(table.column("docs").to_pylist(), n, table.column("least").to_pylist())])
    order = np.lexsort((chunk, docs, more, ids))
    a, b = ids[order], more[order]
    owned = np.zeros(len(ids), bool)
    owned[order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])]] = True
    return _answers(table, n, owned)


def _done(batches, levels: int, first: int, ended: bool, bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """DONE rows of chunks, whose last level's marks tell what they own; with `ended` no window repeats."""
    for row, marks in _rows(batches, levels):
        c = _Chunk(row, first, bucket_bits)
        change = np.zeros(len(c.codes) + 1, np.int32)
        if not ended:
            order, starts, _ = c.exact(c.climb(marks[:-1]))
            repeat = np.ones(len(order), bool)
            repeat[starts] = ~c.told(c.window[order][starts], marks[-1])
            at = c.at[order][repeat]
            change[at] += 1
            change[at + c.length] -= 1  # places differ, so none is counted once for two
        gone = np.cumsum(change[:-1]) > 0
        words = np.array(c.words, object)
        out, size, hi = [], 0, 0
        for name, k in zip(c.names, c.lengths.tolist()):
            lo, hi = hi, hi + k
            kept = b" ".join(words[c.codes[lo:hi][~gone[lo:hi]]].tolist())
            spans = np.count_nonzero(np.diff(gone[lo:hi].astype(np.int8), prepend=0) == 1)
            out.append({"doc_id": name, "n_words": k, "n_removed": int(gone[lo:hi].sum()), "n_spans": int(spans), "kept": kept})
            size += len(kept)
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, DONE_ARROW)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, DONE_ARROW)


def _bucketed(df: DataFrame, by: str) -> DataFrame:
    """df as a table in the shared folder, in buckets, so that joins on `by` read it in place."""
    spark = df.sparkSession
    name = f"windows_{uuid.uuid4().hex}"
    df.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(parallelism(spark), by).saveAsTable(name)
    return spark.table(name)


def remove_repeated_windows(docs: DataFrame, words: int = WORDS, first: int | None = None, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans (removed runs), kept (the other words, joined by one space): one row a row of docs.

    Words are runs of other characters than ASCII white space. A word goes if a window of `words` consecutive words of its
    text covers it whose sequence also starts earlier: in a row of a smaller id, or earlier in the same row. Windows are
    judged on the input. The first level's length, `first` (words / 4 unless given), times a power of two is `words`.

    Ids are whole numbers, else TypeError. Null ids come after all others, and rows of one id follow each other, in the order in which they were
    read and written once as chunks. Null texts have no words. Texts shorter than a window stay whole. Empty table: no
    rows. Windows are one if their identifiers are: 96 bits of hash of their words' 64 bits of hash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; whole numbers are needed")
    first = first or max(1, words // 4)
    steps = (words // first).bit_length() - 1
    if first << steps != words:
        raise ValueError(f"{words} isn't {first} times a power of two")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    chunks = _bucketed(texts.mapInArrow(lambda b: _chunks(b, limits), CHUNK), "chunk")
    n = chunks.agg(F.sum("n_words")).first()[0] or 0
    bucket_bits = max(0, -(-n // limits.bucket) - 1).bit_length()
    id_bits = min(64, max(n.bit_length() + 8, bucket_bits + 8))  # of 256 windows that occur once, one at most seems repeated by chance, and goes at the last level
    answers: list[DataFrame] = []

    def with_marks() -> DataFrame:
        if not answers:
            return chunks
        rows = [a.select("chunk", F.struct(F.lit(i).alias("level"), "bucket", "marks").alias("m")) for i, a in enumerate(answers)]
        of = rows[0]
        for more in rows[1:]:
            of = of.union(more)
        of = of.groupBy("chunk").agg(F.collect_list("m").alias("marks"))  # a bit a window of the chunk and level
        return chunks.join(of.hint("shuffle_hash"), "chunk", "left")

    ended = False
    for level in range(steps + 1):
        last = level == steps
        sent = with_marks().mapInArrow(lambda b, k=level, last=last: _sent(b, k, first, last, bucket_bits, id_bits), SENT)
        answers.append(stage(sent.groupBy("bucket").applyInArrow(_owned if last else _repeated, MARK), "marks"))
        if answers[-1].isEmpty():  # no candidate has survived
            ended = True
            break
    levels = len(answers)
    return with_marks().mapInArrow(lambda b: _done(b, levels, first, ended, bucket_bits), DONE).withColumn("kept", F.col("kept").cast("string"))
