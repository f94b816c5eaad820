"""Repeated substrings, by prefix-free parsing with suffixes sorted in a dictionary and in the parse.

Triggers: of every SPAN bytes, the SEED-byte window with the least rolling hash. They cut a text into phrases: all
SPAN-byte strings with the same trigger, which start in one run of places and make up one short piece of text. Equal
strings have equal triggers at the same distance, so phrases with different trigger texts share no such string.
The dictionary holds each distinct phrase with its first place in the corpus; the parse, the phrases of each text.
 1. Phrases that occur before give up all their strings at once: the parse, sorted by phrase and place, decides.
 2. Distinct phrases with one trigger text may share a part of their strings. Their texts, looked up at their first
    places, are a block of the dictionary. A suffix array of the block, by doubled ranks of its bytes, sorts all
    suffixes by their first SPAN bytes; the parse orders what the dictionary leaves equal, so both together give the
    block's strings in corpus order. All but the first of equal ones go. Deeper order than SPAN bytes is never needed.
Phrases travel as packed arrays, dealt by trigger text, each once per task. A trigger text that over MOST_A_TRIGGER
distinct phrases share is taken apart into single strings, dealt by their own hash. Where a bounded sample shows one to
be much used, that is done beforehand, in every task alike, so that what is dealt spreads evenly; the sample decides
where rows go but not which strings are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import numbered, parallelism, slices, stage, unstage

SPAN, SEED = 100, 40
SLICE_BITS = 19
FLUSH, BUCKETS_A_PARTITION, ROWS_OUT = 300_000, 4, 5_000
#: Sample that finds much-used trigger texts: rows, and occurrences in it from which one counts as such.
SAMPLE_ROWS, MUCH_USED, MOST_ROUTED = 20_000, 64, 200_000
#: Distinct phrases of one trigger text that are sorted as one block.
MOST_A_TRIGGER = 4096
_U = np.uint64
_r = np.random.default_rng(97)
_LETTERS = [_r.integers(1, 2**63, 256, dtype=np.uint64) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, (1 << SLICE_BITS) + 2 * SPAN)
        _POWERS[:] = []
        for b in _BASES:
            pair = []
            for base in (b, pow(b, -1, 1 << 64)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            _POWERS.append(tuple(pair))
    up, down = _POWERS[which]
    return up[:n], down[:n]


class Hashes:
    """Hashes of any stretch of data, by prefix sums of a polynomial modulo 2**64 over random letters."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[which][data] * up[:-1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def each(self, width: int) -> np.ndarray:
        """Of every stretch of width."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    step, out = 1, values
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, much_used: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of texts data[starts[i]:ends[i]]: trigger hash, phrase hash, first place, number of strings.

    A phrase whose trigger is in much_used (sorted) is given as single strings, with hashes of the string.
    """
    one, two = Hashes(data, 0), Hashes(data, 1)
    seeds = one.each(SEED)
    if len(data) < SPAN:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    low = _U((1 << SLICE_BITS + 1) - 1)
    trigger = (_least(seeds & ~low | np.arange(len(seeds), dtype=np.uint64), SPAN - SEED + 1) & low).astype(np.int64)
    ok = np.zeros(len(trigger) + 1, np.int64)
    long = ends - starts >= SPAN
    ok[starts[long]] += 1
    ok[np.minimum(ends[long] - SPAN + 1, len(trigger))] -= 1
    place = np.flatnonzero(np.cumsum(ok[:-1]))
    if not len(place):
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    at = trigger[place]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    lo, n = place[first], np.diff(np.concatenate([first, [len(at)]]))
    at = at[first]
    h = seeds[at]
    c = mixed(two.of(lo, lo + n - 1 + SPAN) + (at - lo).astype(np.uint64) * _U(_BASES[1]) + n.astype(np.uint64))
    if len(much_used):
        hot = much_used[np.minimum(np.searchsorted(much_used, h), len(much_used) - 1)] == h
        if hot.any():
            single = np.repeat(lo[hot], n[hot]) + _within(n[hot])
            parts = ((h, one.of(single, single + SPAN)), (c, two.of(single, single + SPAN)), (lo, single), (n, np.ones(len(single), np.int64)))
            h, c, lo, n = (np.concatenate([a[~hot], b]) for a, b in parts)
    return h, c, lo, n


def _within(n: np.ndarray) -> np.ndarray:
    """0 to n[i] - 1 for each i, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _pieces(texts: list[bytes]):
    """(which text, its first byte's place in it, bytes) in groups of a slice's size; long texts overlap by a string."""
    size, group, total = 1 << SLICE_BITS, [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - SPAN + 1), size):
            part = t[a : a + size + SPAN - 1]
            if group and total + len(part) > size + SPAN:
                yield group
                group, total = [], 0
            group.append((i, a, part))
            total += len(part)
    if group:
        yield group


def _parsed(texts: list[bytes], much_used: np.ndarray):
    """Phrases of texts: trigger hash, phrase hash, text, place in the text, number of strings."""
    out = []
    for group in _pieces(texts):
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        h, c, lo, n = phrases(data, starts, ends, much_used)
        piece = np.searchsorted(ends, lo, "right")
        shift = np.array([a for _, a, _ in group])
        out.append((h, c, np.array([i for i, _, _ in group])[piece], lo - starts[piece] + shift[piece], n))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]


_FIELDS = ((np.uint64, 8), (np.uint64, 8), (np.int64, 8), (np.int64, 8), (np.int32, 4), (np.uint8, 1))


def _pack(columns) -> bytes:
    """h, c, document, row, place, strings; documents and rows as differences, which shrink well on their way."""
    h, c, doc, row, lo, n = columns
    parts = (h, c, np.diff(doc, prepend=np.int64(0)), np.diff(row, prepend=np.int64(0)), lo, n)
    return b"".join(np.ascontiguousarray(p, t).tobytes() for p, (t, _) in zip(parts, _FIELDS))


def _unpack(body: bytes) -> list[np.ndarray]:
    count, at, out = len(body) // sum(w for _, w in _FIELDS), 0, []
    for t, w in _FIELDS:
        out.append(np.frombuffer(body, t, count, at))
        at += count * w
    out[2], out[3] = np.cumsum(out[2]), np.cumsum(out[3])
    return out


def _first_of_each(h, c, doc, row, lo) -> tuple[np.ndarray, np.ndarray]:
    """An order by hashes and then by place in the corpus, and which of it come first among equals."""
    order = np.lexsort((lo, row, doc, c, h))
    a, b = h[order], c[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.empty(0, bool)


def _by_row(row: np.ndarray, *columns: np.ndarray):
    """(row, its columns' entries)."""
    order = np.argsort(row, kind="stable")
    row = row[order]
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
    for a, b in zip(cuts, [*cuts[1:], len(row)]):
        yield int(row[a]), [x[order[a:b]] for x in columns]


def _spans_of(lo: np.ndarray, n: np.ndarray) -> bytes:
    """Runs of places where repeated strings start, as pairs of first place and number."""
    return np.stack([lo, n], 1).astype(np.int32).tobytes()


_OUT = "kind int, bucket int, row_id long, body binary"
_NAMES = ["kind", "bucket", "row_id", "body"]
_PHRASES, _GONE, _ASK = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)


def _gone_rows(row, lo, n, buckets: int) -> list[tuple]:
    return [(_GONE, r % buckets, r, _spans_of(*x)) for r, x in _by_row(row, lo, n)]


def _parse(buckets: int, much_used: np.ndarray):
    """Texts to packed phrases, each once per task, and the strings that repeat within the task."""

    def run(batches):
        kept: list[list[np.ndarray]] = []

        def flush():
            h, c, doc, row, lo, n = (np.concatenate(x) for x in zip(*kept))
            kept.clear()
            order, first = _first_of_each(h, c, doc, row, lo)
            again = order[~first]
            yield _rows(_gone_rows(row[again], lo[again], n[again], buckets))
            order = order[first]
            bucket = (h[order] % _U(buckets)).astype(np.int64)
            out = [(_PHRASES, b, 0, _pack([x for x in cols])) for b, cols in _by_row(bucket, *(x[order] for x in (h, c, doc, row, lo, n)))]
            for i in range(0, len(out), 256):
                yield _rows(out[i : i + 256])

        for batch in batches:
            doc = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            row = batch.column(1).to_numpy()
            for i, j in slices(pa.compute.binary_length(batch.column(2)).to_pylist(), 4 << 20):
                h, c, text, lo, n = _parsed(batch.column(2).slice(i, j - i).to_pylist(), much_used)
                kept.append([h, c, doc[i:j][text], row[i:j][text], lo, n])
                if sum(len(k[0]) for k in kept) > FLUSH:
                    yield from flush()
        if kept:
            yield from flush()

    return run


def _settle(buckets: int):
    """Phrases of each bucket: later occurrences give up their strings; first ones with a trigger text in common ask."""

    def settle(bodies):
        h, c, doc, row, lo, n = (np.concatenate(x) for x in zip(*map(_unpack, bodies)))
        order, first = _first_of_each(h, c, doc, row, lo)
        again, order = order[~first], order[first]
        out = _gone_rows(row[again], lo[again], n[again], buckets)
        a = h[order]
        same = a[1:] == a[:-1]
        ask = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        edges = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else np.zeros(1, np.int64)
        n = n.astype(np.int64)
        crowded = order[np.repeat(np.diff(edges) > MOST_A_TRIGGER, np.diff(edges))]
        n[crowded] = -n[crowded]  # such phrases are to come as single strings
        for r, (hs, los, ns) in _by_row(row[ask], h[ask], lo[ask], n[ask]):
            out.append((_ASK, r % buckets, r, hs.tobytes() + los.astype(np.int32).tobytes() + ns.astype(np.int32).tobytes()))
        return _rows(out)

    def run(batches):
        at, bodies = None, []
        for batch in batches:
            ready = []
            for kind, bucket, row, body in zip(*(c.to_pylist() for c in batch.columns)):
                if kind != _PHRASES:
                    ready.append((kind, bucket, row, body))
                    continue
                if bucket != at and bodies:
                    yield settle(bodies)
                    bodies = []
                at = bucket
                bodies.append(body)
            yield _rows(ready)
        if bodies:
            yield settle(bodies)

    return run


def _look_up(batches):
    """What rows ask for: h, document, row, place and text of a phrase; of a crowded trigger's phrases, each string."""
    kinds, out = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), []

    def found():
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "doc_id", "row_id", "lo", "body"])

    for batch in batches:
        for at in range(batch.num_rows):
            doc, row, text, asks = (batch.column(i)[at].as_py() for i in range(4))
            for body in asks:
                k = len(body) // 16
                hs, los, ns = np.frombuffer(body, np.int64, k), np.frombuffer(body, np.int32, k, 8 * k), np.frombuffer(body, np.int32, k, 12 * k)
                for h, lo, n in zip(hs.tolist(), los.tolist(), ns.tolist()):
                    if n > 0:
                        out.append((h, doc, row, lo, text[lo : lo + n - 1 + SPAN]))
                        continue
                    part = text[lo : lo - n - 1 + SPAN]
                    each = Hashes(np.frombuffer(part, np.uint8), 0).each(SPAN).view(np.int64).tolist()
                    out += [(x, doc, row, lo + i, part[i : i + SPAN]) for i, x in enumerate(each)]
                    if len(out) >= ROWS_OUT:
                        yield found()
            if len(out) >= ROWS_OUT:
                yield found()
    if out:
        yield found()


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]), dtype=np.uint64)
    return out


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Where each suffix of data stands by its first `depth` bytes (a power of 2, 8 at least), zeros behind the end; equal ones stand equal."""
    more = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = np.zeros(len(data), np.uint64)
    for k in range(8):
        keys = keys << _U(8) | more[k : k + len(data)]
    rank, width = _ranks(keys), 8
    while width < depth:
        behind = np.zeros_like(rank)
        behind[:-width] = rank[width:] + _U(1)
        rank, width = _ranks(rank * _U(len(data) + 1) + behind), 2 * width
    return rank


def corpus_order(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the SPAN-byte strings that begin at starts, by their bytes and then as given, and which of it come first among equals."""
    half = 1 << (SPAN.bit_length() - 1)
    rank = suffix_ranks(data, half)
    keys = rank[starts] * _U(len(data) + 1) + rank[starts + SPAN - half]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.empty(0, bool)


def _sort_strings(batches):
    """Among phrases with one trigger text, which come sorted by it and then by place: the strings that start earlier elsewhere.

    Single strings of a much-used trigger come by their own hash; of very many, those met first are kept and the rest settled.
    """

    def settle(h, doc, row, lo, bodies):
        """Rows of repeats, and which phrases hold no repeat."""
        sizes = np.array([len(b) for b in bodies])
        n = sizes - SPAN + 1
        data = np.frombuffer(b"".join(bodies), np.uint8)
        starts = np.repeat(np.cumsum(sizes) - sizes, n) + _within(n)
        phrase = np.repeat(np.arange(len(bodies)), n)
        order, first = corpus_order(data, starts)
        again = np.sort(order[~first])
        place, rows = (lo[phrase] + _within(n))[again], row[phrase[again]]
        held = np.ones(len(bodies), bool)
        held[phrase[again]] = False
        return _rows([(_GONE, 0, r, _spans_of(x, np.ones(len(x), np.int64))) for r, (x,) in _by_row(rows, place)]), held

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column(1).fill_null(np.iinfo(np.int64).min).to_numpy()
        cols = [batch.column(0).to_numpy(), doc, batch.column(2).to_numpy(), batch.column(3).to_numpy()]
        bodies = batch.column(4).to_pylist()
        if rest:
            cols, bodies = [np.concatenate([a, b]) for a, b in zip(rest[0], cols)], rest[1] + bodies
        cut = len(cols[0]) - _tail(cols[0])
        start = 0
        for end in [*(np.flatnonzero(cols[0][1:cut] != cols[0][: cut - 1]) + 1).tolist(), cut] if cut else ():
            if end - start >= MOST_A_TRIGGER or end == cut:  # a block of whole trigger texts
                yield settle(*(x[start:end] for x in cols), bodies[start:end])[0]
                start = end
        rest = ([x[cut:] for x in cols], bodies[cut:])
        if len(rest[1]) > 2 * MOST_A_TRIGGER and len(rest[1][0]) == len(rest[1][-1]) == SPAN:
            out, held = settle(*rest[0], rest[1])
            yield out
            rest = ([x[held] for x in rest[0]], [b for b, k in zip(rest[1], held) if k])
    if rest and rest[1]:
        yield settle(*rest[0], rest[1])[0]


def _tail(h: np.ndarray) -> int:
    """How many entries at the end are equal."""
    other = np.flatnonzero(h[::-1] != h[-1])
    return int(other[0]) if len(other) else len(h)


def _cut_out(batches):
    names = ["doc_id", "row_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
    for batch in batches:
        out = []
        for at in range(batch.num_rows):
            doc, row, text, bodies = (batch.column(i)[at].as_py() for i in range(4))
            spans = merged(np.concatenate([np.frombuffer(b, np.int32).reshape(-1, 2) for b in bodies]).astype(np.int64)) if bodies else []
            kept, end = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(text[end:a])
                end = b
            kept.update(text[end:])
            out.append((doc, row, len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [x for s in spans for x in s]))
            if len(out) >= ROWS_OUT or at + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []


def merged(runs: np.ndarray) -> list[tuple[int, int]]:
    """Bytes [a, b) covered by strings that start in runs of (first place, number); touching stretches are one."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(runs[:, 0] + runs[:, 1] - 1 + SPAN)
    new = np.flatnonzero(np.concatenate([[True], runs[1:, 0] > ends[:-1]]))
    return list(zip(runs[new, 0].tolist(), ends[np.concatenate([new[1:], [len(runs)]]) - 1].tolist()))


def much_used_triggers(docs: DataFrame, rows: int = SAMPLE_ROWS, least: int = MUCH_USED) -> np.ndarray:
    """Trigger hashes that at least `least` phrases of some `rows` sampled rows have: at most a few hundred thousand."""
    share = min(1.0, rows / max(1, docs.count()))

    def run(batches):
        for batch in batches:
            h = _parsed(batch.column(0).to_pylist(), np.empty(0, np.uint64))[0]
            values, counts = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["h", "n"])

    sample = docs.select("body") if share == 1 else docs.sample(share, 11).select("body")
    found = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(MOST_ROUTED).select("h").toPandas()["h"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row_id, n_bytes, n_removed, n_spans, kept_sha256, spans (first, end of each removed run).

    Texts are UTF-8 bytes; each byte goes that is covered by a SPAN-byte string which also starts earlier: in a row of
    smaller id, or in the same row at an earlier place. Strings lie within one text and are judged on the input. Rows
    that repeat an id are documents of their own, in the order of the table, which is numbered once; null ids come
    first. Null text: empty. Texts shorter than SPAN keep all. Empty table: no rows. Ids must be integers.
    """
    spark = docs.sparkSession
    buckets = BUCKETS_A_PARTITION * parallelism(spark)
    body = F.encode(F.coalesce(text_col, F.lit("")), "utf-8")
    table, number = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")))
    texts = table.filter(F.col(number).isNotNull()).select("doc_id", F.col(number).alias("row_id"), "body")  # as both joins read it, so that one exchange serves both
    parsed = texts.mapInArrow(_parse(buckets, much_used_triggers(texts)), _OUT)
    dealt = parsed.repartition(parallelism(spark), "bucket").sortWithinPartitions("bucket")
    settled = stage(dealt.mapInArrow(_settle(buckets), _OUT), "settled")
    asks = settled.filter(F.col("kind") == _ASK).groupBy(F.col("row_id").alias("asking")).agg(F.collect_list("body").alias("asks"))
    asked = texts.join(asks.hint("shuffle_hash"), F.col("row_id") == F.col("asking")).select("doc_id", "row_id", "body", "asks")
    found = asked.mapInArrow(_look_up, "h long, doc_id long, row_id long, lo int, body binary")
    strings = found.repartition(parallelism(spark), "h").sortWithinPartitions("h", F.col("doc_id").asc_nulls_first(), "row_id", "lo").mapInArrow(_sort_strings, _OUT)
    gone = settled.filter(F.col("kind") == _GONE).unionByName(strings).groupBy(F.col("row_id").alias("of")).agg(F.collect_list("body").alias("gone"))
    both = texts.join(gone.hint("shuffle_hash"), F.col("row_id") == F.col("of"), "left").select("doc_id", "row_id", "body", "gone")
    return both.mapInArrow(_cut_out, "doc_id long, row_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
