"""Source divergence audit: how far the sources of a language are apart, and which terms set a source apart from it.

Tasks count terms in radix tries (tries.py), a trie a language, with a counter a source at the leaves. Tries are cut into
subtrees by prefix, subtrees of one prefix range meet in one task and merge, and the merged tries are walked in UTF-8
order: first for the terms that enough documents have, then, in blocks of these, for the sums over terms of each pair of
sources and for each source's first candidates, whose ties the walk's order settles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import tries
from ._util import in_pieces, parallelism, split_pieces, stage, unstage, utf8

LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000


@dataclass(frozen=True)
class Limits:
    """Sizes that bound memory and change no result."""

    #: Bytes of the first prefixes, and by how many they are lengthened where more than most_terms terms of tasks' tries share one.
    depth: int = 3
    most_terms: int = 200_000
    #: Different terms, and words, that a task holds before they go into tries and out.
    most_held: int = 500_000
    most_words: int = 8_000_000
    #: Terms in a block of kept ones.
    block: int = 1024
    #: Bytes of text split at once.
    piece: int = 4 << 20


SUBTREE = f"lang string, path binary, {tries.ARRAYS}"
KEPT = "lang string, terms array<string>, sizes array<int>, sources array<bigint>, counts array<bigint>"
FOUND = "part string, lang string, source string, item string, value bigint"

#: ASCII letters as small ones, other ASCII as a space, all else as it is: bytes of UTF-8 beyond ASCII are never below 128.
_TERM_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


class _Counted:
    """A lang's terms by number, in the order in which they came, and the numbers of what was read, by source and by document."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.words: dict[int, list[np.ndarray]] = defaultdict(list)
        self.docs: list[np.ndarray] = []

    def add(self, source: int, pieces: Iterator[list[bytes]]) -> int:
        """How many terms a text has."""
        found = [np.fromiter(map(self.number.__getitem__, terms), np.int32, len(terms)) for terms in pieces]
        found = np.concatenate(found) if len(found) != 1 else found[0]
        self.words[source].append(found)
        self.docs.append(np.unique(found))
        return len(found)

    def subtrees(self, depth: int) -> Iterator[dict]:
        terms = sorted(self.number)
        order = np.fromiter(map(self.number.__getitem__, terms), np.int64, len(terms))
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        cells = []
        for source, found in self.words.items():
            n = np.bincount(np.concatenate(found), minlength=len(terms))[order]
            at = np.flatnonzero(n)
            cells.append((at, np.full(len(at), source), n[at]))
        at, sources, counts = (np.concatenate(x) for x in zip(*cells))
        by = np.argsort(at, kind="stable")
        docs = np.bincount(np.concatenate(self.docs), minlength=len(terms))[order]
        yield from tries.subtrees(b"", terms, docs, np.bincount(at, minlength=len(terms)), sources[by], counts[by], depth)


def _counted(batches, limits: Limits) -> Iterator[dict]:
    """Subtree rows of a task's documents (lang, source, body): counters go into tries, and these out, when most_held or most_words are full."""
    by_lang: dict[str, _Counted] = defaultdict(_Counted)

    def poured() -> Iterator[dict]:
        for lang, counted in by_lang.items():
            if counted.number:
                for row in counted.subtrees(limits.depth):
                    yield {"lang": lang, **row}
        by_lang.clear()

    words = 0
    for batch in in_pieces(batches, 2, limits.piece):
        for lang, source, body in zip(*(c.to_pylist() for c in batch.columns)):
            if body:
                words += by_lang[lang].add(source, split_pieces(body, _TERM_BYTES, limits.piece))
                if words > limits.most_words or len(by_lang[lang].number) > limits.most_held:
                    yield from poured()
                    words = 0
    yield from poured()


def _deeper(batches, depth: int) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            of = tries.arrays(row)
            for below in tries.subtrees(row["path"], tries.terms_of(row), of["docs"], of["sizes"], of["sources"], of["counts"], depth):
                yield {"lang": row["lang"], **below}


def term_tries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """Subtrees of tasks' tries, staged: SUBTREE. No path is shared by more than most_terms of their terms, unless by repeats of one term.

    A path is a prefix of `depth` bytes or a shorter term. Heavy paths are lengthened by as many until none is left,
    so that no task has to merge a large part of all terms, whatever terms are like.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(name(lang_col).alias("lang"), F.xxhash64(name(source_col)).alias("source"), utf8(text_col).alias("body"))
    schema = _arrow(SUBTREE)
    now, depth, done = stage(texts.mapInArrow(lambda b: _batches(_counted(b, limits), schema), SUBTREE), "tries"), limits.depth, None
    while True:
        heavy = now.filter(F.length("path") == depth).groupBy("lang", "path").agg(F.sum("terms").alias("n")).filter(F.col("n") > limits.most_terms).select("lang", "path")
        heavy = stage(heavy, "heavy")
        if heavy.isEmpty():
            return now if done is None else done.unionByName(now)
        light = now.join(heavy, ["lang", "path"], "left_anti")
        done = light if done is None else done.unionByName(light)
        depth += limits.depth
        cut = now.join(heavy, ["lang", "path"], "left_semi").mapInArrow(lambda b: _batches(_deeper(b, limits.depth), schema), SUBTREE)
        now = stage(cut, "tries")


def _merged(batches, least: int, most: int) -> Iterator[dict]:
    """KEPT rows of subtrees that come in order of lang and path: terms that `least` documents have, in UTF-8 order."""
    key = root = None
    block: list = []

    def emit() -> dict:
        sources = [s for _, node in block for s in node.counts]
        counts = [n for _, node in block for n in node.counts.values()]
        return {"lang": key[0], "terms": [t.decode() for t, _ in block], "sizes": [len(node.counts) for _, node in block], "sources": sources, "counts": counts}

    def walked() -> Iterator[dict]:
        for term, node in tries.walk(root, key[1]):
            if node.docs >= least:
                block.append((term, node))
                if len(block) == most:
                    yield emit()
                    block.clear()

    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            for row in batch.slice(i, 64).to_pylist():
                if key != (row["lang"], row["path"]):
                    if key:
                        yield from walked()
                        if block and key[0] != row["lang"]:
                            yield emit()
                            block.clear()
                    key, root = (row["lang"], row["path"]), tries.Node()
                tries.merge(root, row)
    if key:
        yield from walked()
        if block:
            yield emit()


def kept_terms(subtrees: DataFrame, least: int = LEAST_DOCS, block: int = Limits.block) -> DataFrame:
    """KEPT, staged: blocks of terms that at least `least` documents of their lang have, with the sources' counts.

    Subtrees are dealt by ranges of (lang, path), so a task merges the tries of one range and walks it in order.
    """
    n = parallelism(subtrees.sparkSession)
    dealt = subtrees.repartitionByRange(n, "lang", "path").sortWithinPartitions("lang", "path")
    schema = _arrow(KEPT)
    return stage(dealt.mapInArrow(lambda b: _batches(_merged(b, least, block), schema, 8), KEPT), "kept")


def _scaled(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / of), exactly, by two digits of a long division; of: up to 2.9e14, and n + 2 at most that."""
    first, rest = np.divmod((n + 2) * 31_250, of)
    return 1 + first * 32_000 + rest * 32_000 // of


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compared(batches) -> Iterator[dict]:
    """FOUND rows of a task's blocks: for each lang sums by pair of sources (each pair once), and each source's TOP terms."""
    pairs: dict = {}
    best: dict = defaultdict(list)
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            terms, every, kept = row["terms"], row["all_sources"], row["kept"]
            known = np.array(row["all_hashes"], np.int64)
            by = np.argsort(known)
            at = by[np.searchsorted(known, row["sources"], sorter=by)]
            seen = np.zeros((len(terms), len(every)), np.int64)
            seen[np.repeat(np.arange(len(terms)), row["sizes"]), at] = row["counts"]
            p = _scaled(seen, np.array(row["all_counts"], np.int64) + 2 * kept)
            q = _scaled(seen.sum(1), np.int64(sum(row["all_counts"]) + 2 * kept))
            _, sums = pairs.setdefault(row["lang"], (every, np.zeros((len(every), len(every)), np.int64)))
            for j in range(len(every) - 1):
                sums[j, j + 1 :] += _apart(p[:, j : j + 1], p[:, j + 1 :]).sum(0)
            value = _apart(p, q[:, None])
            for j, source in enumerate(every):
                here = np.flatnonzero((seen[:, j] > 0) & (p[:, j] > q))
                here = here[np.argsort(-value[here, j], kind="stable")][:TOP]  # the walk's order stands in ties
                if len(here):
                    of = best[row["lang"], source]
                    of += [(int(value[h, j]), terms[h]) for h in here]
                    of.sort(key=lambda x: (-x[0], x[1].encode()))
                    del of[TOP:]
    for lang, (every, sums) in pairs.items():
        for i, j in zip(*np.triu_indices(len(every), 1)):
            yield {"part": "pair", "lang": lang, "source": every[i], "item": every[j], "value": int(sums[i, j])}
    for (lang, source), found in best.items():
        for value, term in found:
            yield {"part": "term", "lang": lang, "source": source, "item": term, "value": value}


def divergence_audit(docs: DataFrame, least: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """lang, source, part, item, value, rank.

    Terms are runs of ASCII letters, lower-cased, and of characters beyond ASCII, unchanged. p of a kept term is
    1 + floor(10**9 * (count + 2) / (N + 2 V)) for a source's count and N, q for the whole lang's. Part `pair`: for each
    other source of the lang the sum of floor((p - q)**2 / (p + q)) over kept terms of both sources' p. Part `term`: of a
    source's terms with p > q the ten with the largest such value. Ranks: by value, then item in UTF-8 order.

    Nulls in lang, source and text are ''; texts may be long, they are split in pieces. Every row is a document, repeated
    ones too. A lang without kept terms has pairs of value 0, a lang of one source none. Empty table: no rows. Pairs of a
    lang's sources are the result, so a task holds 8 bytes for each of them; all else is bounded by constants.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    subtrees = term_tries(docs, text_col, lang_col, source_col, limits)
    kept = kept_terms(subtrees, least, limits.block)
    unstage(subtrees)
    groups = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct().withColumn("hash", F.xxhash64("source"))
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    counted = cells.groupBy("lang", F.col("c.sources").alias("hash")).agg(F.sum("c.counts").alias("n"))
    groups = stage(groups.join(counted, ["lang", "hash"], "left").withColumn("n", F.coalesce("n", F.lit(0))), "groups")
    if not groups.groupBy("lang", "hash").count().filter("count > 1").isEmpty():
        raise ValueError("two sources of a lang have one hash")
    size = kept.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    sources = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n", "hash"))).alias("g"))  # a lang's sources
    sources = sources.join(size, "lang").select("lang", F.col("g.source").alias("all_sources"), F.col("g.n").alias("all_counts"), F.col("g.hash").alias("all_hashes"), "kept")
    schema = _arrow(FOUND)
    found = stage(kept.join(sources, "lang").mapInArrow(lambda b: _batches(_compared(b), schema), FOUND), "found")
    sums = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    pairs = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    terms = found.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    return ranked(pairs).union(ranked(terms).filter(F.col("rank") <= TOP))
