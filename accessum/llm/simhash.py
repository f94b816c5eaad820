"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are cut into BLOCKS blocks of bits. Two that differ in at most BLOCKS - 2 bits agree in two blocks at
least, so for each pair of blocks the fingerprints are rearranged with that pair in front and sorted by Gray rank:
those that share the front blocks' bit pattern follow one another and form an upper node. Below it a tree over the
Gray order keeps, for each run of fingerprints, the bits all of them share; two runs whose shared bits differ in more
than the allowed number of places are pruned with everything below them. Nodes above MOST_IN_NODE fingerprints are
taken apart instead by the patterns one bit away from each fingerprint, which is exact and meets in small groups.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import free_name, in_pieces, numbered, stage, unsent, unstage, without_rows
from .components import components

WORDS, SEED, MOST_DIFFERENT, BITS, BLOCKS = 3, 42, 2, 64, 4
MOST_IN_NODE, LEAF, SMALL = 4096, 32, 8
#: For similarity: words, Jaccard similarity, deviations above the mean of differing bits that still make a candidate,
#: the blocks of a lane, how many of them must agree, fingerprints tied together in a node up to which all their pairs
#: are candidates at once, and the lanes candidates are sought by and those they are picked by.
SIMILAR_WORDS, SIMILARITY, SLACK, FINE_BLOCKS, FRONT, TIED_AT_ONCE = 5, 0.8, 1.5, 8, 2, 32
SOUGHT, CHECKED = ("fp", "fp_more"), ("wide_0", "wide_1", "wide_2", "wide_3")


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of each run of `words` words, lower-cased in A-Z and joined by spaces; of all words where they are fewer."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxh64_intdigest(joined, SEED)] if found else []
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]


def remixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Hashes as they are for lane 0, else as independent ones."""
    if not lane:
        return hashes
    x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * lane) + np.uint64(lane)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def fingerprints_of(texts: list[bytes], lanes: tuple[tuple[int, int], ...] = ((WORDS, 0),)) -> np.ndarray:
    """A uint64 for each text and lane (words of a shingle, number): bit i is 1 where over half the text's shingle hashes
    have it; no word: 0. A lane of 0 words is the hash of all words."""
    hashes = {w: [shingle_hashes(t, w or len(t)) for t in texts] for w in {w for w, _ in lanes}}
    return np.stack([_majorities(hashes[w], number) for w, number in lanes], 1)


def _majorities(hashes: list[list[int]], lane: int) -> np.ndarray:
    counts = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        flat = remixed(np.concatenate([np.array(hashes[i], np.uint64) for i in some]), lane)
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        ones = np.zeros((len(some), BITS), np.int64)
        for at in range(0, len(some), 256):  # bits of a few texts at a time
            a, b = starts[at], starts[at + 256] if at + 256 < len(some) else len(flat)
            for lo in range(a, b, 1 << 18):  # and of a long text in pieces
                hi = min(b, lo + (1 << 18))
                bits = np.unpackbits(flat[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                first = max(int(np.searchsorted(starts, lo, "right")) - 1, at)
                last = int(np.searchsorted(starts, hi, "left"))
                cuts = np.maximum(starts[first:last], lo) - lo
                ones[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        set_bits = 2 * ones > counts[some][:, None]
        out[some] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, lanes: dict[str, tuple[int, int]], id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, row_id (column row, else the place in docs), and a long for each lane: its 64 bits, signed. Null text: as empty."""
    kind, names, wanted = docs.schema[id_col].dataType.simpleString(), list(lanes), tuple(lanes.values())

    def run(batches):
        for batch in in_pieces(batches, 1, 1 << 20):
            fps = fingerprints_of(batch.column(1).to_pylist(), wanted).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(len(names)))], ["key", *names])

    key = F.struct(F.col(id_col).alias("doc_id"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"))
    texts = docs.select(key.alias("key"), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("body"))
    return texts.mapInArrow(run, f"key struct<doc_id:{kind},row_id:bigint>, " + ", ".join(f"{n} bigint" for n in names)).select("key.*", *names)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The places of 64-bit patterns in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code ^ code >> np.uint64(shift)
    return code


def _placed(fp: np.ndarray, blocks: int = BLOCKS, front: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each choice of `front` of the blocks, and each fingerprint: the node (which blocks, and the pattern of its
    rank's front), the fingerprint's place in fp, and the Gray rank of its bits with those blocks moved to the front."""
    width = BITS // blocks
    nodes, ranks = [], []
    parts = [fp >> np.uint64(BITS - width * (b + 1)) & np.uint64((1 << width) - 1) for b in range(blocks)]
    for i, chosen in enumerate(combinations(range(blocks), front)):
        moved = np.zeros_like(fp)
        for block in (*chosen, *(b for b in range(blocks) if b not in chosen)):
            moved = moved << np.uint64(width) | parts[block]
        ranks.append(gray_rank(moved))
        nodes.append(np.uint64(i << width * front) | ranks[-1] >> np.uint64(BITS - width * front))
    return np.concatenate(nodes), np.tile(np.arange(len(fp)), len(ranks)), np.concatenate(ranks)


def _place(batches):
    """node, rank, fp: where each fingerprint stands for each pair of blocks."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        node, at, rank = _placed(fp)
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (node, rank, fp[at])], ["node", "rank", "fp"])


def _place_similar(batches):
    """node and the rows' own columns: where the fingerprints of both SOUGHT lanes stand for each choice of fine blocks."""
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        for lane in range(len(SOUGHT)):
            node, at, _ = _placed(batch.column(SOUGHT[lane]).to_numpy().view(np.uint64), FINE_BLOCKS, FRONT)
            kept = [c.take(pa.array(at)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array((node ^ np.uint64(lane << 62)).view(np.int64)), *kept], ["node", *batch.schema.names])


def _at_nodes(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_place_similar, ", ".join(["node bigint", *(f"{n} {t}" for n, t in texts.dtypes)]))


def _near(v: np.ndarray, i: np.ndarray, j: np.ndarray, most: int, most_checked: int) -> np.ndarray:
    """Whether fingerprints i and j differ in `most` bits of the first lane and most_checked bits of the others at most."""
    first = np.bitwise_count(v[i, 0] ^ v[j, 0]) <= most
    if v.shape[1] > 1:
        at = np.flatnonzero(first)
        first[at] = np.bitwise_count(v[i[at], 1:] ^ v[j[at], 1:]).sum(1, dtype=np.int64) <= most_checked
    return first


def _tree_links(v: np.ndarray, most: int, most_checked: int = 0, pairs: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest-placed member tied to it) over fingerprints v (rows of lanes) in Gray order of the first lane: a
    forest of links. Some of the pairs that tie them, as they were compared, are added to pairs.

    From the root down, pairs of runs are kept while the bits that each run's members share differ in `most` places at
    most; what is left at the leaves is compared one by one.
    """
    n = len(v)
    size = LEAF * (1 << max(0, -(-n // LEAF) - 1).bit_length())
    full = np.concatenate([v, np.repeat(v[-1:], size - n, 0)])
    ands, ors = [np.bitwise_and.reduce(full[:, 0].reshape(-1, LEAF), 1)], [np.bitwise_or.reduce(full[:, 0].reshape(-1, LEAF), 1)]
    while len(ands[-1]) > 1:
        ands.append(ands[-1][::2] & ands[-1][1::2])
        ors.append(ors[-1][::2] | ors[-1][1::2])
    a = b = np.zeros(1, np.int64)
    for level in range(len(ands) - 1, -1, -1):
        if level < len(ands) - 1:
            a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
            a, b = a[a <= b], b[a <= b]
        shared = ~(ands[level] ^ ors[level])
        apart = np.bitwise_count((ands[level][a] ^ ands[level][b]) & shared[a] & shared[b])
        a, b = a[apart <= most], b[apart <= most]
    root = np.arange(size)
    inside = np.arange(LEAF)
    order = np.argsort(b - a, kind="stable")  # runs with themselves first, then with their neighbours
    for at in range(0, len(a), 64):
        i, j = a[order[at : at + 64]], b[order[at : at + 64]]
        runs = root.reshape(-1, LEAF)
        low, high = runs.min(1), runs.max(1)
        apart = (low[i] != high[j]) | (high[i] != low[j])  # else all of both are tied already
        i, j = i[apart, None, None] * LEAF + inside[:, None], j[apart, None, None] * LEAF + inside[None, :]
        i, j = np.broadcast_arrays(i, j)
        open_ = (i < j) & (j < n) & (root[i] != root[j])
        i, j = i[open_], j[open_]
        near = _near(full, i, j, most, most_checked)
        if pairs is not None:
            some = np.unique(np.maximum(root[i[near]], root[j[near]]), return_index=True)[1]
            pairs.append((i[near][some], j[near][some]))
        _tie(root, i[near], j[near])
    root = root[:n]
    tied = np.flatnonzero(root != np.arange(n))
    return tied, root[tied]


def _tie(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give all that i and j tie together one root, the smallest."""
    while len(i):
        a, b = root[i], root[j]
        i, j, a, b = (x[a != b] for x in (i, j, a, b))
        if not len(i):
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def _node_links(most: int = MOST_DIFFERENT, most_checked: int = 0, most_in_node: int = MOST_IN_NODE):
    """Links (u, v) within upper nodes; rows (node, lanes) come sorted by node, and a node may span batches.

    Fingerprints of nodes above most_in_node come out unlinked, with v null; such a node is never held whole.
    """

    def out(u: np.ndarray, v: np.ndarray | None):
        ends = pa.nulls(len(u), pa.int64()) if v is None else pa.array(np.ascontiguousarray(v).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u).view(np.int64)), ends], ["u", "v"])

    def links(node: np.ndarray, v: np.ndarray):
        edges = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.concatenate([edges, [len(node)]]))
        left, right = [], []
        small = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, SMALL):
            i = np.flatnonzero((node[d:] == node[:-d]) & small[d:])
            i = i[_near(v, i, i + d, most, most_checked)]
            left.append(v[i, 0])
            right.append(v[i + d, 0])
        for a, n in zip(edges[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            part = v[a : a + n]
            if n > most_in_node:
                yield out(part[:, 0], None)
                continue
            part = part[np.argsort(gray_rank(part[:, 0]), kind="stable")]
            i, j = _tree_links(part, most, most_checked)
            left.append(part[i, 0])
            right.append(part[j, 0])
        found = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        yield out(found[:, 0], found[:, 1])

    def run(batches):
        rest, crowded = None, None
        for batch in batches:
            if batch.num_rows:
                node = batch.column(0).to_numpy()
                v = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], 1)
                if crowded is not None:  # the rest of a node that has been given up
                    n = int(np.argmax(node != crowded)) if (node != crowded).any() else len(node)
                    yield out(v[:n, 0], None)
                    node, v = node[n:], v[n:]
                    if not len(node):
                        continue
                    crowded = None
                if rest:
                    node, v = np.concatenate([rest[0], node]), np.concatenate([rest[1], v])
                other = np.flatnonzero(node[::-1] != node[-1])
                cut = len(node) - int(other[0]) if len(other) else 0
                if cut:
                    yield from links(node[:cut], v[:cut])
                rest = node[cut:], v[cut:]
                if len(rest[0]) > most_in_node:
                    yield out(rest[1][:, 0], None)
                    rest, crowded = None, node[-1]
        if rest and len(rest[0]):
            yield from links(*rest)

    return run


def near_links(fps: DataFrame, most_in_node: int = MOST_IN_NODE) -> DataFrame:
    """u, v: links of distinct fingerprints fps.fp that tie together all that differ in MOST_DIFFERENT bits or fewer.

    Every link joins two such fingerprints; a chain of links joins any two of them.
    """
    width = 2 * (BITS // BLOCKS)
    placed = fps.select("fp").mapInArrow(_place, "node bigint, rank bigint, fp bigint")
    sizes = placed.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("node", "of")
    shared = stage(placed.join(unsent(sizes), F.col("node") == F.col("of")).drop("of"), "nodes")
    # ranks of one node share their front, so its sign doesn't disturb their order
    small = shared.filter(F.col("n") <= most_in_node).repartition("node").sortWithinPartitions("node", "rank")
    in_tree = small.select("node", "fp").mapInArrow(_node_links(most_in_node=most_in_node), "u bigint, v bigint")
    behind = F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", 1)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(width)])
    balls = shared.filter(F.col("n") > most_in_node).select("node", "fp", F.explode(flips).alias("flip"), behind.alias("behind")).select("node", "fp", F.col("behind").bitwiseXOR(F.col("flip")).alias("ball"))
    least = balls.groupBy("node", "ball").agg(F.min("fp").alias("least"))  # a ball holds width + 1 fingerprints at most
    in_ball = balls.join(unsent(least), ["node", "ball"]).filter("fp != least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    return in_tree.unionByName(in_ball)


def _node_candidates(most: int, most_checked: int, most_in_node: int):
    """Candidate pairs (u, v) of text ids within nodes, or where many are tied together some of them (many is true then)
    and each of the many with v null; rows (node, text_id, lanes) come sorted by node, and a node may span batches.

    All members of a node above most_in_node are such many; it is never held whole.
    """

    def out(u, v, many: bool):
        u = np.ascontiguousarray(u)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()) if v is None else pa.array(np.ascontiguousarray(v)), pa.array(np.full(len(u), many))], ["u", "v", "many"])

    def links(node: np.ndarray, ids: np.ndarray, v: np.ndarray, crowded: int | None):
        edges = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.concatenate([edges, [len(node)]]))
        little = (sizes <= SMALL) & (node[edges] != crowded if crowded is not None else True)
        all_u, all_v, some_u, some_v, many = [], [], [], [], []
        small = np.repeat(little, sizes)
        for d in range(1, SMALL):
            i = np.flatnonzero((node[d:] == node[:-d]) & small[d:])
            i = i[_near(v, i, i + d, most, most_checked)]
            all_u.append(ids[i])
            all_v.append(ids[i + d])
        for a, n in zip(edges[~little].tolist(), sizes[~little].tolist()):
            whole = n <= most_in_node and node[a] != crowded
            for lo in range(a, a + n, most_in_node):
                hi = min(lo + most_in_node, a + n)
                order = np.argsort(gray_rank(v[lo:hi, 0]), kind="stable")
                part, named, pairs = v[lo:hi][order], ids[lo:hi][order], []
                tied, to = _tree_links(part, most, most_checked, pairs)
                root = np.arange(len(part))
                root[tied] = to
                of, count = np.unique(root, return_counts=True)
                big = np.isin(root, of[count > TIED_AT_ONCE]) if whole else np.full(len(part), True)
                if whole:
                    two = tied[np.isin(to, of[count == 2])]
                    all_u.append(named[two])
                    all_v.append(named[root[two]])
                    for k in of[(count > 2) & (count <= TIED_AT_ONCE)].tolist():
                        members = np.flatnonzero(root == k)
                        i, j = (members[x] for x in np.triu_indices(len(members), 1))
                        near = _near(part, i, j, most, most_checked)
                        all_u.append(named[i[near]])
                        all_v.append(named[j[near]])
                if big.any():
                    many.append(named[big])
                    i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
                    some_u.append(named[i[big[i]]])
                    some_v.append(named[j[big[i]]])
        for us, vs, flag in ((all_u, all_v, False), (some_u, some_v, True)):
            if us:
                found = np.unique(np.sort(np.stack([np.concatenate(us), np.concatenate(vs)], 1), 1), axis=0)
                yield out(found[:, 0], found[:, 1], flag)
        if many:
            yield out(np.unique(np.concatenate(many)), None, True)

    def run(batches):
        rest, crowded = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[2:]], 1)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            node = now[0]
            other = np.flatnonzero(node[::-1] != node[-1])
            cut = len(node) - int(other[0]) if len(other) else 0
            if cut:
                yield from links(*(x[:cut] for x in now), crowded)
            rest = [x[cut:] for x in now]
            if len(rest[0]) > most_in_node:
                crowded = int(node[-1])
                full = len(rest[0]) // most_in_node * most_in_node
                yield from links(*(x[:full] for x in rest), crowded)
                rest = [x[full:] for x in rest]
        if rest is not None and len(rest[0]):
            yield from links(*rest, crowded)

    return run


def _first_meeting(node: int, apart: np.ndarray) -> np.ndarray:
    """Whether a node is the first one where pairs meet; apart: the bits in which their SOUGHT lanes differ."""
    width = BITS // FINE_BLOCKS
    agree = np.zeros(apart.shape, np.int64)
    for b in range(FINE_BLOCKS):
        agree |= (apart >> np.uint64(BITS - width * (b + 1)) & np.uint64((1 << width) - 1) == 0).astype(np.int64) << b
    lane, chosen = node >> 62 & 1, list(combinations(range(FINE_BLOCKS), FRONT))[(node & (1 << 62) - 1) >> width * FRONT]
    first = agree[:, lane] & (1 << chosen[-1] + 1) - 1 == sum(1 << b for b in chosen)
    for earlier in range(lane):
        first &= np.bitwise_count(agree[:, earlier]) < FRONT
    return first


def _counts(shingles: np.ndarray) -> bytes | None:
    """How many of a set's hashes have each first byte, a byte for each; None where one is over 255."""
    counts = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _may_be_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with these counts (a row of 256 for each; all zero if unknown) may have the given Jaccard similarity.

    Sets share no more elements than the lesser count of each first byte, so none that has it is denied.
    """
    sizes, shared = (x.sum(1, dtype=np.int64) for x in (np.concatenate([a, b], 1), np.minimum(a, b)))
    return (shared * (1 + similarity) >= similarity * sizes - 1e-6) | ~a.any(1) | ~b.any(1)


def _block_pairs(most: int, most_checked: int, similarity: float):
    """Candidate pairs (u, v) of text ids with different roots, a block of a node against a block: rows (node, low, high,
    block, text_id, root, counts, lanes) come sorted by the first four. A pair that meets in several nodes is given once,
    and none whose counts of shingles rule the similarity out."""

    def compared(block, ids, root, counts, v, node, low, high):
        sought, v = v[:, : len(SOUGHT)], np.delete(v, slice(1, len(SOUGHT)), 1)
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for at in range(0, len(left), 128):
            i, j = np.broadcast_arrays(left[at : at + 128, None], right[None, :])
            apart = root[i] != root[j]
            if low == high:
                apart &= i < j
            i, j = i[apart], j[apart]
            near = np.flatnonzero(_near(v, i, j, most, most_checked))
            i, j = i[near], j[near]
            once = _first_meeting(node, sought[i] ^ sought[j])
            i, j = i[once], j[once]
            may = [_may_be_similar(counts[i[k : k + 4096]], counts[j[k : k + 4096]], similarity) for k in range(0, len(i), 4096)]
            if may and (may := np.concatenate(may)).any():
                u, w = ids[i[may]], ids[j[may]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, w)), pa.array(np.maximum(u, w))], ["u", "v"])

    def known(counts: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(counts.fill_null(bytes(256)).to_pylist()), np.uint8).reshape(-1, 256)

    def run(batches):
        rest = None
        for batch in _and_none(batches):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                now = [np.stack([c.to_numpy() for c in batch.columns[:3]], 1), *(batch.column(i).to_numpy() for i in (3, 4, 5)), known(batch.column(6)), np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[7:]], 1)]
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            if rest is None:
                continue
            edges = np.flatnonzero(np.concatenate([[True], (rest[0][1:] != rest[0][:-1]).any(1)])).tolist()
            if batch is None:
                edges.append(len(rest[0]))
            for a, b in zip(edges, edges[1:]):
                yield from compared(*(x[a:b] for x in rest[1:]), *rest[0][a].tolist())
            rest = [x[edges[-1] :] for x in rest]

    return run


def _and_none(batches):
    yield from batches
    yield None


def _mixed_nodes(rooted: DataFrame) -> DataFrame:
    """For each node with more than one root: at, common (its commonest root), n (members), most (members of that root)."""
    by_root = rooted.groupBy("node", "root").agg(F.count("*").alias("n"))
    nodes = by_root.groupBy(F.col("node").alias("at")).agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    return nodes.select("at", F.col("most.root").alias("common"), "n", F.col("most.n").alias("most")).filter("n > most")


def _all_pairs(rooted: DataFrame, most: int, most_checked: int, similarity: float, most_in_node: int) -> DataFrame:
    """u, v: all pairs of texts (node, text_id, root, counts, lanes) with different roots that meet in a node and are
    near, each once, but for those that the counts of their shingles rule out.

    A node is cut into blocks of half of most_in_node, those of its commonest root apart from the others, and each
    block of the others is compared with all. No node is left out and none is held whole.
    """
    half = max(1, most_in_node // 2)
    blocks = lambda n: F.ceil(n / F.lit(half))
    nodes = _mixed_nodes(rooted).select("at", "common", blocks(F.col("n") - F.col("most")).alias("others"), blocks(F.col("most")).alias("commons"))
    own = F.when(F.col("root") == F.col("common"), F.col("others") + F.pmod(F.xxhash64("text_id"), "commons")).otherwise(F.pmod(F.xxhash64("text_id"), "others"))
    last = F.when(F.col("root") == F.col("common"), F.col("others") - 1).otherwise(F.col("others") + F.col("commons") - 1)
    dealt = rooted.join(unsent(nodes), F.col("node") == F.col("at")).withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = dealt.select("node", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "text_id", "root", "counts", *SOUGHT, *CHECKED)
    dealt = dealt.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high")
    return dealt.mapInArrow(_block_pairs(most, most_checked, similarity), "u bigint, v bigint")


def shingle_sets(table: DataFrame, row: str, wanted: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """text_id, shingles, counts: the distinct shingle hashes of the rows of a numbered() table that wanted (text_id,
    row_id) names, and how many of them have each first byte."""

    def run(batches):
        for batch in in_pieces(batches, 1, 1 << 20):
            sets = [np.unique(np.array(shingle_hashes(b.as_py(), words), np.uint64)) for b in batch.column(1)]
            shingles = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), shingles, pa.array([_counts(x) for x in sets], pa.binary())], ["text_id", "shingles", "counts"])

    texts = table.select(F.col(row).alias("row"), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("body"))
    named = texts.join(wanted.hint("shuffle_hash"), F.col("row") == F.col("row_id")).select("text_id", "body")
    return named.mapInArrow(run, "text_id bigint, shingles array<bigint>, counts binary")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have the given Jaccard similarity or more."""
    a, b = (sets.select(F.col("text_id").alias(f"{x}_id"), F.col("shingles").alias(x)) for x in "ab")
    held = pairs.join(unsent(a), F.col("u") == F.col("a_id")).join(unsent(b), F.col("v") == F.col("b_id"))
    both = F.size(F.array_intersect("a", "b"))
    return held.filter(F.try_divide(both, F.size("a") + F.size("b") - both) >= similarity).select("u", "v")


def similar_links(texts: DataFrame, known: DataFrame, sets_of, similarity: float, most: int, most_checked: int, most_in_node: int = MOST_IN_NODE) -> DataFrame:
    """u, v: links of texts (text_id, SOUGHT and CHECKED lanes) of the given similarity, compared exactly by the shingles
    (and their counts) that sets_of gives for a table of text ids.

    Candidates agree in FRONT of FINE_BLOCKS blocks of a SOUGHT lane, and differ in `most` bits of the first lane and
    most_checked bits of the CHECKED ones at most. Links and known ones (u, v) together tie all candidates of that
    similarity: where many texts are tied together in a node, or a node holds over most_in_node, some pairs are checked
    first, and then all pairs that those and known ones don't tie, block by block.
    """
    lanes = (*SOUGHT, *CHECKED)
    dealt = _at_nodes(texts.select("text_id", *lanes)).drop(*SOUGHT[1:]).repartition("node").sortWithinPartitions("node")
    out = stage(dealt.mapInArrow(_node_candidates(most, most_checked, most_in_node), "u bigint, v bigint, many boolean"), "similar")
    some = out.filter("many and v is not null").groupBy("u").agg(F.array_distinct(F.array(F.min("v"), F.max("v"))).alias("vs"))
    pairs = stage(out.filter("not many").select("u", "v").unionByName(some.select("u", F.explode("vs").alias("v"))).distinct(), "pairs")
    many = stage(out.filter("v is null").select(F.col("u").alias("text_id")).distinct(), "open")
    sets = stage(sets_of(pairs.select(F.col("u").alias("text_id")).union(pairs.select("v")).union(many).distinct()), "shingles")
    found = stage(_similar(pairs, sets, similarity), "found")
    if many.isEmpty():
        for done in (out, pairs, many, sets):
            unstage(done)
        return found
    left = texts.join(unsent(many.withColumnRenamed("text_id", "of")), F.col("text_id") == F.col("of"), "left_semi")
    roots = components(known.unionByName(found)).withColumnRenamed("node", "of")
    left = left.join(unsent(roots), F.col("text_id") == F.col("of"), "left").withColumn("root", F.coalesce("root", "text_id")).drop("of")
    left = left.join(unsent(sets.select(F.col("text_id").alias("of"), "counts")), F.col("text_id") == F.col("of"), "left").select("text_id", "root", "counts", *lanes)
    at_nodes = stage(_at_nodes(left), "many")
    rest = stage(_all_pairs(at_nodes, most, most_checked, similarity, most_in_node), "rest")
    last = stage(_similar(rest, sets, similarity), "last")
    for done in (out, pairs, many, sets, rest, at_nodes):
        unstage(done)
    return found.unionByName(last)


def similar_groups(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, row_id, fingerprint, component_id, first: as near_groups(), with texts linked by similarity too.

    Texts are linked whose sets of shingles of `words` words have the given Jaccard similarity or more, compared
    exactly. Candidates are sought by fingerprints: their CHECKED lanes differ in no more bits than those of texts of
    that similarity do on average, and SLACK deviations more (sets of similarity s differ in arccos(2 s / (1 + s)) / pi
    of the bits), and they agree in two blocks of a SOUGHT lane, of WORDS words, which fewer edits reach. Texts of
    different words are compared each by its own lanes. Links of near_links() are among the result.
    Nulls, ties and repeated rows: as in near_groups(). row: docs' column of row numbers, if docs is numbered() already.
    """
    if row is None:
        docs, row = numbered(docs)
    n, share = len(CHECKED) * BITS, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most_checked = int(n * share + SLACK * np.sqrt(n * share * (1 - share)))
    lanes = {"text_id": (0, 0)} | {name: (WORDS, i) for i, name in enumerate(SOUGHT)} | {name: (words, i) for i, name in enumerate(CHECKED)}
    rows = stage(fingerprints(docs, lanes, id_col, text_col, row), "fingerprints")
    texts = stage(rows.groupBy("text_id").agg(F.min("row_id").alias("row_id"), *[F.min(c).alias(c) for c in (*SOUGHT, *CHECKED)]), "classes")
    heads = stage(texts.groupBy(F.col("fp").alias("of")).agg(F.min("text_id").alias("head")), "heads")
    near = stage(near_links(heads.select(F.col("of").alias("fp"))), "near")
    ends = [heads.select(F.col("of").alias(f"{x}_of"), F.col("head").alias(f"{x}_head")) for x in "uv"]
    known = near.join(unsent(ends[0]), F.col("u") == F.col("u_of")).join(unsent(ends[1]), F.col("v") == F.col("v_of")).select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    known = stage(known.unionByName(texts.join(unsent(heads), F.col("fp") == F.col("of")).filter("text_id != head").select(F.col("text_id").alias("u"), F.col("head").alias("v"))), "known")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = texts.select("text_id", "row_id").join(unsent(ids.withColumnRenamed("text_id", "of")), F.col("text_id") == F.col("of"), "left_semi")
        return shingle_sets(docs, row, wanted, words, text_col)

    return _named(rows, similar_links(texts, known, sets_of, similarity, BITS // 4, most_checked).unionByName(known), "text_id")


def near_groups(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row_id, fingerprint (16 hexadecimal digits), component_id, first (the row that stands for its group).

    Rows whose fingerprints differ in MOST_DIFFERENT bits or fewer are linked; component_id is the smallest id that
    links reach, the row's own included. Null text and texts without words: fingerprint zero, linked like any other.
    Null ids are never the smallest unless a group has no other (component_id null then). first is true for one row of
    each group: the one of the smallest id, and of these the first in the table. Empty table: no rows.
    """
    rows = stage(fingerprints(docs, {"fp": (words, 0)}, id_col, text_col), "fingerprints")
    return _named(rows, near_links(rows.select("fp").distinct()))


def _named(rows: DataFrame, links: DataFrame, by: str = "fp") -> DataFrame:
    """Rows (doc_id, row_id, fp, by) with the component that the links of their `by` give them."""
    classes = rows.groupBy(by).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("least"))
    roots = components(links)
    rooted = classes.join(unsent(roots), F.col(by) == F.col("node"), "left").select(by, "least", F.coalesce("root", by).alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("head")).withColumnRenamed("root", "of")
    heads = stage(heads, "heads")  # a join with a table can be split where one group is large
    named = stage(rooted.join(unsent(heads), F.col("root") == F.col("of")).select(F.col(by).alias("same"), "head"), "named")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(unsent(named), F.col(by) == F.col("same")).select(
        "doc_id", "row_id", digits.alias("fingerprint"), F.col("head.doc_id").alias("component_id"), (F.col("row_id") == F.col("head.row_id")).alias("first")
    )


def drop_near_copies(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of similar_groups(); all columns stay."""
    table, row = numbered(docs)
    gone = similar_groups(table, words, similarity, id_col, text_col, row).filter(~F.col("first")).select(F.col("row_id").alias(free_name("_gone", table)))
    return without_rows(table, row, gone)
