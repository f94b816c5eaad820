"""Radix tries over byte strings, with a counter for each source at the leaves.

An edge carries all bytes that the terms below it share. Tries are dealt into subtrees by prefix, subtrees of one prefix
merge node by node, and are walked in byte order, which is UTF-8's code point order. A subtree travels as a row of a few
byte columns: its nodes in preorder, in which leaves come in byte order, and the leaves' counters in that order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np

#: Columns of a subtree's row beside its path: number of terms; nodes' label lengths, labels, numbers of kids, and
#: whether a term ends there; documents and number of sources of each term; sources and counts, one run for all terms.
ARRAYS = "terms int, lengths binary, letters binary, kids binary, ends binary, docs binary, sizes binary, sources binary, counts binary"
_KINDS = {"lengths": np.int32, "kids": np.int32, "ends": np.uint8, "docs": np.int64, "sizes": np.int32, "sources": np.int64, "counts": np.int64}


class Node:
    """An edge's bytes and what is below: kids by first byte; where a term ends, counts by source, and docs, documents that have it."""

    __slots__ = ("label", "kids", "docs", "counts")

    def __init__(self, label: bytes = b""):
        self.label, self.kids, self.docs, self.counts = label, None, 0, None


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def down(node: Node, key: bytes) -> Node:
    """The node below at which key ends, made where there is none; edges that part from it are split."""
    at, end = 0, len(key)
    while at < end:
        if node.kids is None:
            node.kids = {}
        first = key[at]
        kid = node.kids.get(first)
        if kid is None:
            kid = node.kids[first] = Node(key[at:])
            return kid
        if not key.startswith(kid.label, at):
            n = _shared(kid.label, key[at:])
            upper = node.kids[first] = Node(kid.label[:n])
            kid.label = kid.label[n:]
            upper.kids = {kid.label[0]: kid}
            kid = upper
        node, at = kid, at + len(kid.label)
    return node


def walk(node: Node, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
    """Terms below a node of that prefix, its own label left out, in byte order."""
    todo = [(prefix, node)]
    while todo:
        prefix, node = todo.pop()
        if node.counts is not None:
            yield prefix, node
        if node.kids:
            todo.extend((prefix + node.kids[first].label, node.kids[first]) for first in sorted(node.kids, reverse=True))


def _planted(terms: list[bytes]) -> Node:
    root = Node()
    for term in terms:
        down(root, term).counts = True
    return root


def subtrees(prefix: bytes, terms: list[bytes], docs: np.ndarray, sizes: np.ndarray, sources: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[dict]:
    """Rows of the tries of terms, in byte order, by their first depth bytes; shorter terms are alone. Each path begins with prefix.

    docs and sizes: for each term; sources and counts: for all terms, sizes of each.
    """
    ends, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
    for head, group in groupby(terms, lambda t: t[:depth]):
        below = [t[depth:] for t in group]
        hi = lo + len(below)
        part = {"docs": docs[lo:hi], "sizes": sizes[lo:hi], "sources": sources[ends[lo] : ends[hi]], "counts": counts[ends[lo] : ends[hi]]}
        labels, kids, stops, todo = [], [], [], [_planted(below)]
        while todo:
            node = todo.pop()
            labels.append(node.label)
            stops.append(node.counts is not None)
            of = node.kids
            kids.append(len(of) if of else 0)
            if of:
                todo.extend([of[k] for k in sorted(of, reverse=True)])
        part |= {"lengths": list(map(len, labels)), "kids": kids, "ends": stops}
        yield {"path": prefix + head, "terms": hi - lo, "letters": b"".join(labels)} | {k: np.asarray(v, _KINDS[k]).tobytes() for k, v in part.items()}
        lo = hi


def arrays(row: dict) -> dict[str, np.ndarray]:
    """A row's byte columns as numbers."""
    return {k: np.frombuffer(row[k], kind) for k, kind in _KINDS.items()}


def _nodes(row: dict, of: dict[str, np.ndarray]) -> Iterator[tuple[bytes, int, int]]:
    at, letters = 0, row["letters"]
    for n, kids, end in zip(of["lengths"].tolist(), of["kids"].tolist(), of["ends"].tolist()):
        yield letters[at : at + n], kids, end
        at += n


def terms_of(row: dict) -> list[bytes]:
    """A subtree's terms, without its path, in byte order."""
    out: list[bytes] = []
    above: list[list] = []  # prefix and kids left
    for label, kids, end in _nodes(row, arrays(row)):
        while above and not above[-1][1]:
            above.pop()
        prefix = label
        if above:
            above[-1][1] -= 1
            prefix = above[-1][0] + label
        if end:
            out.append(prefix)
        if kids:
            above.append([prefix, kids])
    return out


def merge(root: Node, row: dict) -> None:
    """A subtree's nodes and counters are added below root, which stands for its path."""
    of = arrays(row)
    docs, sizes, sources, counts = (of[k].tolist() for k in ("docs", "sizes", "sources", "counts"))
    above: list[list] = []  # node and kids left
    leaf = at = 0
    for label, kids, end in _nodes(row, of):
        while above and not above[-1][1]:
            above.pop()
        if above:
            above[-1][1] -= 1
            node = down(above[-1][0], label)
        else:
            node = root
        if end:
            node.docs += docs[leaf]
            to = at + sizes[leaf]
            if node.counts is None:
                node.counts = dict(zip(sources[at:to], counts[at:to]))
            else:
                known = node.counts
                for source, n in zip(sources[at:to], counts[at:to]):
                    known[source] = known.get(source, 0) + n
            leaf, at = leaf + 1, to
        if kids:
            above.append([node, kids])
