import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from accessum.llm import substrings


def brute(rows, n=100):
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        mark = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                mark[i] += 1
                mark[i + n] -= 1
            else:
                seen.add(b[i : i + n])
        gone = np.cumsum(mark)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, substrings.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def planted(seed):
    r = np.random.default_rng(seed)
    letters = lambda n, of="abc": "".join(r.choice(list(of), n))
    parts = [letters(n) for n in (150, 99, 100, 101, 300, 1000)]
    rows = [(i, "".join(parts[r.integers(6)] if r.random() < 0.6 else letters(r.integers(1, 80), "abcd ") for _ in range(r.integers(0, 8)))) for i in range(150)]
    rows += [(1000, None), (1001, "a" * 700), (1002, "ab" * 500), (1003, "a" * 350 + "b"), (1004, parts[3]), (1005, letters(700_000, "ab")), (1006, "é" * 200)]
    return rows + [(1007, rows[-2][1][5000:680_000]), (1008, "x" + rows[-2][1][600_000:600_130])]


@pytest.mark.parametrize("much_used", [64, 2])
def test_planted_repeats(spark, monkeypatch, much_used):
    """much_used 2 takes nearly every trigger text that repeats apart into strings; results must not change."""
    found = substrings.much_used_triggers
    monkeypatch.setattr(substrings, "much_used_triggers", lambda docs: found(docs, 20_000, much_used))
    rows = planted(much_used)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_tables(small):
    rows = sorted(map(tuple, small.select("doc_id", "text").collect()))
    assert result(small) == brute(rows)


def test_odd_rows(odd):
    """Rows alike in id stand in the table's order; null ids come first."""
    placed = odd.select("doc_id", "text", F.monotonically_increasing_id().alias("r")).collect()
    rows = [(r.doc_id, r.text) for r in sorted(placed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.r))]
    assert result(odd) == brute(rows)


def test_flushes_and_slices(spark, monkeypatch):
    data = np.frombuffer(b"".join(np.random.default_rng(1).bytes(50) * 7 for _ in range(30)), np.uint8)
    h, c, lo, n = substrings.phrases(data, np.array([0]), np.array([len(data)]), np.empty(0, np.uint64))
    assert n.sum() == len(data) - 99 and (np.diff(lo) > 0).all()
    for at in (0, 100, 3000):
        one = substrings.Hashes(data, 0)
        assert one.of(np.array([at]), np.array([at + 40]))[0] == one.each(40)[at]


@pytest.mark.parametrize("most", [4096, 3, 1])
def test_crowded_triggers(spark, monkeypatch, most):
    """One passage in very many surroundings: its trigger texts are taken apart into strings, and results don't change."""
    r = np.random.default_rng(most)
    letters = lambda n: "".join(r.choice(list("abcdef "), n))
    passage = letters(150)
    rows = [(i, letters(r.integers(0, 90)) + passage[r.integers(0, 40) :] + letters(r.integers(0, 90))) for i in range(200)] + [(500 + i, passage[:130]) for i in range(50)]
    monkeypatch.setattr(substrings, "MOST_A_TRIGGER", most)
    monkeypatch.setattr(substrings, "much_used_triggers", lambda docs: np.empty(0, np.uint64))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == brute(rows)


def test_suffix_arrays():
    r = np.random.default_rng(4)
    data = np.frombuffer(bytes(r.choice(list(b"ab"), 700).tolist()) * 2 + b"\0" * 40 + bytes(150), np.uint8)
    rank = substrings.suffix_ranks(data, 64)
    text = data.tobytes()
    heads = [text[i : i + 64].ljust(64, b"\0") for i in range(len(text))]
    place = {h: i for i, h in enumerate(sorted(set(heads)))}
    assert all((place[heads[i]] < place[heads[j]]) == (rank[i] < rank[j]) for i in range(0, len(text), 7) for j in range(0, len(text), 11) if 0 not in data[i : i + 64] and 0 not in data[j : j + 64])
    starts = r.permutation(len(text) - 99)
    order, first = substrings.corpus_order(data, starts)
    strings = [text[starts[k] : starts[k] + 100] for k in order]
    assert strings == sorted(strings) and first.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]
    assert all(first[i] or order[i - 1] < order[i] for i in range(1, len(order)))


def test_merged_spans():
    assert substrings.merged(np.array([[300, 1], [0, 5], [4, 1], [104, 2]])) == [(0, 205), (300, 400)]


def test_empty(empty):
    assert substrings.remove_repeats(empty).isEmpty()
