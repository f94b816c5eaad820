"""Links of the pipeline's near-copy stage: none below the similarity, none lost to crowded nodes or shared fingerprints."""

from collections import defaultdict

import numpy as np
import pytest

from accessum.llm import components, simhash


def family(seed, n, words, changed):
    """n texts of one template, each with some words of its own."""
    r = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        t = list(base)
        for i in r.choice(words, changed, replace=False):
            t[i] = f"own{k}x{i}"
        out.append(" ".join(t))
    return out


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups_of(texts):
    """Components of texts of similarity 0.8 or more, or of fingerprints that differ in 2 bits at most."""
    sets, root = [shingles(t) for t in texts], np.arange(len(texts))
    fps = simhash.fingerprints_of([t.encode() for t in texts])[:, 0]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8 or (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root[root == max(a, b)] = min(a, b)
    return root.tolist()


def found_groups(spark, texts, path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.read.parquet(path)).collect()}
    return [got[i] for i in range(len(texts))]


def test_no_links_below_the_similarity(spark, tmp_path):
    """Any two are of similarity 0.65 to 0.8: estimates of 256 bits link some, and chains of them many."""
    texts = family(1, 150, 150, 2)
    sims = [len(a & b) / len(a | b) for a in map(shingles, texts[:40]) for b in map(shingles, texts[40:])]
    assert 0.6 < np.median(sims) < 0.8
    got, want = found_groups(spark, texts, str(tmp_path / "t")), groups_of(texts)
    of = defaultdict(set)
    for g, w in zip(got, want):
        of[g].add(w)
    assert all(len(x) == 1 for x in of.values())


@pytest.mark.parametrize("changed", [1, 2])
def test_crowded_nodes_lose_nothing(spark, tmp_path, monkeypatch, changed):
    texts = family(2 + changed, 200, 130, changed) + family(9, 60, 80, 1)
    whole = found_groups(spark, texts, str(tmp_path / "whole"))
    found = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda *a: found(*a, 12))
    assert found_groups(spark, texts, str(tmp_path / "crowded")) == whole


def test_texts_of_one_fingerprint_keep_their_own_lanes(spark):
    """Two texts share a first lane; a third one is near the second in the other lanes, and far from the mixture."""
    r = np.random.default_rng(0)
    lanes = lambda: [int(x) for x in r.integers(0, 2**62, 5)]
    fp, one, two = 12345, lanes(), lanes()
    rows = [(1, fp, *one), (2, fp, *two), (3, fp ^ 0b111, *two)]
    texts = spark.createDataFrame(rows, "text_id long, fp long, " + ", ".join(f"{n} long" for n in (*simhash.SOUGHT[1:], *simhash.CHECKED)))
    sets = spark.createDataFrame([(1, [1, 2]), (2, [3, 4, 5, 6]), (3, [3, 4, 5, 6, 7])], "text_id long, shingles array<long>")
    known = spark.createDataFrame([], "u long, v long")
    links = simhash.similar_links(texts, known, lambda ids: sets, 0.8, 16, 47)
    assert {(x.node, x.root) for x in components.components(links).collect()} == {(2, 2), (3, 2)}


def test_pairs_are_given_where_they_first_meet():
    """Each pair that agrees in two blocks of a lane has one first node among all it meets in."""
    r = np.random.default_rng(6)
    a = r.integers(0, 2**63, (300, 2), dtype=np.uint64)
    b = a.copy()
    for k in range(300):
        for lane in range(2):
            for block in r.choice(8, r.integers(3, 8), replace=False):
                b[k, lane] ^= np.uint64(int(r.integers(1, 256)) << 8 * int(block))
    met = np.zeros(300, int)
    first = np.zeros(300, int)
    for lane in range(2):
        nodes = [simhash._placed(x[:, lane], simhash.FINE_BLOCKS, simhash.FRONT)[0] ^ np.uint64(lane << 62) for x in (a, b)]
        for at, (x, y) in enumerate(zip(*(n.reshape(-1, 300) for n in nodes))):
            for k in np.flatnonzero(x == y):
                met[k] += 1
                first[k] += simhash._first_meeting(int(x[k]), (a[k] ^ b[k])[None, :])[0]
    assert met.max() > 1 and (first == (met > 0)).all()


@pytest.mark.parametrize("size", [0, 1, 5, 60, 700, 9000])
def test_counts_of_shingles_deny_no_similar_sets(size):
    r = np.random.default_rng(size)
    for changed in (0, 1, size // 20, size // 10, size // 9, size // 4, size):
        whole = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
        other = np.unique(np.concatenate([whole[changed:], r.integers(0, 2**64, r.integers(0, changed + 1), dtype=np.uint64)]))
        both = len(np.intersect1d(whole, other))
        a, b = (np.frombuffer(simhash._counts(x) or bytes(256), np.uint8)[None] for x in (whole, other))
        similar = both and both / (len(whole) + len(other) - both) >= 0.8
        may = bool(simhash._may_be_similar(a, b, 0.8)[0])
        assert may or not similar
        if 60 <= size <= 700 and changed == size:
            assert not may
    flat = np.arange(300, dtype=np.uint64)  # one first byte, over 255 times
    assert simhash._counts(flat) is None and simhash._may_be_similar(np.zeros((1, 256), np.uint8), a, 0.8)[0]
