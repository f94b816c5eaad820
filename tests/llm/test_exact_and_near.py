import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from accessum.llm import components, exact_dedup, simhash


def test_cut_points_depend_on_content_only():
    r = np.random.default_rng(0)
    shared = r.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    a, b = b"start" * 40 + shared, shared
    both = np.frombuffer(a + b"" + b, np.uint8)
    ends = list(exact_dedup.cut_points([len(a), 0, len(b)], both))
    assert ends[1] == [] and ends[0][-1] == len(a) and ends[2] == next(exact_dedup.cut_points([len(b)], np.frombuffer(b, np.uint8)))
    chunks = [{t[x:y] for x, y in zip([0, *e], e)} for t, e in ((a, ends[0]), (b, ends[2]))]
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[1])
    sizes = np.diff([0, *ends[0]])
    assert sizes.max() <= exact_dedup.MAX_CHUNK and (sizes[:-1] >= exact_dedup.MIN_CHUNK).all()
    assert next(exact_dedup.cut_points([70_000], np.zeros(70_000, np.uint8)))[0] <= exact_dedup.MAX_CHUNK


def test_exact_groups(odd):
    groups = defaultdict(list)
    for r in odd.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == odd.count()
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns and left.count() == len(groups)
    assert {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in left.collect()} == set(groups)


def test_chunk_store_compares_bodies(odd):
    assert exact_dedup.chunk_store(odd).filter("variants <> 1").isEmpty()


def test_chunks_that_share_an_identifier(odd, monkeypatch):
    """Every chunk gets one identifier: texts are told apart by the whole text's digest, and groups stay the same."""
    rows = lambda: sorted((tuple(r)[:5] for r in exact_dedup.exact_groups(odd).collect()), key=repr)
    want = rows()
    plain = exact_dedup.chunk_store
    monkeypatch.setattr(exact_dedup, "chunk_store", lambda *a: plain(*a).limit(1).selectExpr("chunk_id", "2L AS variants"))
    monkeypatch.setattr(exact_dedup, "recipes", lambda *a, f=exact_dedup.recipes: f(*a).withColumn("recipe", exact_dedup.F.lit(b"0" * 16)))
    assert rows() == want


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def roots_of(values, most=2):
    f = np.array(values, np.uint64)
    root = np.arange(len(f))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= most):
            a, b = root[i], root[j]
            if a != b:
                root[root == max(a, b)] = min(a, b)
    return root


@pytest.mark.parametrize("name", ["odd", "small"])
def test_near_groups(name, request):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    root = roots_of([f for _, f in rows])
    least = {}
    for (i, _), k in zip(rows, root):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    want = sorted(((i, format(f, "016x"), least[k]) for (i, f), k in zip(rows, root)), key=repr)
    got = simhash.near_groups(docs)
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect()), key=repr) == want
    wider = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect() if r.doc_id is not None}
    assert all(wider[i] == wider[least[k]] for (i, _), k in zip(rows, root) if i is not None and least[k] is not None)


@pytest.mark.parametrize("most", [4096, 16, 2])
def test_links_of_dense_neighbourhoods(spark, most):
    """Trees, and the way round nodes that are too large for one."""
    r = np.random.default_rng(most)
    f = []
    for base in r.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(70):
            x = int(base)
            for k in r.choice(64, r.integers(0, 6), replace=False):
                x ^= 1 << int(k)
            f.append(x)
    f = np.unique(np.array(f, np.uint64))
    root = roots_of(f)
    want = {frozenset(f[root == k].view(np.int64).tolist()) for k in np.unique(root) if (root == k).sum() > 1}
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), most)
    for u, v in links.collect():
        assert bin((u ^ v) & (2**64 - 1)).count("1") <= 2 or most != 2
    found = components.components(links).toPandas()
    assert set(found.groupby("root")["node"].apply(frozenset)) == want


def jaccard(a, b):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def near_copies(seed, copies):
    """Texts of 60 to 500 words, each with copies of which a few words differ, and others of their own."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefgh"), r.integers(2, 9)))
    texts = []
    for _ in range(30):
        w = [word() for _ in range(r.integers(60, 500))]
        texts.append((len(texts), " ".join(w), None))
        for _ in range(copies):
            v = list(w)
            for i in r.choice(len(v), max(1, int(len(v) * r.choice([0.005, 0.01, 0.015, 0.06]))), replace=False):
                v[i] = word()
            texts.append((len(texts), " ".join(v), texts[-1][0] if texts[-1][2] is None else texts[-1][2]))
    return texts


@pytest.mark.parametrize(("most", "copies"), [(4096, 3), (8, 12)])
def test_similar_texts(spark, tmp_path, monkeypatch, most, copies):
    """Copies of similarity 0.85 or more are found; texts below 0.6 to all of a group aren't in it; crowded nodes go on."""
    texts = near_copies(most, copies)
    spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    found = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda *a: found(*a, most))
    docs = spark.read.parquet(str(tmp_path / "t"))
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    pairs = [(i, o, jaccard(t, texts[o][1])) for i, t, o in texts if o is not None]
    close = [group[i] == group[o] for i, o, s in pairs if s >= 0.85]
    assert len(close) > 20 and sum(close) >= 0.95 * len(close)
    for k in set(group.values()):
        members = [i for i in group if group[i] == k]
        assert len({texts[i][2] if texts[i][2] is not None else i for i in members}) == 1
    far = [group[i] == group[o] for i, o, s in pairs if s < 0.55]
    assert sum(far) <= 0.1 * len(far) if most == 4096 else True
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(group.values())


def test_gray_rank_orders_neighbours():
    n = 1 << 10
    place = simhash.gray_rank(np.arange(n, dtype=np.uint64)).astype(int)
    inverse = np.argsort(place)
    assert sorted(place) == list(range(n)) and all(bin(int(a) ^ int(b)).count("1") == 1 for a, b in zip(inverse[:-1], inverse[1:]))


def test_components(spark):
    r = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(64)] + [(7, 5000 + i) for i in range(200)] + [(3, 3), (None, 4)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}


def test_empty(empty):
    assert exact_dedup.exact_groups(empty).isEmpty() and exact_dedup.drop_exact_copies(empty).isEmpty()
    assert simhash.near_groups(empty).isEmpty() and simhash.drop_near_copies(empty).isEmpty()
