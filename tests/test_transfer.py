"""Anchors, corrections and common directions against plain numpy, and labels that come over."""

import numpy as np
import pytest

from accessum.operators import transfer

EXACT = {"lists": 1, "probes": 1}


def table(spark, x, labels=None, first=0):
    rows = [(first + i, [float(v) for v in r], *(() if labels is None else (labels[i],))) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "cell_id long, x array<double>" + ("" if labels is None else ", label string"))


def planted(seed=1, n=(60, 45), d=6):
    r = np.random.default_rng(seed)
    kinds = [r.integers(0, 3, m) for m in n]
    centre = np.eye(3, d) * 8
    one, two = (centre[k] + r.normal(size=(len(k), d)) for k in kinds)
    return one, two + np.array([0, 0, 0, 5, -4, 3])[:d] + 1.0, kinds


def nearest(x, y, k):
    return np.argsort(((x[:, None] - y) ** 2).sum(2), 1, kind="stable")[:, :k]


def test_anchors_and_corrections_against_numpy(spark):
    one, two, _ = planted()
    a, b = nearest(one, two, 4), nearest(two, one, 4)
    want = {(i, int(j)) for i in range(len(one)) for j in a[i] if i in b[j]}
    t1, t2 = table(spark, one), table(spark, two)
    pairs = transfer.anchors(t1, t2, 4, **EXACT)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want
    offset = {j: np.mean([one[i] - two[j] for i, x in want if x == j], 0) for j in {j for _, j in want}}
    ids = np.array(sorted(offset))
    moved = []
    for x in two:
        d = np.sqrt(((two[ids] - x) ** 2).sum(1))
        near = np.lexsort((ids, d))[:7]
        w = np.exp(-((d[near] / d[near].max()) ** 2))
        moved.append(x + (w[:, None] * np.array([offset[j] for j in ids[near]])).sum(0) / w.sum())
    got = transfer.corrected(t1, t2, pairs, 7, **EXACT).orderBy("cell_id").collect()
    assert np.array([r["x"] for r in got]) == pytest.approx(np.array(moved))
    none = transfer.corrected(t1, t2, pairs.limit(0), 7, **EXACT).orderBy("cell_id").collect()
    assert np.array([r["x"] for r in none]) == pytest.approx(two)


def test_common_directions_are_singular_vectors_of_all_cells_products(spark):
    one, two, _ = planted(2)
    z1, z2 = ((x - x.mean(0)) / x.std(0) for x in (one, two))
    u, _, vt = np.linalg.svd(z1 @ z2.T)
    got = [np.array([r["x"] for r in df.orderBy("cell_id").collect()]) for df in transfer.common_directions(table(spark, one), table(spark, two), 3)]
    for g, w in zip(got, (u[:, :3], vt.T[:, :3])):
        assert np.linalg.norm(g, axis=1) == pytest.approx(np.ones(len(g)))
        w = w / np.linalg.norm(w, axis=1, keepdims=True)
        assert np.abs((g * w).sum(0) / np.linalg.norm(g, axis=0) / np.linalg.norm(w, axis=0)) == pytest.approx(np.ones(3))  # alike but for sign


@pytest.mark.parametrize("dimensions", [None, 4])
def test_labels_come_over_between_shifted_sets(spark, dimensions):
    one, two, kinds = planted(3)
    names = np.array(["a", "b", "c"])
    references, queries = table(spark, one, names[kinds[0]].tolist()), table(spark, two)
    got = {r["cell_id"]: r for r in transfer.transferred(queries, references, dimensions=dimensions, **EXACT).collect()}
    right = np.mean([got[i]["label"] == names[k] for i, k in enumerate(kinds[1])])
    print(dimensions, right)
    assert len(got) == len(two) and right >= 0.95 and all(0 < r["share"] <= 1 for r in got.values())
