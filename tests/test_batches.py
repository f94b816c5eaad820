"""Batch correction against the same sums on whole arrays, and what it does to planted batches."""

import numpy as np
import pytest

from accessum.operators import batches, embed


def planted(seed=2, each=60, d=6):
    """Three kinds of cells in two batches, one of which is shifted, unevenly."""
    r = np.random.default_rng(seed)
    kind = np.repeat([0, 1, 2, 0, 1, 2], [each, each, each // 2, each // 2, each, each])
    batch = np.repeat([0, 1], [each * 2 + each // 2, each * 2 + each // 2])
    x = (np.eye(3, d) * 5)[kind] + r.normal(size=(len(kind), d)) * 0.5
    return x + np.array([0, 0, 0, 2.5, -1.5, 1])[:d] * batch[:, None], kind, batch


def table(spark, x, batch, names=("one", "two")):
    return spark.createDataFrame([(i, names[b], [float(v) for v in r]) for i, (r, b) in enumerate(zip(x, batch))], "cell_id long, batch string, x array<double>")


def whole(x, batch, centre, theta=2.0, sigma=0.1, ridge=1.0, rounds=10, most_inner=20, tolerance=1e-4):
    """The same method with a design matrix of all cells."""
    phi = np.eye(batch.max() + 1)[batch]
    part, z = phi.mean(0), x / np.linalg.norm(x, axis=1, keepdims=True)
    seen = np.zeros((len(centre), phi.shape[1]))
    due, y = seen, x

    def chosen():
        r = np.exp(-((z[:, None] - centre) ** 2).sum(2) / sigma) * (((due + 1) / (seen + 1)) ** theta @ phi.T).T
        return r / r.sum(1, keepdims=True)

    for _ in range(rounds):
        for inner in range(most_inner):
            r = chosen()
            found = r.T @ phi
            seen = found if inner == 0 and not seen.any() else (seen + found) / 2
            due = np.outer(seen.sum(1), part)
            after = r.T @ z
            after /= np.linalg.norm(after, axis=1, keepdims=True)
            moved, centre = np.abs(after - centre).max(), after
            if moved < tolerance:
                break
        r, y = chosen(), x.copy()
        design = np.concatenate([np.ones((len(x), 1)), phi], 1)
        for c in range(len(centre)):
            weighted = design * r[:, c : c + 1]
            w = np.linalg.solve(weighted.T @ design + np.diag([1e-9] + [ridge] * phi.shape[1]), weighted.T @ x)
            w[0] = 0
            y -= weighted @ w
        z = y / np.linalg.norm(y, axis=1, keepdims=True)
    return y


def test_same_as_on_whole_arrays(spark):
    x, _, batch = planted()
    df = table(spark, x, batch).repartition(5)
    unit = spark.createDataFrame([(i, [float(v) for v in r / np.linalg.norm(r)]) for i, r in enumerate(x)], "cell_id long, x array<double>")
    start = batches.directions(embed.centres(unit, 4))
    got = np.array([r["x"] for r in batches.harmonised(df, 4, rounds=3).orderBy("cell_id").collect()])
    assert got == pytest.approx(whole(x, batch, start, rounds=3), abs=1e-6)


def test_planted_batches_mix_and_kinds_stay(spark):
    x, kind, batch = planted()
    df = table(spark, x, batch)

    def told(v):
        near = embed.knn(v, 10)
        pairs = near.select("cell_id", "neighbour").collect()
        return batches.batch_mixing(near, df).first(), np.mean([kind[p["cell_id"]] == kind[p["neighbour"]] for p in pairs])

    before, _ = told(df.select("cell_id", "x"))
    after, pure = told(batches.harmonised(df, 6, rounds=6))
    print(before, after, pure)
    assert before["mixing"] < 0.1 and after["mixing"] > 0.3 and 0.45 < after["expected"] < 0.55 and pure > 0.95


def test_one_batch_nulls_and_nothing(spark):
    x, _, batch = planted(each=20)
    same = batches.harmonised(table(spark, x, batch * 0), 3).orderBy("cell_id").collect()
    assert np.array([r["x"] for r in same]) == pytest.approx(x)
    assert batches.harmonised(table(spark, x, batch).limit(0)).collect() == []
    null = table(spark, x, batch, (None, "two"))
    one, two = (np.array([r["x"] for r in batches.harmonised(df, 3, rounds=2).orderBy("cell_id").collect()]) for df in (null, table(spark, x, batch)))
    assert one == pytest.approx(two)
