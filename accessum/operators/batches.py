"""Batch correction of cells' vectors: soft clusters that favour even batches, and a ridge correction for each.

After Korsunsky et al. (2019). A cell's shares of clusters follow from its direction, the clusters' centres, and how many
cells of its batch each cluster has against how many it should have. So shares are never stored: a round is one pass over the
cells in which tasks sum moments by cluster and batch, and only these sums (clusters x batches x dimensions numbers) meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embed import centres
from .saving import dropped, written


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def shares(z: np.ndarray, batch: np.ndarray, centre: np.ndarray, seen: np.ndarray, due: np.ndarray, sigma: float, theta: float) -> np.ndarray:
    """Cells' shares of clusters. z: directions; seen and due: cells by cluster and batch, as they are and as an even mix would have them."""
    close = np.exp(-2 * (1 - z @ centre.T) / sigma)
    close = close * (((due + 1) / (seen + 1)) ** theta).T[batch]
    return close / np.maximum(close.sum(1, keepdims=True), 1e-300)


def correction(seen: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    """What to take from a cell, by cluster, batch and dimension: the batches' offsets of a ridge regression in each cluster
    whose intercept is free and stays. sums: shares times vectors, by cluster and batch."""
    k, batches, d = sums.shape
    out = np.zeros((k, batches, d))
    for c in range(k):
        gram = np.zeros((batches + 1, batches + 1))
        gram[0, 0], gram[0, 1:], gram[1:, 0] = seen[c].sum(), seen[c], seen[c]
        gram[1:, 1:] = np.diag(seen[c] + ridge)
        gram[0, 0] += 1e-9
        out[c] = np.linalg.solve(gram, np.concatenate([sums[c].sum(0, keepdims=True), sums[c]]))[1:]
    return out


def _moments(cells: DataFrame, weights, dimensions: int) -> np.ndarray:
    """Sums over cells, by cluster and batch, of shares (first) and of shares times x: one row a cluster and batch reaches the driver.

    cells: batch (number), x, z; weights: a function of directions and batches.
    """

    def partial(frames):
        total = None
        for pdf in frames:
            for lo in range(0, len(pdf), 8192):
                part = pdf.iloc[lo : lo + 8192]
                batch, x, z = part["batch"].to_numpy(), np.stack(part["x"]).astype(float), np.stack(part["z"]).astype(float)
                r = weights(z, batch)
                with_z = np.concatenate([np.ones((len(x), 1)), x, z], 1)
                now = {int(b): r[batch == b].T @ with_z[batch == b] for b in np.unique(batch)}
                total = now if total is None else {b: total.get(b, 0) + now.get(b, 0) for b in {*total, *now}}
        for b, m in (total or {}).items():
            yield pd.DataFrame({"batch": b, "cluster": np.arange(len(m)), "m": m.tolist()})

    sums = cells.mapInPandas(partial, "batch int, cluster int, m array<double>").select("batch", "cluster", F.posexplode("m").alias("i", "v")).groupBy("batch", "cluster", "i").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("batch", "cluster").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m")).collect()
    out = np.zeros((max(r["cluster"] for r in rows) + 1, max(r["batch"] for r in rows) + 1, 1 + 2 * dimensions))
    for r in rows:
        out[r["cluster"], r["batch"]] = [x["v"] for x in r["m"]]
    return out


def harmonised(vectors: DataFrame, clusters: int | None = None, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, rounds: int = 10, most_inner: int = 20, tolerance: float = 1e-4, seed: int = 555) -> DataFrame:
    """cell_id, x: vectors (cell_id, batch, x) without what differs by batch within clusters.

    clusters: a thirtieth of the cells, 2 to 100, unless given. A round finds clusters of the corrected vectors, until the
    centres move less than `tolerance`, and corrects the given vectors anew. theta: how strongly even batches are favoured. First
    centres come from a bounded sample (embed.centres). A null batch is a batch. One batch: vectors as they are. No vectors: no rows.
    """
    names = [r["batch"] for r in vectors.select("batch").distinct().orderBy("batch").collect()]  # a row a batch
    if len(names) < 2:
        return vectors.select("cell_id", "x")
    spark = vectors.sparkSession
    number = spark.createDataFrame([(b, i) for i, b in enumerate(names)], f"_known {vectors.schema['batch'].dataType.simpleString()}, batch int")
    numbered = vectors.withColumnRenamed("batch", "_name").join(F.broadcast(number), F.col("_name").eqNullSafe(F.col("_known"))).select("cell_id", "batch", F.col("x").cast("array<double>").alias("x"))
    unit = lambda c: F.transform(c, lambda v: v / F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-12)))
    given = written(numbered.withColumn("z", unit(F.col("x"))), "vectors")
    n, d = given.count(), len(given.first()["x"])
    k = clusters or min(100, max(2, round(n / 30)))
    centre = directions(centres(given.select("cell_id", F.col("z").alias("x")), k, seed=seed))
    k = len(centre)
    per_batch = np.zeros(len(names))
    for r in given.groupBy("batch").count().collect():
        per_batch[r["batch"]] = r["count"]
    part = per_batch / n
    seen = due = np.zeros((k, len(names)))
    now = given
    for _ in range(rounds):
        for inner in range(most_inner):
            m = _moments(now, lambda z, b, c=centre, s=seen, e=due: shares(z, b, c, s, e, sigma, theta), d)
            found = m[:, :, 0]
            seen = found if inner == 0 and not seen.any() else (seen + found) / 2  # half steps, as all cells choose at once
            due = seen.sum(1, keepdims=True) * part
            after = directions(m[:, :, 1 + d :].sum(1))
            moved = np.abs(after - centre).max()
            centre = after
            if moved < tolerance:
                break
        now_shares = lambda z, b, c=centre, s=seen, e=due: shares(z, b, c, s, e, sigma, theta)
        m = _moments(now, now_shares, d)  # x is the given vector in every round
        off = correction(m[:, :, 0], m[:, :, 1 : 1 + d], ridge)

        def corrected(frames, weights=now_shares, off=off):
            for pdf in frames:
                for lo in range(0, len(pdf), 8192):
                    p = pdf.iloc[lo : lo + 8192]
                    x, z, b = np.stack(p["x"]).astype(float), np.stack(p["z"]).astype(float), p["batch"].to_numpy()
                    y = x - np.einsum("ik,ikd->id", weights(z, b), off.transpose(1, 0, 2)[b])
                    yield pd.DataFrame({"cell_id": p["cell_id"].to_numpy(), "batch": b, "x": x.tolist(), "z": directions(y).tolist(), "y": y.tolist()})

        before, now = now, written(now.mapInPandas(corrected, f"cell_id {given.schema['cell_id'].dataType.simpleString()}, batch int, x array<double>, z array<double>, y array<double>"), "vectors")
        dropped(before)
    return now.select("cell_id", F.col("y").alias("x"))


def batch_mixing(neighbours: DataFrame, batches: DataFrame) -> DataFrame:
    """One row: mixing, the share of neighbours (cell_id, neighbour) of another batch (cell_id, batch), and expected, what an even mix gives."""
    pairs = neighbours.join(batches.select("cell_id", "batch"), "cell_id").join(batches.select(F.col("cell_id").alias("neighbour"), F.col("batch").alias("other")), "neighbour")
    mixing = pairs.agg(F.avg((~F.col("batch").eqNullSafe(F.col("other"))).cast("double")).alias("mixing"))
    sizes = batches.groupBy("batch").agg(F.count("*").alias("n")).agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("expected"))
    return mixing.crossJoin(sizes)  # one row each
