"""Labels carried from annotated cells to others through anchors: mutual nearest neighbours of the two sets.

After Haghverdi et al. (2018) and Stuart et al. (2019): both sets are laid into common directions (canonical correlation), pairs of
cells that are among each other's nearest are anchors, each cell is moved by the offsets of the anchors next to it, and
labels are voted by the nearest annotated cells. Neighbours come from the index of embed.py; common directions from
products of features with features, which tasks sum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import embed
from .saving import written


def _products(vectors: DataFrame, mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> np.ndarray:
    """Sum of outer products of vectors (cell_id, x), with a 1 in front, after standardising: features squared numbers reach the driver."""

    def partial(frames):
        total = None
        for pdf in frames:
            for lo in range(0, len(pdf), 8192):
                x = np.stack(pdf["x"].iloc[lo : lo + 8192]).astype(float)
                x = x if mean is None else (x - mean) / scale
                x = np.concatenate([np.ones((len(x), 1)), x], 1)
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total.tolist()})

    rows = vectors.select("x").mapInPandas(partial, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n = max((r["i"] for r in rows), default=-1) + 1
    out = np.zeros((n, n))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def _standard(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sums = _products(vectors)
    mean = sums[0, 1:] / sums[0, 0]
    deviation = np.sqrt(np.maximum(np.diag(sums)[1:] / sums[0, 0] - mean**2, 0))
    return mean, np.where(deviation > 1e-12, deviation, 1.0)


def common_directions(one: DataFrame, two: DataFrame, dimensions: int = 10) -> tuple[DataFrame, DataFrame]:
    """Both sets (cell_id, x; the same features) as cell_id, x of unit length in `dimensions` common directions.

    Features are standardised in each set. The directions are the singular vectors of the product of all cells of one with all of two,
    which is never made: with each set's products of features, its square root and the other's give them exactly. Features squared numbers
    must fit the driver.
    """
    (m1, s1), (m2, s2) = _standard(one), _standard(two)
    roots, inverse = [], []
    for vectors, m, s in ((one, m1, s1), (two, m2, s2)):
        value, vector = np.linalg.eigh(_products(vectors, m, s)[1:, 1:])
        value = np.where(value > value.max(initial=0) * 1e-10, value, 0)
        roots.append((vector * np.sqrt(value)) @ vector.T)
        inverse.append((vector * np.where(value > 0, 1 / np.sqrt(np.where(value > 0, value, 1)), 0)) @ vector.T)
    u, _, vt = np.linalg.svd(roots[0] @ roots[1])
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])  # singular vectors come with either sign
    out = []
    for vectors, m, s, w in ((one, m1, s1, inverse[0] @ (u * sign)), (two, m2, s2, inverse[1] @ (vt.T * sign))):
        w = w[:, :dimensions]

        def projected(frames, m=m, s=s, w=w):
            for pdf in frames:
                for lo in range(0, len(pdf), 8192):
                    p = pdf.iloc[lo : lo + 8192]
                    y = ((np.stack(p["x"]).astype(float) - m) / s) @ w
                    y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
                    yield pd.DataFrame({"cell_id": p["cell_id"].to_numpy(), "x": y.tolist()})

        out.append(vectors.select("cell_id", "x").mapInPandas(projected, "cell_id long, x array<double>"))
    return out[0], out[1]


def _of(vectors: DataFrame, which: int) -> DataFrame:
    """Vectors with ids that no other set's have: twice the id, and 1 for the second set."""
    return vectors.select((F.col("cell_id") * 2 + which).alias("cell_id"), F.col("x").cast("array<double>").alias("x"))


def anchors(one: DataFrame, two: DataFrame, k: int = 5, **search) -> DataFrame:
    """a, b: cells of one and of two (cell_id, x) that are among each other's k nearest of the other set. search: of embed.knn_by_index."""
    a, b = _of(one, 0), _of(two, 1)
    there = embed.knn_by_index(a, b, k, **search).select(F.col("cell_id").alias("a"), F.col("neighbour").alias("b"))
    back = embed.knn_by_index(b, a, k, **search).select(F.col("neighbour").alias("a"), F.col("cell_id").alias("b"))
    both = there.join(back, ["a", "b"], "left_semi")
    return both.select(F.floor(F.col("a") / 2).cast("long").alias("a"), F.floor((F.col("b") - 1) / 2).cast("long").alias("b"))


def corrected(one: DataFrame, two: DataFrame, pairs: DataFrame, k: int = 20, **search) -> DataFrame:
    """cell_id, x: two's vectors moved towards one by the mean offset of the k anchored cells of two next to each.

    A cell's anchors count by exp(-d^2 / s^2), s the largest of the k distances. A cell with several anchors has their mean offset. No anchors: as it is.
    """
    long = lambda df, key: df.select(F.col("cell_id").alias(key), F.posexplode("x").alias("i", f"v_{key}"))
    offsets = pairs.join(long(one, "a"), "a").join(long(two, "b"), ["b", "i"]).groupBy("b", "i").agg(F.avg(F.col("v_a") - F.col("v_b")).alias("o"))
    offsets = written(offsets.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("i", "o"))).alias("s")).select("b", F.col("s.o").alias("o")), "offsets")
    anchored = _of(two, 1).join(offsets.select((F.col("b") * 2 + 1).alias("cell_id")), "cell_id", "left_semi")
    # a cell's own anchor counts too: asked cells bear ids of their own
    near = embed.knn_by_index(_of(two, 0), anchored, k, **search)
    cell = Window.partitionBy("cell_id")
    near = near.withColumn("s", F.max("distance").over(cell)).withColumn("w", F.when(F.col("s") > 0, F.exp(-F.pow(F.col("distance") / F.col("s"), 2))).otherwise(1.0))
    near = near.select(F.floor(F.col("cell_id") / 2).cast("long").alias("cell_id"), F.floor((F.col("neighbour") - 1) / 2).cast("long").alias("b"), "w")
    moved = near.join(offsets, "b").select("cell_id", "w", F.posexplode("o").alias("i", "o")).groupBy("cell_id", "i").agg((F.sum(F.col("w") * F.col("o")) / F.sum("w")).alias("o"))
    by = moved.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("i", "o"))).alias("m")).select("cell_id", F.col("m.o").alias("o"))
    x = F.col("x").cast("array<double>")
    return two.join(by, "cell_id", "left").select("cell_id", F.when(F.col("o").isNull(), x).otherwise(F.zip_with(x, "o", lambda v, o: v + o)).alias("x"))


def nearest_labels(queries: DataFrame, references: DataFrame, label: str = "label", k: int = 15, **search) -> DataFrame:
    """cell_id, label, share: the label that most of a query's k nearest references (cell_id, x, label) have, each counting by the
    inverse of its distance, and its share of all votes; ties to the first label."""
    near = embed.knn_by_index(_of(queries, 1), _of(references, 0), k, **search)
    named = near.join(references.select((F.col("cell_id") * 2).alias("neighbour"), F.col(label).alias("label")), "neighbour")
    votes = named.groupBy("cell_id", "label").agg(F.sum(1 / (F.col("distance") + 1e-9)).alias("v"))
    cell = Window.partitionBy("cell_id")
    ranked = votes.withColumn("share", F.col("v") / F.sum("v").over(cell)).withColumn("_r", F.row_number().over(cell.orderBy(F.desc("v"), "label")))
    return ranked.filter("_r = 1").select(F.floor(F.col("cell_id") / 2).cast("long").alias("cell_id"), "label", "share")


def transferred(queries: DataFrame, references: DataFrame, label: str = "label", dimensions: int | None = None, k: int = 5, smooth: int = 20, votes: int = 15, **search) -> DataFrame:
    """cell_id, label, share: references' labels (cell_id, x, label) for queries (cell_id, x) through anchors.

    dimensions: common directions to lay both into first; None: vectors as they are. No references or queries: no rows.
    """
    a, b = references.select("cell_id", "x"), queries.select("cell_id", "x")
    if dimensions:
        a, b = (written(df, "directions") for df in common_directions(a, b, dimensions))
    pairs = written(anchors(a, b, k, **search), "anchors")
    moved = written(corrected(a, b, pairs, smooth, **search), "corrected")
    return nearest_labels(moved, a.join(references.select("cell_id", label), "cell_id"), label, votes, **search)
