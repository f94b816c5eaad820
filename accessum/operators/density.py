"""Two-dimensional kernel density of points, by Scott's rule with full covariance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID, REACH = 512, 5.0


def density(points: DataFrame, x: str, y: str, name: str = "density", exact_up_to: int = 20_000) -> DataFrame:
    """points with the Gaussian kernel density of all points at each.

    Distinct points are evaluated once each. Up to exact_up_to distinct points the sum runs over all of them; beyond,
    over the cells of a GRID x GRID grid with their counts and mean points, whose size doesn't grow with the data.
    Null or NaN coordinates have null density; so has everything where the covariance is singular.
    """
    good = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    m = good.agg(F.count("*").alias("n"), F.avg(x), F.avg(y), F.var_samp(x), F.covar_samp(x, y), F.var_samp(y), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    n = m[0]
    cov = np.array([[m[3] or 0, m[4] or 0], [m[4] or 0, m[5] or 0]]) if n > 1 else np.zeros((2, 2))
    if np.linalg.det(cov) <= 0:
        return points.withColumn(name, F.lit(None).cast("double"))
    h = cov * n ** (-1 / 3)
    inverse, norm = np.linalg.inv(h), 2 * np.pi * np.sqrt(np.linalg.det(h)) * n
    distinct = good.groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    if n > exact_up_to and distinct.count() > exact_up_to:
        at = lambda c, lo, hi: F.least(F.floor((F.col(c) - F.lit(lo)) * GRID / F.lit(max(hi - lo, 1e-300))), F.lit(GRID - 1))
        mass = distinct.groupBy(at("_x", m[6], m[7]), at("_y", m[8], m[9])).agg(F.sum("_n").alias("_m"), (F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("_x"), (F.sum(F.col("_y") * F.col("_n")) / F.sum("_n")).alias("_y")).select("_x", "_y", F.col("_m").alias("_n"))
    else:
        mass = distinct
    held = mass.orderBy("_x", "_y").toPandas()  # GRID * GRID or exact_up_to rows at most
    train, weight = held[["_x", "_y"]].to_numpy(float), held["_n"].to_numpy(float)

    def run(batches):
        for pdf in batches:
            p, out = pdf[["_x", "_y"]].to_numpy(float), np.zeros(len(pdf))
            for i in range(0, len(p), 256):
                d = p[i : i + 256, None] - train
                out[i : i + 256] = np.exp(-0.5 * np.einsum("abi,ij,abj->ab", d, inverse, d)) @ weight / norm
            yield pd.DataFrame({"_x": p[:, 0], "_y": p[:, 1], name: out})

    found = distinct.select("_x", "_y").mapInPandas(run, f"_x double, _y double, {name} double")
    return points.join(found, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left").drop("_x", "_y")
