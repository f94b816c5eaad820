"""Thresholds from equal-width histograms: Otsu, Yen, Li. Every operator works on all groups (keys) at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 100


def histogram(df: DataFrame, value: str, keys: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """keys, bin (0 to bins - 1, every one), n, centre, low, high: bins of equal width from a group's least to its largest value.

    The last bin holds its upper edge. Nulls and NaN are left out; a group of one value spreads half a unit around it.
    """
    keys = list(keys)
    good = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("_v", F.col(value).cast("double"))
    same = F.col("_lo0") == F.col("_hi0")
    edges = good.groupBy(*keys).agg(F.min("_v").alias("_lo0"), F.max("_v").alias("_hi0")).filter(F.col("_lo0").isNotNull())
    edges = edges.select(*keys, F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("low"), F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("high"))
    placed = good.join(F.broadcast(edges), keys) if keys else good.crossJoin(F.broadcast(edges))  # one row a group
    at = F.least(F.floor((F.col("_v") - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("high") - F.col("low")) / bins
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.col("low") + (F.col("bin") + 0.5) * width).alias("centre"), "low", "high"
    )


def _sides(h: DataFrame, keys: list[str]):
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bin")
    below = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = w.rowsBetween(1, Window.unboundedFollowing)
    return below, above, Window.partitionBy(*(keys or [F.lit(0)]))


def _best(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold: the first centre of the largest score."""
    return scored.groupBy(*keys).agg(F.max_by("centre", F.struct("score", -F.col("bin"))).alias("threshold"))


def otsu(df: DataFrame, value: str, keys: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """keys, threshold: the bin centre that parts values with the largest variance between the two sides; no row where all
    values are one, as in yen() and li()."""
    keys, h = list(keys), histogram(df, value, keys, bins)
    below, above, _ = _sides(h, keys)
    weighted = F.col("n") * F.col("centre")
    h = h.withColumns({"w1": F.sum("n").over(below), "w2": F.sum("n").over(above), "s1": F.sum(weighted).over(below), "s2": F.sum(weighted).over(above)}).filter("w1 > 0 and w2 > 0")
    apart = F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2")
    return _best(h.withColumn("score", F.col("w1") * F.col("w2") * apart * apart), keys)


def yen(df: DataFrame, value: str, keys: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """keys, threshold: by the largest entropic correlation of the two sides."""
    keys, h = list(keys), histogram(df, value, keys, bins)
    below, above, whole = _sides(h, keys)
    p = F.col("n") / F.sum("n").over(whole)
    h = h.withColumn("p", p).withColumn("pp", F.col("p") * F.col("p"))
    h = h.withColumns({"p1": F.sum("p").over(below), "q1": F.sum("pp").over(below), "q2": F.sum("pp").over(above)}).filter("q1 > 0 and q2 > 0 and p1 < 1")
    score = F.log(F.pow(F.col("p1") * (1 - F.col("p1")), 2) / (F.col("q1") * F.col("q2")))
    return _best(h.withColumn("score", score), keys)


def li(df: DataFrame, value: str, keys: tuple[str, ...] = (), bins: int = BINS, step: float = 0.01) -> DataFrame:
    """keys, threshold: of min + step, min + 2 step ... below max - step, the first of least cross entropy of the histogram."""
    keys, h = list(keys), histogram(df, value, keys, bins)
    edges = h.filter("bin = 0").select(*keys, "low", "high")
    tries = F.sequence(F.lit(0), F.greatest(F.ceil((F.col("high") - F.lit(step) - F.col("low") - F.lit(step)) / step).cast("int") - 1, F.lit(0)))
    grid = edges.select(*keys, "low", F.explode(tries).alias("_k")).select(*keys, "_k", (F.col("low") + step + F.col("_k") * step).alias("_t"))
    both = h.drop("low", "high").join(grid, keys) if keys else h.drop("low", "high").crossJoin(F.broadcast(grid))
    up = F.col("centre") > F.col("_t")
    mass = F.col("n") * F.col("centre")
    sums = both.groupBy(*keys, "_k", "_t").agg(
        F.sum(F.when(up, mass).otherwise(0.0)).alias("m1"), F.sum(F.when(up, F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(~up, mass).otherwise(0.0)).alias("m0"), F.sum(F.when(~up, F.col("n")).otherwise(0)).alias("n0"),
    ).filter("n1 > 0 and n0 > 0 and m1 > 0 and m0 > 0")
    cost = -(F.col("m1") * F.log(F.col("m1") / F.col("n1"))) - F.col("m0") * F.log(F.col("m0") / F.col("n0"))
    return sums.withColumn("cost", cost).groupBy(*keys).agg(F.min_by("_t", F.struct("cost", "_k")).alias("threshold"))
