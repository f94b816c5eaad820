"""Statistics on long tables in which an absent row is zero, and tail probabilities."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tails


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z > z); neither engine's SQL has an error function. Null for null."""
    return pd.Series(tails.normal_tail(z.to_numpy(float, na_value=math.nan))).where(z.notna())


def log_gamma(x: Column) -> Column:
    """ln of the gamma function, x > 0: Stirling's series at x + 8, brought back by the recurrence; right to some 13 digits."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def gini(df: DataFrame, key: str, value: str, total: int | Column | None = None) -> DataFrame:
    """key, gini of the values of each key, of `total` values with the absent ones zero (by default only those there).

    Values must not be negative. With zeros in front, value number i of those there has place total - count + i.
    """
    w = Window.partitionBy(key).orderBy(value)
    placed = df.withColumn("_i", F.row_number().over(w)).groupBy(key).agg(
        F.sum(F.col(value) * F.col("_i")).alias("_s"), F.sum(value).alias("_t"), F.count("*").alias("_m")
    )
    n = F.col("_m") if total is None else (F.lit(total) if isinstance(total, int) else total)
    shifted = F.col("_s") + (n - F.col("_m")) * F.col("_t")
    return placed.select(key, F.when(F.col("_t") > 0, (2 * shifted - (n + 1) * F.col("_t")) / (n * F.col("_t"))).otherwise(0.0).alias("gini"))


def average_ranks(df: DataFrame, keys: list[str], value: str) -> Column:
    """The average rank of a value among its keys' rows, ascending from 1."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, name: str = "adjusted") -> DataFrame:
    """df with p adjusted within keys: the least p * n / rank of it and all larger ones, 1 at most; equal p count alike."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_q", F.col(p) * F.count("*").over(w) / F.row_number().over(w.orderBy(p)))
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min("_q").over(w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_q")


def min_max(value: str, keys: list[str]) -> Column:
    """(x - min) / (max - min) within keys; 0 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)


def z_score(value: str, keys: list[str]) -> Column:
    """(x - mean) / population standard deviation within keys; 0 where that is 0."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)
