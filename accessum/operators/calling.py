"""Peak calling on pile-ups of fragments or of cuts, against an even Poisson background.

A pile-up is a table of stretches of one height. Only positions at which some tag begins or ends are rows, summed before
they are sorted, and heights run through bins of a fixed width with one carried row a bin, so neither a deep stretch nor a
long chromosome is one task. What a height is worth depends on the group and the height alone: a small table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tails
from . import intervals

_BIN = 1 << 20


@F.pandas_udf(T.DoubleType())
def _minus_log10_tail(height: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series(-tails.log_poisson_tail(height.to_numpy(float), mean.to_numpy(float)) / np.log(10))


def cuts(fragments: DataFrame, shift: int = -73, extend: int = 146) -> DataFrame:
    """Both ends of fragments (chrom, lo, hi, others) as tags of `extend` bases, that begin `shift` bases further inward.

    The default lays a tag around its end. Tags reach below 0 at a chromosome's start and are cut there.
    """
    lo, hi = F.col("lo") + shift, F.col("hi") - shift
    ends = F.array(F.struct(lo.alias("lo"), (lo + extend).alias("hi")), F.struct((hi - extend).alias("lo"), hi.alias("hi")))
    rest = [c for c in fragments.columns if c not in ("lo", "hi")]
    out = fragments.withColumn("_end", F.explode(ends)).select(*rest, F.greatest(F.col("_end.lo"), F.lit(0)).alias("lo"), F.col("_end.hi").alias("hi"))
    return out.filter("hi > lo")


def pile_up(tags: DataFrame, keys: tuple[str, ...] = ("grp", "chrom"), width: int = _BIN) -> DataFrame:
    """keys, lo, hi, height: stretches of one height above 0; neighbouring stretches differ. Tags without length count for nothing."""
    k = list(keys)
    ends = tags.filter("hi > lo").select(*k, F.explode(F.array(F.struct(F.col("lo").cast("long").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").cast("long").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*k, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).filter("d != 0").withColumn("_bin", intervals.bin_of("at", width))
    over = Window.partitionBy(*k).orderBy("_bin")
    bins = steps.groupBy(*k, "_bin").agg(F.sum("d").alias("_sum"), F.min("at").alias("_first"))  # a row a bin
    bins = bins.withColumns({"_before": F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_after": F.lead("_first").over(over)})
    inside = Window.partitionBy(*k, "_bin").orderBy("at")
    out = steps.join(bins.select(*k, "_bin", "_before", "_after"), [*k, "_bin"])
    out = out.withColumns({"height": F.col("_before") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "hi": F.coalesce(F.lead("at").over(inside), "_after")})
    return out.filter("height > 0").select(*k, F.col("at").alias("lo"), "hi", "height")


def heights(piled: DataFrame, genome: int) -> DataFrame:
    """grp, height, mean, bases (of that height), minus_log10_p, minus_log10_q.

    mean: a group's tag bases over the genome's; p: the chance of that height or more at that mean (Poisson); q: after
    Benjamini and Hochberg over all of the genome's positions, as many of which share a p as have its height.
    """
    by = piled.groupBy("grp", "height").agg(F.sum(F.col("hi") - F.col("lo")).alias("bases"))
    every = Window.partitionBy("grp")
    by = by.withColumn("mean", F.sum(F.col("bases") * F.col("height")).over(every) / genome).withColumn("minus_log10_p", _minus_log10_tail("height", "mean"))
    down = Window.partitionBy("grp").orderBy(F.desc("height"))  # a row a height
    by = by.withColumn("_rank", F.sum("bases").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    q = F.col("minus_log10_p") - F.log10(F.lit(float(genome))) + F.log10("_rank")
    return by.withColumn("minus_log10_q", F.greatest(F.lit(0.0), F.max(q).over(Window.partitionBy("grp").orderBy("height").rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_rank")


def call_peaks(tags: DataFrame, genome: int, q: float = 0.05, most_gap: int = 30, least_length: int = 146, width: int = _BIN) -> DataFrame:
    """grp and narrowPeak columns of peaks of tags (grp, chrom, lo, hi; cuts() or whole fragments), in a genome of that many bases.

    A peak is a run of stretches whose q is at most the given one, over gaps up to most_gap, of least_length bases at least. Its
    summit (from lo) is the middle of its first highest stretch, from which fold_change ((height + 1) / (mean + 1)), p and q are.
    score: ten times minus_log10_q, as a whole number. Names count a group's peaks by chromosome and place. No tags: no rows.
    """
    piled = pile_up(tags, width=width)
    worth = heights(piled, genome)
    good = worth.filter(F.col("minus_log10_q") >= -F.log10(F.lit(q)) - 1e-12)
    kept = piled.join(good, ["grp", "height"])
    runs = intervals.clusters(kept, most_gap + 1, ("grp", "chrom"))
    top = F.max_by(F.struct("lo", "hi", "height", "mean", "minus_log10_p", "minus_log10_q"), F.struct("height", -F.col("lo"))).alias("t")
    peaks = runs.groupBy("grp", "chrom", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), top).filter(F.col("hi") - F.col("lo") >= least_length)
    # numbers by chromosome and place: a chromosome's peaks are counted first, so that no window spans a genome
    order = Window.partitionBy("grp", "chrom").orderBy("lo")
    before = Window.partitionBy("grp").orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    counts = peaks.groupBy("grp", "chrom").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = peaks.withColumn("_i", F.row_number().over(order)).join(counts, ["grp", "chrom"])
    return out.select(
        "grp", "chrom", "lo", "hi", F.concat(F.col("grp").cast("string"), F.lit("_peak_"), (F.col("_before") + F.col("_i")).cast("string")).alias("name"),
        F.floor(10 * F.col("t.minus_log10_q")).cast("long").alias("score"), F.lit(".").alias("strand"), ((F.col("t.height") + 1) / (F.col("t.mean") + 1)).alias("fold_change"),
        F.col("t.minus_log10_p").alias("minus_log10_p"), F.col("t.minus_log10_q").alias("minus_log10_q"), (F.floor((F.col("t.lo") + F.col("t.hi")) / 2) - F.col("lo")).cast("long").alias("summit"),
    )
