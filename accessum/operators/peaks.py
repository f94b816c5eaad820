"""Consensus peaks: fixed-width peaks, scores per million, and the best of each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals
from .saving import saved

HALF = 250


def around_summits(peaks: DataFrame, half: int = HALF, sizes: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """Peaks as summit ± half (and the summit's base), within chromosome bounds and off the blacklist. peaks: chrom, lo, hi, summit, rid."""
    centre = F.col("lo") + F.col("summit")
    return usable(peaks.withColumns({"lo": centre - half, "hi": centre + half + 1}), sizes, blacklist)


def usable(peaks: DataFrame, sizes: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    if sizes is not None:
        peaks = intervals.within_bounds(peaks, sizes)
    return peaks if blacklist is None else intervals.overlap(peaks, blacklist, "anti")


def per_million(peaks: DataFrame, value: str = "score", keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """peaks with value divided by its sum over the keys, times a million."""
    totals = peaks.groupBy(*keys).agg(F.sum(value).alias("_total"))  # one row a group
    return peaks.join(totals, list(keys)).withColumn(value, F.col(value) * 1e6 / F.col("_total")).drop("_total")


def best_of_clusters(peaks: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """The peaks that remain when, best score first, each peak kept removes all that overlap it.

    Ties: the smaller lo, hi, then name. Rounds on all clusters at once: a peak is kept when no better one overlaps it,
    what it overlaps goes, and the rest goes on; each round keeps the best of every cluster at least. Kept and open
    peaks are checkpointed in each round, so lineage stays short.
    """
    rank = F.struct(F.col("score"), -F.col("lo"), -F.col("hi"), F.col("name"))
    left = saved(peaks.withColumn("_rank", rank).withColumn("_rid", F.monotonically_increasing_id()))
    kept = None
    extra = [k for k in keys if k != "chrom"]
    while True:
        slim = left.select("chrom", "lo", "hi", "_rank", "_rid", *extra)
        same = F.lit(True)
        for k in extra:
            same = same & (F.col(f"{k}_1") == F.col(f"{k}_2"))
        met = intervals.pairs(slim, slim).filter(same & (F.col("_rid_1") != F.col("_rid_2")))
        beaten = met.filter((F.col("_rank_1") < F.col("_rank_2")) | ((F.col("_rank_1") == F.col("_rank_2")) & (F.col("_rid_1") > F.col("_rid_2")))).select(F.col("_rid_1").alias("_rid")).distinct()
        now = saved(left.join(beaten, "_rid", "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
        hit = met.join(now.select(F.col("_rid").alias("_rid_2")), "_rid_2", "left_semi").select(F.col("_rid_1").alias("_rid")).distinct()
        left = saved(left.join(now.select("_rid").unionByName(hit), "_rid", "left_anti"))
        if left.isEmpty():
            return kept.drop("_rank", "_rid")


def back_annotated(kept: DataFrame, peaks: DataFrame) -> DataFrame:
    """kept with the names of all peaks that overlap each, sorted and joined by commas, and their largest score."""
    found = intervals.pairs(kept.select("chrom", "lo", "hi"), peaks.select("chrom", "lo", "hi", "name", "score"))
    named = found.groupBy("chrom", F.col("lo_1").alias("lo"), F.col("hi_1").alias("hi"))
    return named.agg(F.array_join(F.array_sort(F.collect_set("name_2")), ",").alias("name"), F.max("score_2").alias("score"))


def consensus(peaks: DataFrame, half: int = HALF, sizes: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """chrom, lo, hi, name, score of the consensus of all groups' peaks. peaks: grp, chrom, lo, hi, summit, score, name, rid.

    Each group's peaks are widened, thinned and scaled per million; the union is thinned again. As the last step lo
    moves up by one, so that widths are 2 * half.
    """
    each = per_million(best_of_clusters(around_summits(peaks, half, sizes, blacklist), ("grp", "chrom")))
    union = best_of_clusters(each.select("chrom", "lo", "hi", "name", "score"))
    return union.select("chrom", (F.col("lo") + 1).alias("lo"), "hi", "name", "score")


def best_in_cluster(peaks: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """One row a cluster of overlapping peaks: keys, cluster, n, best (name of the largest score, ties by lo, then name), score."""
    tagged = intervals.clusters(peaks, keys=keys)
    best = F.max_by(F.struct("name", "score"), F.struct(F.col("score"), -F.col("lo"), F.col("name")))
    return tagged.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), best.alias("b")).select(*keys, "cluster", "n", F.col("b.name").alias("best"), F.col("b.score").alias("score"))
