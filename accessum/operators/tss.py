"""Cut sites around transcription start sites, and the enrichment of each barcode there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals

FLANK, SMOOTH, ENDS, CENTRE, LEAST_NORM = 2000, 10, 100, 50, 0.2
MOST_SITES, TASK_FRAGMENTS = 1_000_000, 20_000


def cut_sites(fragments: DataFrame, tss: DataFrame, flank: int = FLANK) -> DataFrame:
    """cb, position, n: cuts (a fragment's first and last base) at each place around a start site, counted along its strand.

    Start sites: chrom, pos, strand; others than + and - are left out. Only places from -flank to flank count.
    """
    return _counted(fragments, tss, flank, 1)


def _counted(fragments: DataFrame, tss: DataFrame, flank: int, last: int) -> DataFrame:
    """cb, position, n of the cuts lo and hi - last of fragments that overlap a start site's flanks.

    Fragments are dealt by barcode and meet start sites where they are, so what is shuffled is the fragments, and a task counts
    its own barcodes' positions. The number of tasks follows from the fragments' number.
    """
    sites = tss.filter(F.col("strand").isin("+", "-")).select("chrom", "pos", F.when(F.col("strand") == "+", 1).otherwise(-1).alias("_sign"), (F.col("pos") - flank).alias("_lo"), (F.col("pos") + flank + 1).alias("_hi"))
    width = 2 * flank + 1
    binned = sites.select("*", F.explode(intervals.bins("_lo", "_hi", width)).alias("_bin"))
    if sites.count() <= MOST_SITES:  # an annotation's rows, two each; more are joined as Spark plans it
        binned = F.broadcast(binned)
    tasks = max(1, -(-fragments.count() // TASK_FRAGMENTS))
    cuts = fragments.select("chrom", "lo", "hi", "cb").repartition(tasks, "cb").withColumn("at", F.explode(F.array(F.col("lo"), F.col("hi") - last)))
    near = cuts.withColumn("_bin", intervals.bin_of("at", width)).join(binned, ["chrom", "_bin"])
    meet = F.col("at").between(F.col("_lo"), F.col("_hi") - 1) & (F.col("lo") < F.col("_hi")) & (F.col("_lo") < F.col("hi"))
    return near.filter(meet).groupBy("cb", ((F.col("at") - F.col("pos")) * F.col("_sign")).alias("position")).agg(F.count("*").alias("n"))


def _odd(fragments: DataFrame) -> DataFrame:
    """Fragments without length, whose cuts may lie at a site that they don't overlap; few, if any."""
    return fragments.filter(F.col("hi") <= F.col("lo"))


def _places(fragments: DataFrame) -> DataFrame:
    """chrom, at, cb: both cuts of fragments with a length; a cut within the flanks means that the fragment overlaps there."""
    ends = F.explode(F.array(F.col("lo"), F.col("hi") - 1)).alias("at")
    return fragments.filter(F.col("hi") > F.col("lo")).select("chrom", "cb", ends)


def _around(places: DataFrame, tss: DataFrame, flank: int) -> DataFrame:
    """places (chrom, at) with _bin and position, a row for each start site that they are at most flank from."""
    sites = tss.filter(F.col("strand").isin("+", "-")).select("chrom", "pos", F.when(F.col("strand") == "+", 1).otherwise(-1).alias("_sign"), (F.col("pos") - flank).alias("_lo"), (F.col("pos") + flank + 1).alias("_hi"))
    width = 2 * flank + 1
    sites = sites.select("chrom", "pos", "_sign", F.explode(intervals.bins("_lo", "_hi", width)).alias("_bin"))
    near = places.withColumn("_bin", intervals.bin_of("at", width)).join(sites, ["chrom", "_bin"])
    return near.withColumn("position", (F.col("at") - F.col("pos")) * F.col("_sign")).filter(F.col("position").between(-flank, flank)).drop("pos", "_sign")


def sample_cuts(fragments: DataFrame, tss: DataFrame, flank: int = FLANK) -> DataFrame:
    """position, n: cut_sites() of all barcodes together. Cuts are counted by place before they meet start sites, so what
    is joined is bounded by the genome's length."""
    counted = _places(fragments).groupBy("chrom", "at").agg(F.count("*").alias("_c"))
    found = _around(counted, tss, flank).select("position", F.col("_c").alias("n"))
    return found.unionByName(cut_sites(_odd(fragments), tss, flank).select("position", "n")).groupBy("position").agg(F.sum("n").alias("n"))


def dense(cuts: DataFrame, flank: int = FLANK, keys: tuple[str, ...] = ("cb",)) -> DataFrame:
    """A row for every place from -flank to flank of every key, with n = 0 where there is none."""
    grid = cuts.select(*keys).distinct().withColumn("position", F.explode(F.sequence(F.lit(-flank), F.lit(flank))))
    return grid.join(cuts, [*keys, "position"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def profile(cuts: DataFrame, flank: int = FLANK, smooth: int = SMOOTH, ends: int = ENDS, least: float = LEAST_NORM, keys: tuple[str, ...] = ("cb",)) -> DataFrame:
    """keys, position, smoothed (mean of a place and the smooth - 1 before it), normalised (by the mean of both ends, least at least)."""
    w = Window.partitionBy(*keys)
    smoothed = F.avg("n").over(w.orderBy("position").rowsBetween(-(smooth - 1), 0))
    out = dense(cuts, flank, keys).withColumn("smoothed", smoothed)
    head = F.avg(F.when(F.col("position") < -flank + ends, F.col("smoothed"))).over(w)
    tail = F.avg(F.when(F.col("position") > flank - ends, F.col("smoothed"))).over(w)
    return out.withColumn("normalised", F.col("smoothed") / F.greatest((head + tail) / 2, F.lit(least))).select(*keys, "position", "n", "smoothed", "normalised")


def sample_profile(cuts: DataFrame, **options) -> DataFrame:
    """The profile of all barcodes' cuts together: position, n, smoothed, normalised."""
    together = cuts.groupBy("position").agg(F.sum("n").alias("n")).withColumn("all", F.lit(1))
    return profile(together, keys=("all",), **options).drop("all")


def _reach(position: Column, first: int, last: int, smooth: int, flank: int) -> Column:
    """What one cut at `position` adds to the sum of smoothed values over places first to last.

    A cut counts at its own place and the smooth - 1 after it, each time divided by the length of the mean there, which
    is shorter at the start. With W(k) the sum of 1 / min(i, smooth) over i up to k, that is a difference of two W.
    """
    harmonic = [0.0]
    for k in range(1, smooth + 1):
        harmonic.append(harmonic[-1] + 1 / k)

    def w(place: Column) -> Column:
        k = F.greatest(place + flank + 1, F.lit(0))
        return F.element_at(F.array(*map(F.lit, harmonic)), (F.least(k, F.lit(smooth)) + 1).cast("int")) + F.greatest(k - smooth, F.lit(0)) / smooth

    low, high = F.greatest(position, F.lit(first)), F.least(position + smooth - 1, F.lit(last))
    return F.when(low <= high, w(high) - w(low - 1)).otherwise(0.0)


def enrichment(cuts: DataFrame, centre: int = CENTRE, flank: int = FLANK, smooth: int = SMOOTH, ends: int = ENDS, least: float = LEAST_NORM) -> DataFrame:
    """cb, tss_enrichment: mean normalised signal from -centre to centre, the same as from profile().

    Means of smoothed values are weighted sums of cuts, so places without cuts are never made.
    """
    sums = cuts.groupBy("cb").agg(*[F.sum(F.col("n") * x).alias(c) for c, x in _parts(centre, flank, smooth, ends).items()])
    return _level(sums, centre, ends, least)


def _parts(centre: int, flank: int, smooth: int, ends: int) -> dict[str, Column]:
    """What a cut at `position` adds to the sums of smoothed values at both ends and in the middle."""
    bounds = {"_head": (-flank, -flank + ends - 1), "_tail": (flank - ends + 1, flank), "_mid": (-centre, centre)}
    return {c: _reach(F.col("position"), first, last, smooth, flank) for c, (first, last) in bounds.items()}


def _level(sums: DataFrame, centre: int, ends: int, least: float) -> DataFrame:
    level = F.greatest((F.col("_head") + F.col("_tail")) / (2 * ends), F.lit(least))
    return sums.select("cb", (F.col("_mid") / (2 * centre + 1) / level).alias("tss_enrichment"))


def enrichment_of(fragments: DataFrame, tss: DataFrame, centre: int = CENTRE, flank: int = FLANK, smooth: int = SMOOTH, ends: int = ENDS, least: float = LEAST_NORM) -> DataFrame:
    """enrichment() of the fragments' cut_sites(). What a cut adds depends on its place alone, so it is summed over start sites
    once for each place that has cuts, and cuts look it up; there are no rows of barcodes by positions."""
    parts = _parts(centre, flank, smooth, ends)
    cuts = _places(fragments)
    # a bin's places are in one task, so this grouping needs no shuffle
    adds = _around(cuts.select("chrom", "at").distinct(), tss, flank).groupBy("chrom", "_bin", "at").agg(*[F.sum(x).alias(c) for c, x in parts.items()]).drop("_bin")
    odd = cut_sites(_odd(fragments), tss, flank).select("cb", *[(F.col("n") * x).alias(c) for c, x in parts.items()])
    found = cuts.join(adds, ["chrom", "at"]).select("cb", *parts).unionByName(odd)
    return _level(found.groupBy("cb").agg(*[F.sum(c).alias(c) for c in parts]), centre, ends, least)


def cut_matrix(fragments: DataFrame, tss: DataFrame, flank: int = FLANK) -> DataFrame:
    """cb, position, n by the older rule: a fragment's start and its end (not the last base), strands as signs; '.' is left out."""
    return _counted(fragments, tss, flank, 0)
