"""Fragments per barcode: counts, sizes, duplicates, filters. Fragments: chrom, lo, hi, cb, score (copies seen), rid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regions import ratio
from . import intervals

#: Fragments below FREE wrap no nucleosome, those from FREE to MONO one.
FREE, MONO = 147, 294


def with_scores(bed: DataFrame) -> DataFrame:
    """chrom, lo, hi, cb, score from a BED frame of four columns or more.

    Where score is missing or text, equal fragments are counted and the count is the score (other columns go);
    else it is cast and rows stay as they are.
    """
    kinds = dict(bed.dtypes)
    if kinds.get("score", "string") == "string":
        return collapsed(bed)
    return bed.withColumn("score", F.col("score").cast("int"))


def collapsed(fragments: DataFrame) -> DataFrame:
    """Distinct fragments, with the number of rows as score."""
    return fragments.groupBy("chrom", "lo", "hi", "cb").agg(F.count("*").cast("int").alias("score"))


def barcode_stats(fragments: DataFrame, more_than: int = 10, collapse: bool = True) -> DataFrame:
    """One row a barcode with more than `more_than` fragments.

    cb, barcode_rank (from 1, by total, ties by cb), total_fragments_count, unique_fragments_count, duplication_count,
    duplication_ratio, nucleosome_signal (infinite or NaN without short fragments). collapse: score counts copies; else
    each row is one fragment.
    """
    length = F.col("hi") - F.col("lo")
    total = F.sum("score") if collapse else F.count("*")
    out = fragments.groupBy("cb").agg(
        total.cast("long").alias("total_fragments_count"), F.count("*").alias("unique_fragments_count"),
        F.count_if((length >= FREE) & (length <= MONO)).alias("_mono"), F.count_if(length < FREE).alias("_free"),
    ).filter(F.col("unique_fragments_count") > more_than)
    extra = F.col("total_fragments_count") - F.col("unique_fragments_count")
    return ranked(out, "total_fragments_count", "cb", "barcode_rank").select(
        "cb", "barcode_rank", "total_fragments_count", "unique_fragments_count", extra.alias("duplication_count"),
        ratio(extra, "total_fragments_count").alias("duplication_ratio"), ratio("_mono", "_free").alias("nucleosome_signal"),
    )


def ranked(df: DataFrame, by: str, tie: str, name: str) -> DataFrame:
    """df with a rank from 1 by `by` descending, then tie.

    Rows of equal value are ranked among themselves, and the one-task window only holds a row for each distinct value;
    so df itself is never sorted in one task.
    """
    values = df.groupBy(by).agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    ahead = values.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(by).orderBy(tie))
    return df.withColumn("_within", within).join(ahead, by).withColumn(name, F.col("_ahead") + F.col("_within")).drop("_within", "_ahead")


def insert_sizes(fragments: DataFrame) -> DataFrame:
    """insert_size, fragments_count, fragments_ratio: how many fragments have each length."""
    sizes = fragments.groupBy(F.abs(F.col("hi") - F.col("lo")).alias("insert_size")).agg(F.count("*").alias("fragments_count"))
    everything = Window.partitionBy(F.lit(0))
    return sizes.withColumn("fragments_ratio", F.col("fragments_count") / F.sum("fragments_count").over(everything))


def passing_barcodes(stats: DataFrame, barcodes: DataFrame | None = None, at_least: int | None = None, top: int | None = None, collapse: bool = True) -> DataFrame:
    """Rows of stats: those in barcodes if given; else with at_least fragments; else the top ones by fragments (ties by cb)."""
    by = "unique_fragments_count" if collapse else "total_fragments_count"
    if barcodes is not None:
        return stats.join(barcodes.select("cb"), "cb", "left_semi")
    if at_least is not None:
        return stats.filter(F.col(by) >= at_least)
    if top is not None:
        return stats.orderBy(F.desc(by), "cb").limit(top)
    raise ValueError("give barcodes, at_least or top")


def of_barcodes(fragments: DataFrame, barcodes: DataFrame, repeat: bool = False) -> DataFrame:
    """Fragments of the barcodes; with repeat, a barcode listed twice gives its fragments twice."""
    return fragments.join(barcodes.select("cb"), "cb", "inner" if repeat else "left_semi").select(*fragments.columns)


def in_regions(fragments: DataFrame, regions: DataFrame, rid: str = "rid") -> DataFrame:
    """cb, total_fragments_in_peaks_count, unique_fragments_in_peaks_count: fragments that hit a region, each once."""
    hits = intervals.overlap(fragments, regions, "semi", rid)
    return hits.groupBy("cb").agg(F.sum("score").cast("long").alias("total_fragments_in_peaks_count"), F.count("*").alias("unique_fragments_in_peaks_count"))


def with_fraction_in_peaks(stats: DataFrame, in_peaks: DataFrame) -> DataFrame:
    """stats joined with in_regions(); barcodes without hits have 0."""
    zero = F.lit(0).cast("long")
    out = stats.join(in_peaks, "cb", "left").withColumns({c: F.coalesce(c, zero) for c in in_peaks.columns if c != "cb"})
    return out.withColumn("fraction_of_fragments_in_peaks", ratio("unique_fragments_in_peaks_count", "unique_fragments_count"))


def pseudobulk(fragments: DataFrame, cells: DataFrame, label: str, sample: str | None = None) -> DataFrame:
    """Fragments of labelled barcodes with their label; cells: cb, label and, with sample, the sample's column too."""
    keys = ["cb"] + [sample] * bool(sample)
    return fragments.join(cells.select(*keys, label).filter(F.col(label).isNotNull()), keys)


def coverage(fragments: DataFrame, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Depth along each chromosome as runs: by, lo, hi, depth (> 0), from starts and ends added up in order."""
    keys = list(by)
    step = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d"))))
    steps = fragments.filter("hi > lo").select(*keys, step.alias("s")).groupBy(*keys, F.col("s.at").alias("lo")).agg(F.sum("s.d").alias("d"))
    binned = steps.withColumn("_bin", intervals.bin_of("lo", 1 << 20))
    inside = Window.partitionBy(*keys, "_bin").orderBy("lo")
    bins = Window.partitionBy(*keys).orderBy("_bin")
    carried = binned.groupBy(*keys, "_bin").agg(F.sum("d").alias("_d"), F.min("lo").alias("_first")).select(
        *keys, "_bin", F.coalesce(F.sum("_d").over(bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(bins).alias("_next")
    )
    depth = F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = binned.withColumn("_depth", depth).withColumn("_lead", F.lead("lo").over(inside)).join(carried, [*keys, "_bin"])
    return out.select(*keys, "lo", F.coalesce("_lead", "_next").alias("hi"), (F.col("_depth") + F.col("_before")).alias("depth")).filter("depth > 0")
