"""Quality control of barcodes, from fragments to the barcodes that pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import density, fragments, thresholds, tss
from ..operators.saving import saved

COUNTS = ("total_fragments_count", "unique_fragments_count", "total_fragments_in_peaks_count", "unique_fragments_in_peaks_count")


def barcode_frip(frags: DataFrame, regions: DataFrame, more_than: int = 10, collapse: bool = True) -> DataFrame:
    """Barcode stats with the fraction of fragments in regions."""
    return fragments.with_fraction_in_peaks(fragments.barcode_stats(frags, more_than, collapse), fragments.in_regions(frags, regions))


def barcode_qc(frags: DataFrame, regions: DataFrame, sites: DataFrame, more_than: int = 10, collapse: bool = True, densities: bool = True, **tss_options) -> DataFrame:
    """All per-barcode measures: counts with logarithms, duplicates, fraction in peaks, nucleosome signal, enrichment at
    start sites (0 without any) and the densities of three measures against the logarithm of unique fragments."""
    stats = barcode_frip(frags, regions, more_than, collapse)
    stats = stats.withColumns({f"log10_{c}": F.log10(F.col(c) + 1) for c in COUNTS})
    near = tss.enrichment_of(frags, sites, **tss_options)
    stats = stats.join(near, "cb", "left").withColumn("tss_enrichment", F.coalesce("tss_enrichment", F.lit(0.0)))
    if densities:  # each reads the measures a few times
        stats = saved(stats)
    for m in ("tss_enrichment", "fraction_of_fragments_in_peaks", "duplication_ratio") if densities else ():
        stats = density.density(stats, "log10_unique_fragments_count", m, f"density_{m}")
    return stats


def otsu_thresholds(stats: DataFrame, least_fragments: int = 100, least_tss: float = 1.0, bins: int = 5000) -> DataFrame:
    """One row: fragments (10 to the threshold of log10 unique fragments) and tss_enrichment thresholds, among barcodes at
    or above the least values; null where there are none."""
    log = F.log10("unique_fragments_count")
    a = thresholds.otsu(stats.filter(F.col("unique_fragments_count") >= least_fragments).select(log.alias("v")), "v", (), bins)
    b = thresholds.otsu(stats.filter(F.col("tss_enrichment") >= least_tss), "tss_enrichment", (), bins)
    one = stats.sparkSession.range(1)
    return one.join(a.select(F.pow(F.lit(10.0), F.col("threshold")).alias("unique_fragments")), how="left").join(b.select(F.col("threshold").alias("tss_enrichment")), how="left").drop("id")


def passing(stats: DataFrame, cuts: DataFrame | None = None, fragments_above: float | None = None, tss_above: float | None = None, frip_above: float = 0.0) -> DataFrame:
    """cb of barcodes strictly above all thresholds; those not given come from cuts (otsu_thresholds()), else are 0."""
    if cuts is None:
        cuts = stats.sparkSession.createDataFrame([(0.0, 0.0)], "unique_fragments double, tss_enrichment double")
    c = cuts.select(F.coalesce(F.lit(fragments_above), "unique_fragments", F.lit(0.0)).alias("_f"), F.coalesce(F.lit(tss_above), "tss_enrichment", F.lit(0.0)).alias("_t"))
    ok = (F.col("unique_fragments_count") > F.col("_f")) & (F.col("tss_enrichment") > F.col("_t")) & (F.col("fraction_of_fragments_in_peaks") > frip_above)
    return stats.crossJoin(F.broadcast(c)).filter(ok).select("cb")  # c: one row


def run(frags: DataFrame, regions: DataFrame, sites: DataFrame, prefix: str, **options) -> DataFrame:
    """Write barcode measures, insert sizes, the start-site profile, thresholds and passing barcodes; give the last."""
    from ..sources.tables import write_qc

    stats = barcode_qc(frags, regions, sites, **options)
    write_qc({"barcode_stats": stats, "insert_sizes": fragments.insert_sizes(frags), "tss_profile": tss.sample_profile(tss.sample_cuts(frags, sites))}, prefix)
    stats = frags.sparkSession.read.parquet(f"{prefix}.barcode_stats.parquet")
    cuts = otsu_thresholds(stats)
    good = passing(stats, cuts)
    write_qc({"thresholds": cuts, "barcodes": good}, prefix)
    return good
