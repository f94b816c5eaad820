"""Signatures: region sets as features, and the area under the recovery curve of each cell's ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals


def signature_regions(target: DataFrame, signatures: DataFrame) -> DataFrame:
    """signature, region_id: regions of target (chrom, lo, hi, rid) that some interval of a signature hits."""
    found = intervals.pairs(target.select("chrom", "lo", "hi", "rid"), signatures.select("chrom", "lo", "hi", "signature"))
    return found.select(F.col("signature_2").alias("signature"), F.col("rid_1").alias("region_id")).distinct()


def recovery(rankings: DataFrame, signatures: DataFrame, feature: str = "region_id", share: float = 0.05, total: int | None = None) -> DataFrame:
    """cell_id, signature, auc: area under the recovery curve within the top `share` of each cell's ranking, by its largest possible.

    rankings: cell_id, feature, rank (from 0). The cutoff is share * features (rounded down, 1 at least); a member at
    rank r below the cutoff adds cutoff - r. A cell without members in the top has no row.
    """
    n = total if total is not None else rankings.select(feature).distinct().count()
    cutoff = max(1, int(share * n))
    sizes = signatures.groupBy("signature").agg(F.count("*").alias("_n"))
    hits = rankings.filter(F.col("rank") < cutoff).join(signatures, feature)
    area = hits.groupBy("cell_id", "signature").agg(F.sum(F.lit(cutoff) - F.col("rank")).alias("_a")).join(sizes, "signature")
    k = F.least(F.col("_n"), F.lit(cutoff))
    return area.select("cell_id", "signature", (F.col("_a") / (k * cutoff - k * (k - 1) / 2)).alias("auc"))


def term_regions(table: DataFrame, term: str, term_col: str = "term", regions_col: str = "regions") -> DataFrame:
    """region: the distinct regions of a term in an enrichment table that lists them with commas."""
    each = table.filter(F.col(term_col) == term).select(F.explode(F.split(regions_col, ",")).alias("region"))
    return each.select(F.trim("region").alias("region")).filter("region <> ''").distinct()
