"""Enrichment of region sets in terms of genes, after McLean et al. (2010).

Each gene has a regulatory domain: a basal part around its start site, and an extension on both sides up to the next gene's
basal part or a largest distance. A term is enriched if more regions lie in its genes' domains than the share of the
genome that these cover explains (binomial), and if more of its genes are hit than a draw of as many genes would (hypergeometric).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats, tails
from . import intervals
from .saving import written

#: Domains are wide, so are the bins in which regions meet them.
_WIDTH = 1 << 19
#: Places are looked up in narrower ones.
_PIECE = 1 << 14


@F.pandas_udf(T.DoubleType())
def _binomial(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(np.exp(tails.log_binomial_tail(k.to_numpy(float), n.to_numpy(float), p.to_numpy(float))))


@F.pandas_udf(T.DoubleType())
def _hypergeometric(k: pd.Series, population: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series(np.exp(tails.log_hypergeometric_tail(*(s.to_numpy(float) for s in (k, population, marked, drawn)))))


def domains(sites: DataFrame, sizes: DataFrame, upstream: int = 5000, downstream: int = 1000, most: int = 1_000_000) -> DataFrame:
    """gene, chrom, lo, hi: regulatory domains of start sites (gene, chrom, pos, strand; '-' is reversed, anything else forward).

    sizes: chrom, lo, hi, a row a chromosome; sites elsewhere have no domain. The basal part is never cut, but by the
    chromosome's ends. Genes that share a place, or whose basal parts overlap, keep both theirs. A gene with several
    sites has as many rows. Windows are over a chromosome's genes, an annotation's rows.
    """
    back = F.col("strand") == "-"
    at = sites.select("gene", "chrom", F.col("pos").cast("long").alias("pos"), "strand").join(sizes.select("chrom", F.col("lo").cast("long").alias("_first"), F.col("hi").cast("long").alias("_last")), "chrom")
    at = at.filter("pos >= _first and pos < _last")
    at = at.withColumn("_b", F.greatest("_first", F.col("pos") - F.when(back, downstream).otherwise(upstream))).withColumn("_e", F.least("_last", F.col("pos") + F.when(back, upstream).otherwise(downstream)))
    order = Window.partitionBy("chrom").orderBy("pos", "gene")
    before = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    back_order = Window.partitionBy("chrom").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, -1)  # a running minimum; one over rows that follow is taken anew for each row
    at = at.withColumns({"_before": before, "_i": F.row_number().over(order)}).withColumn("_after", F.min("_b").over(back_order))
    lo = F.least("_b", F.greatest(F.col("pos") - most, "_first", F.coalesce("_before", "_first")))
    hi = F.greatest("_e", F.least(F.col("pos") + most, "_last", F.coalesce("_after", "_last")))
    return at.select("gene", "chrom", lo.alias("lo"), hi.alias("hi"))


def _middles(regions: DataFrame) -> DataFrame:
    return regions.withColumn("at", F.floor((F.col("lo").cast("long") + F.col("hi")) / 2).cast("long"))


def _hit(regulatory: DataFrame, places: DataFrame) -> DataFrame:
    """gene: those with a place (chrom, at) in a domain; the first place from a domain's start on is looked up, so no pairs are made."""
    asked = regulatory.filter("lo < hi").distinct().withColumn("rid", F.struct("gene", "chrom", "lo", "hi"))
    points = places.select("chrom", F.col("at").alias("lo"), F.col("at").alias("hi"))
    first = intervals.nearest_ends(asked.select("chrom", "lo", F.col("lo").alias("hi"), "rid"), points, width=_PIECE)
    return first.filter(F.col("after") < F.col("rid.hi")).select("rid.gene").distinct()


def _regions_within(places: DataFrame, covered: DataFrame) -> DataFrame:
    """term, regions: places' n within covered (term, chrom, lo, hi: apart within a term), which is cut into pieces of one bin."""
    pieces = covered.filter("lo < hi").select("term", "chrom", "lo", "hi").withColumn("_bin", F.explode(intervals.bins(width=_PIECE)))
    near = places.withColumn("_bin", intervals.bin_of("at", _PIECE)).repartition("chrom", "_bin").join(pieces, ["chrom", "_bin"])
    return near.filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).groupBy("term").agg(F.sum("n").alias("regions"))


def region_genes(regions: DataFrame, regulatory: DataFrame) -> DataFrame:
    """rid, gene: genes in whose domain a region's (chrom, lo, hi, rid) middle lies; each pair once."""
    middles = _middles(regions)
    points = middles.select("chrom", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), "rid")
    found = intervals.pairs(points, regulatory.select("chrom", "lo", "hi", "gene"), width=_WIDTH)
    return found.select(F.col("rid_1").alias("rid"), F.col("gene_2").alias("gene")).distinct()


def enrichment(regions: DataFrame, regulatory: DataFrame, terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row a term (terms: gene, term) that has a gene with a domain: regions (those hit), expected, fold, share (of the genome
    covered), p_binomial, q_binomial, genes (of the term), genes_hit, p_hypergeometric, q_hypergeometric.

    regions: chrom, lo, hi, rid (unique). q values are Benjamini and Hochberg's over all rows. Repeated terms count once.
    No regions: nothing hit, p of 1.
    """
    genes = regulatory.select("gene").distinct()
    of = terms.select("gene", "term").distinct().join(genes, "gene")
    covered = intervals.merged(regulatory.join(of, "gene").select("term", "chrom", "lo", "hi"), keys=("term", "chrom"))
    genome = sizes.agg(F.sum(F.col("hi").cast("long") - F.col("lo")).alias("genome"))
    share = covered.groupBy("term").agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"))
    places = written(_middles(regions).filter("at is not null").groupBy("chrom", "at").agg(F.count("*").alias("n")), "places")
    found = written(_hit(regulatory, places), "genes")
    hits = _regions_within(places, covered).join(of.join(found, "gene").groupBy("term").agg(F.count("*").alias("genes_hit")), "term")
    of_all = regions.agg(F.count("*").alias("n")).crossJoin(found.agg(F.count("*").alias("drawn"))).crossJoin(genes.agg(F.count("*").alias("population"))).crossJoin(genome)  # one row
    out = of.groupBy("term").agg(F.count("*").alias("genes")).join(share, "term").join(hits, "term", "left").crossJoin(F.broadcast(of_all))
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("regions", "genes_hit")}).withColumn("share", F.col("covered") / F.col("genome"))
    out = out.withColumn("expected", F.col("n") * F.col("share"))
    out = out.withColumn("fold", F.when(F.col("expected") > 0, F.col("regions") / F.col("expected")))
    out = out.withColumn("p_binomial", _binomial("regions", "n", "share")).withColumn("p_hypergeometric", _hypergeometric("genes_hit", "population", "genes", "drawn"))
    for kind in ("binomial", "hypergeometric"):
        out = stats.benjamini_hochberg(out.withColumn("_all", F.lit(0)), ["_all"], f"p_{kind}", f"q_{kind}")  # a row a term
    return out.select("term", "regions", "expected", "fold", "share", "p_binomial", "q_binomial", "genes", "genes_hit", "p_hypergeometric", "q_hypergeometric")
