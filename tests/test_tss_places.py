import random

import pytest
from pyspark.sql import functions as F

from accessum.operators import tss


def test_sums_by_place_are_those_of_cuts(spark):
    """Fragments with and without length, at sites of both strands that share flanks."""
    rnd = random.Random(3)
    frags = [("c%d" % rnd.randint(0, 1), lo := rnd.randint(-60, 400), lo + rnd.choice([0, 1, 2, 30, 90]), "b%d" % rnd.randint(0, 5)) for _ in range(400)]
    frags += [("c0", 80, 80, "only"), ("c0", 350, 340, "back"), (None, 1, 5, "b0"), ("c0", None, 5, "b0")]
    sites = [("c0", 100, "+"), ("c0", 100, "+"), ("c0", 117, "-"), ("c1", 5, "-"), ("c1", 300, "."), ("c1", 333, "+")]
    f = spark.createDataFrame(frags, "chrom string, lo int, hi int, cb string")
    t = spark.createDataFrame(sites, "chrom string, pos int, strand string")
    cuts = tss.cut_sites(f, t, 20)
    together = {r[0]: r[1] for r in cuts.groupBy("position").agg(F.sum("n")).collect()}
    assert {r.position: r.n for r in tss.sample_cuts(f, t, 20).collect()} == together
    o = dict(centre=3, flank=20, smooth=4, ends=5)
    want = {r.cb: r.tss_enrichment for r in tss.enrichment(cuts, **o).collect()}
    assert {r.cb: r.tss_enrichment for r in tss.enrichment_of(f, t, **o).collect()} == pytest.approx(want)


def test_no_rows_of_barcodes_by_positions(spark, monkeypatch):
    """Barcodes meet positions for fragments without length only, of which there are none here."""
    from accessum.plans import catalogue

    seen, plain = [], tss.cut_sites
    monkeypatch.setattr(tss, "cut_sites", lambda f, *a: seen.append(f) or plain(f, *a))
    for name in ("tss_enrichment_per_cell", "tss_profile_sample"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [f.count() for f in seen] == [0, 0]
