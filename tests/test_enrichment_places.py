import random

from accessum.operators import enrichment, intervals


def test_regions_and_genes_hit_without_pairs(spark, monkeypatch):
    """Domains and places that crowd: the counts are those of loops, and regions never meet genes in pairs."""
    rnd = random.Random(7)
    regions = [("c%d" % rnd.randint(0, 1), lo := rnd.randint(0, 200_000), lo + rnd.randint(0, 9), i) for i in range(200)] + [("c0", None, 5, 900), (None, 1, 2, 901)]
    doms = [("g%d" % rnd.randint(0, 39), "c%d" % rnd.randint(0, 1), lo := rnd.randint(0, 190_000), lo + rnd.choice([1, 50, 4000, 90_000])) for _ in range(60)]
    terms = [("g%d" % g, "t%d" % t) for g in range(40) for t in range(5) if rnd.random() < 0.3] + [("nowhere", "t0")]
    met = {(r[3], g) for r in regions for g, c, lo, hi in doms if r[0] == c and r[1] is not None and lo <= (r[1] + r[2]) // 2 < hi}
    known = {g for g, *_ in doms}
    of = {(g, t) for g, t in terms if g in known}
    want = {t: (len({r for r, g in met if (g, t) in of}), len({g for _, g in met if (g, t) in of})) for _, t in of}
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    monkeypatch.setattr(intervals, "pairs", None)
    out = enrichment.enrichment(f(regions, "chrom string, lo int, hi int, rid long"), f(doms, "gene string, chrom string, lo long, hi long"), f(terms, "gene string, term string"), f([("c0", 0, 200_009), ("c1", 0, 200_009)], "chrom string, lo int, hi int"))
    assert {r.term: (r.regions, r.genes_hit) for r in out.collect()} == want
