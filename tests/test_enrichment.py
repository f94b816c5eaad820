"""Tails, domains and enrichment against plain Python with whole numbers and fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from accessum.functions import stats, tails
from accessum.operators import enrichment


def test_binomial_tail_against_fractions():
    cases = [(k, n, p) for n in (1, 5, 40, 300) for k in {0, 1, n // 3, n // 2, n - 1, n, n + 1} for p in (0.001, 0.2, 0.5, 0.97)]
    got = tails.log_binomial_tail(*(np.array(x) for x in zip(*cases)))
    for (k, n, p), g in zip(cases, got):
        want = sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k, n + 1))
        assert math.exp(g) == pytest.approx(float(want), rel=1e-9, abs=1e-300)
    far = tails.log_binomial_tail(np.array([5000]), np.array([100_000]), np.array([0.01]))[0]
    assert -6000 < far < -700  # far below the least double


def test_hypergeometric_tail_against_whole_numbers():
    r = random.Random(3)
    cases = [(k, n, m, d) for n in (10, 60, 2000) for m in {1, n // 3, n} for d in {0, 1, n // 2, n} for k in {0, 1, r.randint(0, n), m, m + 1}]
    got = tails.log_hypergeometric_tail(*(np.array(x) for x in zip(*cases)))
    for (k, n, m, d), g in zip(cases, got):
        want = Fraction(sum(math.comb(m, i) * math.comb(n - m, d - i) for i in range(k, min(m, d) + 1) if d - i <= n - m), math.comb(n, d))
        assert math.exp(g) == pytest.approx(float(want), rel=1e-8, abs=1e-250), (k, n, m, d)


def test_normal_tail_against_erfc(spark):
    z = [-40.0, -3.0, -0.5, 0.0, 1e-9, 0.3, 2.0, 2.8284, 2.8285, 5.0, 10.0, 37.0]
    assert tails.normal_tail(np.array(z)) == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in z], rel=1e-12)
    got = [r[0] for r in spark.createDataFrame([(1.5,), (None,)], "z double").select(stats.normal_tail("z")).collect()]
    assert got == [pytest.approx(0.5 * math.erfc(1.5 / math.sqrt(2))), None]


def plain_domains(sites, sizes, up=5000, down=1000, most=1_000_000):
    basal = {}
    for g, c, p, s in sites:
        if c in sizes and sizes[c][0] <= p < sizes[c][1]:
            lo, hi = (p - down, p + up) if s == "-" else (p - up, p + down)
            basal[g] = (c, p, max(lo, sizes[c][0]), min(hi, sizes[c][1]))
    out = {}
    for g, (c, p, lo, hi) in basal.items():
        left = [e for h, (d, q, _, e) in basal.items() if d == c and (q, h) < (p, g)]
        right = [b for h, (d, q, b, _) in basal.items() if d == c and (q, h) > (p, g)]
        out[g] = (c, min(lo, max([p - most, sizes[c][0], *left])), max(hi, min([p + most, sizes[c][1], *right])))
    return out


def made(seed=5):
    r = random.Random(seed)
    sizes = {"a": (0, 3_000_000), "b": (0, 40_000)}
    sites = [(f"g{i}", r.choice("aaab"), 0, r.choice("+-.")) for i in range(60)]
    sites = [(g, c, r.randrange(sizes[c][1]), s) for g, c, _, s in sites] + [("out", "a", 3_000_001, "+"), ("else", "z", 5, "+"), ("twin", "a", 500, "+"), ("twin2", "a", 500, "-")]
    regions = [(c, lo, lo + r.randrange(1, 3000), i) for i, (c, lo) in enumerate((c, r.randrange(sizes[c][1])) for c in ["a"] * 500 + ["b"] * 80)]
    terms = [(g, f"t{r.randrange(9)}") for g, *_ in sites for _ in range(3)] + [("nobody", "t0"), ("nobody", "none")]
    return sites, sizes, regions, terms


def test_whole_enrichment_against_plain_python(spark):
    sites, sizes, regions, terms = made()
    s = spark.createDataFrame(sites, "gene string, chrom string, pos long, strand string")
    z = spark.createDataFrame([(c, *x) for c, x in sizes.items()], "chrom string, lo int, hi int")
    regulatory = enrichment.domains(s, z)
    dom = {r["gene"]: (r["chrom"], r["lo"], r["hi"]) for r in regulatory.collect()}
    assert dom == plain_domains(sites, sizes)
    got = enrichment.enrichment(spark.createDataFrame(regions, "chrom string, lo int, hi int, rid long"), regulatory, spark.createDataFrame(terms, "gene string, term string"), z)
    rows = {r["term"]: r for r in got.collect()}
    hit = {g: {i for c, lo, hi, i in regions if c == d and a <= (lo + hi) // 2 < b} for g, (d, a, b) in dom.items()}
    drawn = sum(bool(h) for h in hit.values())
    genome = sum(hi - lo for lo, hi in sizes.values())
    assert set(rows) == {t for g, t in terms if g in dom}
    ps = {"binomial": {}, "hypergeometric": {}}
    for t, r in rows.items():
        own = {g for g, x in terms if x == t and g in dom}
        share = len({(dom[g][0], p) for g in own for p in range(dom[g][1] // 50, -(-dom[g][2] // 50))}) * 50 / genome
        k, kg = len(set().union(*(hit[g] for g in own))), sum(bool(hit[g]) for g in own)
        assert (r["regions"], r["genes"], r["genes_hit"]) == (k, len(own), kg) and r["share"] == pytest.approx(share, rel=0.01)
        q = r["share"]
        ps["binomial"][t] = sum(math.comb(580, i) * q**i * (1 - q) ** (580 - i) for i in range(k, 581))
        ps["hypergeometric"][t] = sum(math.comb(len(own), i) * math.comb(len(dom) - len(own), drawn - i) for i in range(kg, min(len(own), drawn) + 1)) / math.comb(len(dom), drawn)
        assert r["expected"] == pytest.approx(580 * q) and r["fold"] == pytest.approx(k / (580 * q))
    for kind, p in ps.items():
        order = sorted(p, key=p.get)
        for t, r in rows.items():
            assert r[f"p_{kind}"] == pytest.approx(p[t], rel=1e-8)
            assert r[f"q_{kind}"] == pytest.approx(min(1, *(p[u] * len(p) / (i + 1) for i, u in enumerate(order) if p[u] >= p[t])), rel=1e-8)


def test_planted_term_stands_out_and_no_regions(spark):
    sites, sizes, regions, terms = made()
    s = spark.createDataFrame(sites, "gene string, chrom string, pos long, strand string")
    z = spark.createDataFrame([(c, *x) for c, x in sizes.items()], "chrom string, lo int, hi int")
    dom = enrichment.domains(s, z)
    near = [(c, p, p + 10, i) for i, (g, c, p, _) in enumerate(sites[:10] * 5)]
    planted = spark.createDataFrame([(g, "planted") for g, *_ in sites[:10]] + terms, "gene string, term string")
    got = enrichment.enrichment(spark.createDataFrame(near, "chrom string, lo int, hi int, rid long"), dom, planted, z)
    assert got.orderBy("p_binomial").first()["term"] == "planted"
    none = enrichment.enrichment(spark.createDataFrame([], "chrom string, lo int, hi int, rid long"), dom, planted, z)
    assert none.filter((F.col("p_binomial") != 1) | (F.col("regions") != 0) | (F.col("p_hypergeometric") != 1)).count() == 0
