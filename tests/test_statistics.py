import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from accessum.functions import stats
from accessum.functions.regions import ratio
from accessum.operators import dataset, density, diff, embed, models, peaks, thresholds, topics


def test_ieee_ratio(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (0, 0), (-1, 0)], "a int, b int").select(ratio("a", "b").alias("x"))
    a, b, c, d = [r.x for r in df.collect()]
    assert (a, b, d) == (0.5, math.inf, -math.inf) and math.isnan(c)


def histogram(x, bins):
    n, edges = np.histogram(x, bins)
    return n, (edges[1:] + edges[:-1]) / 2


def test_thresholds_against_numpy(spark):
    r = np.random.default_rng(4)
    groups = {"g": np.concatenate([r.normal(0, 1, 300), r.normal(6, 1, 200)]), "h": r.exponential(2, 400)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("g", None)], "k string, x double")
    got = {f.__name__: {x.k: x.threshold for x in f(df, "x", ("k",), 60).collect()} for f in (thresholds.otsu, thresholds.yen, thresholds.li)}
    for k, x in groups.items():
        n, c = histogram(x, 60)
        w1, w2 = np.cumsum(n), np.cumsum(n[::-1])[::-1]
        m1, m2 = np.cumsum(n * c) / w1, np.cumsum((n * c)[::-1])[::-1] / w2
        assert got["otsu"][k] == pytest.approx(c[np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)])
        p = n / n.sum()
        p1, q1, q2 = np.cumsum(p), np.cumsum(p**2), np.cumsum((p**2)[::-1])[::-1]
        assert got["yen"][k] == pytest.approx(c[np.argmax(np.log((p1[:-1] * (1 - p1[:-1])) ** 2 / (q1[:-1] * q2[1:])))])
        best = []
        with np.errstate(all="ignore"):
            for t in np.arange(x.min() + 0.01, x.max() - 0.01, 0.01):
                up = c > t
                a, b = (n * c)[~up].sum(), (n * c)[up].sum()
                cost = -a * np.log(a / n[~up].sum()) - b * np.log(b / n[up].sum())
                if a > 0 and b > 0:
                    best.append((cost, t))
        assert got["li"][k] == pytest.approx(min(best)[1], abs=1e-6)


def test_thresholds_of_one_value(spark):
    df = spark.createDataFrame([("one", 3.0)] * 4 + [("two", 1.0), ("two", 5.0), ("null", None)], "k string, x double")
    for f in (thresholds.otsu, thresholds.yen, thresholds.li):
        assert {r.k for r in f(df, "x", ("k",)).collect()} <= {"two"}
        assert not f(df.filter("k = 'null'"), "x", ("k",)).collect()
    assert [r.k for r in thresholds.otsu(df, "x", ("k",)).collect()] == ["two"]


def test_gini_with_zeros_and_bh(spark):
    x = [0, 0, 0, 1, 2, 2, 7]
    df = spark.createDataFrame([("a", float(v)) for v in x if v], "k string, v double")
    n, s = len(x), sorted(x)
    want = sum((2 * (i + 1) - n - 1) * v for i, v in enumerate(s)) / (n * sum(x))
    assert stats.gini(df, "k", "v", n).first().gini == pytest.approx(want)
    p = [0.01, 0.02, 0.02, 0.5, 0.9, 0.04]
    out = stats.benjamini_hochberg(spark.createDataFrame([("a", v) for v in p], "k string, p double"), ["k"], "p").collect()
    order = sorted(p)
    for r in out:
        assert r.adjusted == pytest.approx(min(1, min(order[j] * len(p) / (j + 1) for j in range(len(p)) if order[j] >= r.p)))


def test_rank_sums_against_dense(spark):
    r = np.random.default_rng(2)
    x = r.poisson(0.7, (12, 30))
    cells = spark.createDataFrame([(i, "a" if i < 11 else "b") for i in range(30)], "cell_id long, grp string")
    values = spark.createDataFrame([(f, c, int(x[f, c])) for f in range(12) for c in range(30) if x[f, c]], "region_id long, cell_id long, value int")
    got = {(o.contrast, o.region_id): o for o in diff.marker_statistics(values, diff.one_against_rest(cells, "grp")).collect()}
    fg = np.arange(30) < 11
    for f in range(12):
        order = np.array([(np.sum(x[f] < v) + (np.sum(x[f] == v) + 1) / 2) for v in x[f]])
        z = (order[fg].sum() - 11 * 31 / 2) / math.sqrt(11 * 19 * 31 / 12)
        assert got["a", f].z == pytest.approx(z) and got["b", f].z == pytest.approx(-z)
        assert got["a", f].log2fc == pytest.approx(math.log2((x[f, fg].mean() + 1e-12) / (x[f, ~fg].mean() + 1e-12)))
    kept = diff.markers(values, diff.one_against_rest(cells, "grp"), adjusted=1.0, log2fc=-99)
    for o in kept.collect():
        assert 0 <= o.adjusted_pval <= 1


def test_density_against_numpy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 2)) @ np.array([[1, 0.4], [0, 0.7]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(999, None, 1.0)], "i int, x double, y double")
    h = np.cov(x.T) * len(x) ** (-1 / 3)
    got = {o.i: o.density for o in density.density(df, "x", "y").collect()}
    d = x[:, None] - x
    want = np.exp(-0.5 * np.einsum("abi,ij,abj->ab", d, np.linalg.inv(h), d)).sum(1) / (2 * np.pi * np.sqrt(np.linalg.det(h)) * len(x))
    assert got[999] is None and np.allclose([got[i] for i in range(200)], want)
    near = {o.i: o.density for o in density.density(df, "x", "y", exact_up_to=50).collect()}
    assert np.allclose([near[i] for i in range(200)], want, rtol=0.02)


def greedy(rows):
    """Best first; what overlaps a kept peak goes."""
    kept = []
    for p in sorted(rows, key=lambda p: (-p[3], p[1], p[2])):
        if all(p[0] != k[0] or p[1] >= k[2] or k[1] >= p[2] for k in kept):
            kept.append(p)
    return sorted(k[4] for k in kept)


def test_greedy_peaks(spark):
    r = np.random.default_rng(6)
    rows = [(str(r.integers(2)), int(s := r.integers(0, 900)), int(s + r.integers(5, 80)), float(r.random()), f"p{i}") for i in range(120)]
    rows += [("z", 0, 10, 1.0, "A"), ("z", 8, 20, 3.0, "B"), ("z", 18, 30, 2.0, "C"), ("z", 40, 50, 1.0, "D"), ("z", 50, 60, 1.0, "E")]
    kept = peaks.best_of_clusters(spark.createDataFrame(rows, "chrom string, lo int, hi int, score double, name string"))
    assert sorted(x.name for x in kept.collect()) == greedy(rows)


def test_consensus_rows_against_plain(spark):
    """Every row: widened, thinned within groups, per million, thinned again."""
    from accessum.plans import catalogue
    from accessum.plans.registry import Views

    v = Views(spark, "/root/testdata/sf0.001")
    size = {r.chrom: (r.lo, r.hi) for r in v.chromsizes.collect()}
    banned = [(r.chrom, r.lo, r.hi) for r in v.blacklist.collect()]
    groups = {}
    for r in v.peaks.collect():
        p = (r.chrom, r.lo + r.summit - 250, r.lo + r.summit + 251, r.score, r.name)
        if r.chrom in size and size[r.chrom][0] <= p[1] and p[2] <= size[r.chrom][1] and not any(b[0] == p[0] and p[1] < b[2] and b[1] < p[2] for b in banned):
            groups.setdefault(r.grp, []).append(p)

    def thinned(rows):
        names = set(greedy(sorted(rows, key=lambda p: p[4], reverse=True)))
        return [p for p in rows if p[4] in names]

    union = []
    for rows in groups.values():
        kept = thinned(rows)
        total = sum(p[3] for p in kept)
        union += [(*p[:3], p[3] * 1e6 / total, p[4]) for p in kept]
    want = sorted((c, lo + 1, hi, name, round(s, 3)) for c, lo, hi, s, name in thinned(union))
    got = catalogue.QUERIES["consensus_peaks"](spark, v.sf_dir).collect()
    assert sorted((r.chrom, r.lo, r.hi, r.name, round(r.score, 3)) for r in got) == want and want


def test_markers_against_plain(spark):
    """Planted groups, so that the p bound leaves some features out and keeps others."""
    r = np.random.default_rng(11)
    x = r.poisson(0.6, (20, 40))
    x[:3, :20] += r.poisson(3, (3, 20))  # three features of the first group
    cells = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(40)], "cell_id long, grp string")
    values = spark.createDataFrame([(f, c, int(x[f, c])) for f in range(20) for c in range(40) if x[f, c]], "region_id long, cell_id long, value int")
    got = {(o.contrast, o.region_id): (o.log2fc, o.adjusted_pval) for o in diff.markers(values, diff.one_against_rest(cells, "grp")).collect()}
    want = {}
    for name, fg in (("a", np.arange(40) < 20), ("b", np.arange(40) >= 20)):
        p, fold = [], []
        for f in range(20):
            ranks = np.array([np.sum(x[f] < v) + (np.sum(x[f] == v) + 1) / 2 for v in x[f]])
            z = (ranks[fg].sum() - 20 * 41 / 2) / math.sqrt(20 * 20 * 41 / 12)
            p.append(math.erfc(abs(z) / math.sqrt(2)))
            fold.append(math.log2((x[f, fg].mean() + 1e-12) / (x[f, ~fg].mean() + 1e-12)))
        order = sorted(p)
        for f in range(20):
            adjusted = min(1, min(order[j] * 20 / (j + 1) for j in range(20) if order[j] >= p[f]))
            if adjusted <= 0.05 and fold[f] >= math.log2(1.5):
                want[name, f] = (fold[f], adjusted)
    assert set(got) == set(want) and {("a", 0), ("a", 1), ("a", 2)} <= set(want)
    for k, pair in want.items():
        assert got[k] == pytest.approx(pair)


def test_divergence_against_numpy(spark):
    r = np.random.default_rng(3)
    topic, cell, size = r.dirichlet(np.ones(12), 3), r.dirichlet(np.ones(3), 9), r.integers(5, 50, 9)
    tr = spark.createDataFrame([(w, t + 1, float(topic[t, w])) for t in range(3) for w in range(12)], "region_id int, topic int, p double")
    ct = spark.createDataFrame([(c, t + 1, float(cell[c, t])) for c in range(9) for t in range(3)], "cell_id int, topic int, p double")
    sizes = spark.createDataFrame([(c, int(n)) for c, n in enumerate(size)], "cell_id int, nr_frag int")
    one, two = np.linalg.svd(topic, compute_uv=False), np.sort(size @ cell)[::-1]
    p, q = one / one.sum(), two / two.sum()
    assert models.divergence(tr, ct, sizes).first().divergence == pytest.approx(float((p * np.log(p / q)).sum() + (q * np.log(q / p)).sum()))


def test_knn_votes_and_communities(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.3, (25, 4)) + [1, 0, 0, 0], r.normal(0, 0.3, (25, 4)) + [0, 0, 1, 0]])
    df = spark.createDataFrame([(i, [float(v) for v in row], "ab"[i >= 25]) for i, row in enumerate(x)], "cell_id long, x array<double>, label string")
    near = embed.knn(df.select("cell_id", "x"), 4, block_rows=20).collect()
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {(o.cell_id, o.neighbour) for o in near} == {(i, int(j)) for i in range(50) for j in np.argsort(d[i])[:4]}
    votes = embed.label_votes(df.filter("cell_id % 2 = 1").drop("label"), df.filter("cell_id % 2 = 0")).filter("best").collect()
    assert sum((o.label == "b") == (o.cell_id >= 25) for o in votes) >= 23
    groups = embed.communities(embed.edges(embed.knn(df.select("cell_id", "x"), 4)))
    assert groups.count() == 50


def test_planted_topics_and_choice(spark):
    r = np.random.default_rng(5)
    rows = [(c, 100 * (c % 3) + int(k), 1) for c in range(60) for k in r.choice(30, 12, replace=False)]
    m = models.fit(spark.createDataFrame(rows, "cell_id long, region_id long, n int"), 3, 30, alpha=1.0)
    top = m.cell_topic.groupBy("cell_id").agg(F.max_by("topic", "p").alias("t")).collect()
    assert len({(o.cell_id % 3, o.t) for o in top}) == 3
    mass = [o[0] for o in m.topic_region.groupBy("topic").agg(F.sum("p")).select("sum(p)").collect()]
    assert np.allclose(mass, 1)
    assert 0 <= models.cosine_density(m.topic_region).first()[0] <= 1
    sizes = m.cell_topic.select("cell_id", F.lit(12).alias("nr_frag")).distinct()
    assert models.divergence(m.topic_region, m.cell_topic, sizes).first().divergence >= 0


def test_imputation_blocks_and_binarization(spark):
    tr = spark.createDataFrame([(f"r{i}", t, (i + t) / 50) for i in range(9) for t in (1, 2)], "region_id string, topic int, p double")
    ct = spark.createDataFrame([(c, t, (c + t) / 20) for c in range(5) for t in (1, 2)], "cell_id long, topic int, p double")
    long = {(x.region_id, x.cell_id): x.value for x in diff.imputed(tr, ct, 1013).collect()}
    for x in diff.imputed_blocks(tr, ct, 1013).collect():
        assert list(x["values"]) == [long.get((x.region_id, c), 0) for c in range(5)]
    with pytest.raises(ValueError):
        diff.imputed_blocks(tr, ct, most_cells=2)
    assert topics.binarized(tr, "region_id", "ntop", ntop=3).count() == 6
    with pytest.raises(ValueError):
        topics.cutoffs(tr, "region_id", "guess")


def test_imputed_in_blocks(spark):
    """Absent topics, repeated rows, null topics and empty tables; many blocks give what one gives."""
    tr = [(1, 1, 0.5), (1, 2, 0.25), (2, 2, 0.5), (2, 2, 0.25), (3, 9, 1.0), (4, None, 1.0)] + [(r, 1, r / 100) for r in range(5, 30)]
    ct = [(1, 1, 0.75), (1, 2, 0.25), (2, 2, 1.0), (3, None, 1.0)] + [(c, 1, c / 50) for c in range(4, 20)]
    kinds = "region_id long, topic int, p double", "cell_id long, topic int, p double"
    a, b = spark.createDataFrame(tr, kinds[0]), spark.createDataFrame(ct, kinds[1])
    want = {}
    for r, t, p in tr:
        for c, u, q in ct:
            if t is not None and t == u:
                want[r, c] = want.get((r, c), 0) + p * q
    for rows in (4, 2048):
        got = {(x.region_id, x.cell_id): x.value for x in diff.imputed(a, b, 1, rows).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert diff.imputed(a.limit(0), b, 1).count() == 0 and diff.imputed(a, b.limit(0), 1).count() == 0


def test_communities_are_the_plain_rounds(spark):
    """Two crowds with few links between them, a chain, and a pair; rounds until labels stand or swap to and fro."""
    r = np.random.default_rng(8)
    links = {(min(a, b), max(a, b)) for k in (0, 100) for a, b in (r.integers(0, 30, (150, 2)) + k).tolist() if a != b} | {(3, 104), (500, 501)} | {(600 + i, 601 + i) for i in range(9)}
    near = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label, before = {a: a for a in near}, []
    while True:
        new = {}
        for a, others in near.items():
            votes = [label[b] for b in others] + [label[a]]
            new[a] = min(set(votes), key=lambda x: (-votes.count(x), x))
        before.append(new)
        label = new
        if new in before[-3:-1]:
            break
    df = spark.createDataFrame(sorted(links), "a long, b long")
    assert {x.cell_id: x.community for x in embed.communities(df).collect()} == label


def test_merge_of_three_keeps_coordinates(spark):
    parts = []
    for k, ids in enumerate((["c1:0-10", "c1:5-20"], ["c1:5-20", "c2:1-4"], ["c2:1-4", "c3:7-9"])):
        counts = spark.createDataFrame([(x, f"cell{k}{i}", 1 + i) for x in ids for i in range(2)], "region_id string, cell_id string, n int")
        parts.append(dataset.Dataset.create(counts, "p"))
    got = {x.region_id: (x.chrom, x.lo, x.hi, x.width, x.nr_frag) for x in parts[0].merge(*parts[1:]).regions.collect()}
    assert got == {"c1:0-10": ("c1", 0, 10, 10, 3), "c1:5-20": ("c1", 5, 20, 15, 6), "c2:1-4": ("c2", 1, 4, 3, 6), "c3:7-9": ("c3", 7, 9, 2, 3)}
