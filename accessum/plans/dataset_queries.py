"""Counts, cells and regions; peaks; markers; genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import dataset, diff, genes, peaks
from ..sources import tables
from .registry import Views, query, rounded

_OF = "{key}, sum(n)::BIGINT AS nr_frag, round(log10(sum(n)), 6) AS log10_nr_frag, count(*) FILTER (WHERE n >= {acc}) AS nr_acc, round(CASE WHEN count(*) FILTER (WHERE n >= {acc}) = 0 THEN '-infinity'::DOUBLE ELSE log10(count(*) FILTER (WHERE n >= {acc})) END, 6) AS log10_nr_acc"


@query("fragments regions", "SELECT b.chrom || ':' || b.lo || '-' || b.hi AS region_id, a.cb AS cell_id, count(*)::INTEGER AS n FROM fragments a JOIN regions b ON a.chrom = b.chrom AND a.lo < b.hi AND b.lo < a.hi GROUP BY ALL")
def count_matrix_from_intervals(v: Views) -> DataFrame:
    return dataset.counts_of(v.fragments, v.regions)


@query("counts", "SELECT " + _OF.format(key="cell_id", acc=1) + " FROM counts GROUP BY cell_id")
def cell_stats(v: Views) -> DataFrame:
    return rounded(dataset.cell_stats(v.counts), "log10_nr_frag", "log10_nr_acc")


@query("counts", "SELECT " + _OF.format(key="region_id", acc=1) + " FROM counts GROUP BY region_id HAVING count(*) >= 20")
def region_stats_min_cell(v: Views) -> DataFrame:
    return rounded(dataset.region_stats(v.counts).filter("nr_acc >= 20"), "log10_nr_frag", "log10_nr_acc")


@query("counts", "SELECT DISTINCT region_id FROM counts WHERE n <> 0")
def nonzero_regions(v: Views) -> DataFrame:
    return dataset.binary(v.counts).select("region_id").distinct()


@query("counts", "SELECT cell_id, sum(n)::BIGINT AS nr_frag FROM counts GROUP BY 1 HAVING sum(n) >= 45")
def cells_min_fragments(v: Views) -> DataFrame:
    return dataset.cell_stats(v.counts).filter("nr_frag >= 45").select("cell_id", "nr_frag")


@query("fragments regions", """+m AS (SELECT cb, (count(*) >= 60)::INTEGER AS ok FROM fragments GROUP BY 1), f AS (SELECT chrom, lo, hi, cb FROM fragments WHERE cb IN (SELECT cb FROM m WHERE ok = 1) GROUP BY ALL)
    SELECT a.cb || '___p' AS cell_id, count(*) AS nr_acc FROM (SELECT DISTINCT f.cb, b.chrom, b.lo, b.hi FROM f JOIN regions b ON f.chrom = b.chrom AND f.lo < b.hi AND b.lo < f.hi) a GROUP BY 1""")
def cells_with_metrics(v: Views) -> DataFrame:
    """A dataset of the barcodes that a metrics table marks as cells."""
    metrics = v.fragments.groupBy("cb").agg((F.count("*") >= 60).cast("int").alias("is__cell_barcode"))
    d = dataset.Dataset.from_fragments(v.fragments, v.regions.select("chrom", "lo", "hi").distinct(), metrics, project="p")
    return d.cells.select("cell_id", "nr_acc")


@query("counts", "+o AS (SELECT DISTINCT region_id FROM counts WHERE n >= 2) SELECT " + _OF.format(key="cell_id", acc=2) + " FROM counts SEMI JOIN o USING (region_id) GROUP BY cell_id")
def cell_stats_two_fragments(v: Views) -> DataFrame:
    return rounded(dataset.cell_stats(v.counts, 2), "log10_nr_frag", "log10_nr_acc")


@query("fragments regions blacklist", """+f AS (SELECT chrom, lo, hi, cb FROM fragments GROUP BY ALL),
    c AS (SELECT b.chrom || ':' || b.lo || '-' || b.hi AS region_id, b.chrom, b.lo, b.hi, f.cb || '___p' AS cell_id, count(*) AS n FROM f JOIN (SELECT DISTINCT chrom, lo, hi FROM regions) b ON f.chrom = b.chrom AND f.lo < b.hi AND b.lo < f.hi GROUP BY ALL),
    k AS (SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE a.chrom = b.chrom AND a.lo < b.hi AND b.lo < a.hi)),
    g AS (SELECT cell_id FROM k GROUP BY 1 HAVING sum(n) >= 3)
    SELECT region_id, chrom, lo, hi, hi - lo AS width, sum(n)::BIGINT AS nr_frag, count(*) AS nr_acc FROM k SEMI JOIN g USING (cell_id) GROUP BY ALL""")
def dataset_from_fragments(v: Views) -> DataFrame:
    d = dataset.Dataset.from_fragments(v.fragments, v.regions.select("chrom", "lo", "hi").distinct(), blacklist=v.blacklist, project="p", min_frag=3)
    return d.regions.select("region_id", "chrom", "lo", "hi", "width", "nr_frag", "nr_acc")


@query("counts cells", "SELECT region_id, cell_id, n FROM counts WHERE cell_id IN (SELECT cell_id FROM cells WHERE grp = 'BUILDING') AND region_id IN (SELECT region_id FROM counts GROUP BY 1 HAVING count(*) >= 30)")
def dataset_subset(v: Views) -> DataFrame:
    d = dataset.Dataset(v.counts, v.cells, dataset.region_stats(v.counts))
    chosen = d.regions.filter("nr_acc >= 30")
    return d.subset(v.cells.filter("grp = 'BUILDING'"), chosen).counts


@query("counts", """+x AS (SELECT region_id, cell_id || '___' || CASE cell_id % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'p_1' ELSE 'p_2' END AS cell_id, n FROM counts)
    SELECT region_id, 'c' AS chrom, region_id AS lo, region_id + 1 AS hi, 1::INTEGER AS width, sum(n)::BIGINT AS nr_frag, count(*) AS nr_acc, count(DISTINCT split_part(cell_id, '___', 2)) AS samples FROM x GROUP BY region_id""")
def dataset_merge(v: Views) -> DataFrame:
    """Three datasets of one name; regions that only the second or third has keep their coordinates."""

    def part(k: int) -> dataset.Dataset:
        c = v.counts.filter(F.col("cell_id") % 3 == k).select(F.col("region_id"), F.concat(F.col("cell_id").cast("string"), F.lit("___p")).alias("cell_id"), "n")
        r = dataset.region_stats(c).withColumns({"chrom": F.lit("c"), "lo": F.col("region_id"), "hi": F.col("region_id") + 1, "width": F.lit(1)})
        return dataset.Dataset(c, dataset.cell_stats(c), r, "p")

    merged = part(0).merge(part(1), part(2))
    samples = merged.counts.groupBy("region_id").agg(F.count_distinct(F.split_part("cell_id", F.lit("___"), F.lit(2))).alias("samples"))
    return merged.regions.select("region_id", "chrom", "lo", "hi", "width", "nr_frag", "nr_acc").join(samples, "region_id")


@query("counts cells", "SELECT c.cell_id, c.grp, c.cell_name, s.nr_frag FROM cells c LEFT JOIN (SELECT cell_id, sum(n)::BIGINT AS nr_frag FROM counts GROUP BY 1) s USING (cell_id)")
def cell_metadata_join(v: Views) -> DataFrame:
    old = v.cells.withColumn("nr_frag", F.lit(-1))
    return dataset.with_metadata(old, dataset.cell_stats(v.counts).select("cell_id", "nr_frag"), "cell_id").select("cell_id", "grp", "cell_name", "nr_frag")


@query("counts", "SELECT region_id, cell_id % 25 AS cell_id, sum(n)::INTEGER AS n FROM counts GROUP BY ALL")
def count_matrix_from_wide(v: Views) -> DataFrame:
    """A wide matrix of 25 pools of cells, made long again."""
    pooled = v.counts.select("region_id", (F.col("cell_id") % 25).cast("string").alias("pool"), "n")
    wide = pooled.groupBy("region_id").pivot("pool", [str(i) for i in range(25)]).agg(F.sum("n"))
    return dataset.counts_of_matrix(wide, "region_id").withColumn("cell_id", F.col("cell_id").cast("long"))


_GRP = "(SELECT DISTINCT region_id FROM counts JOIN cells USING (cell_id) WHERE grp = '{0}' AND n > 1)"


@query("counts cells", f"""SELECT coalesce(a.region_id, b.region_id) AS region_id, CASE WHEN a.region_id IS NULL THEN 'second' WHEN b.region_id IS NULL THEN 'first' ELSE 'both' END AS side
    FROM {_GRP.format('BUILDING')} a FULL JOIN {_GRP.format('MACHINERY')} b ON a.region_id = b.region_id""")
def region_name_sets(v: Views) -> DataFrame:
    """Intersection and differences of the regions that two groups' cells have more than once."""
    part = lambda g: v.counts.filter("n > 1").join(v.cells.filter(F.col("grp") == g), "cell_id").select("region_id").distinct()
    a, b = part("BUILDING"), part("MACHINERY")
    both, first, second = a.intersect(b), a.exceptAll(b), b.exceptAll(a)
    return both.withColumn("side", F.lit("both")).union(first.withColumn("side", F.lit("first"))).union(second.withColumn("side", F.lit("second")))


@query("cells", "SELECT cell_id, grp, (dense_rank() OVER (ORDER BY grp) - 1)::INTEGER AS cluster FROM cells")
def dense_cluster_ids(v: Views) -> DataFrame:
    return tables.cluster_ids(v.cells, "grp").select("cell_id", "grp", "cluster")


_WIDE = """+w AS (SELECT grp, chrom, lo + summit - 250 AS lo, lo + summit + 251 AS hi, score, name, rid FROM peaks),
    k AS (SELECT w.* FROM w JOIN chromsizes s USING (chrom) WHERE w.lo >= s.lo AND w.hi <= s.hi
        AND NOT EXISTS (SELECT 1 FROM blacklist b WHERE w.chrom = b.chrom AND w.lo < b.hi AND b.lo < w.hi))"""


@query("peaks chromsizes blacklist", _WIDE + " SELECT grp, chrom, lo, hi, name FROM k")
def peak_extend(v: Views) -> DataFrame:
    return peaks.around_summits(v.peaks, 250, v.chromsizes, v.blacklist).select("grp", "chrom", "lo", "hi", "name")


@query("peaks chromsizes blacklist", _WIDE + " SELECT name, round(score * 1e6 / sum(score) OVER (PARTITION BY grp), 6) AS score FROM k")
def peak_cpm(v: Views) -> DataFrame:
    return rounded(peaks.per_million(peaks.around_summits(v.peaks, 250, v.chromsizes, v.blacklist)).select("name", "score"), "score")


@query("peaks chromsizes blacklist", _WIDE + """, m AS (SELECT *, max(hi) OVER (PARTITION BY grp, chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
    c AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY grp, chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS c FROM m)
    SELECT grp, chrom, min(lo) AS cluster, count(*) AS n, arg_max(name, (score, -lo, name)) AS best, max(score) AS score FROM c GROUP BY grp, chrom, c""")
def peak_clusters(v: Views) -> DataFrame:
    return peaks.best_in_cluster(peaks.around_summits(v.peaks, 250, v.chromsizes, v.blacklist), ("grp", "chrom"))


@query()
def consensus_peaks(v: Views) -> DataFrame:
    """Greedy selection in rounds; a test holds it against a plain loop."""
    out = peaks.consensus(v.peaks, 250, v.chromsizes, v.blacklist)
    return rounded(out, "score")


@query("peaks", "SELECT a.chrom, a.lo, a.hi, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS name, max(b.score) AS score FROM (SELECT DISTINCT chrom, lo, hi FROM peaks WHERE grp = 0) a JOIN peaks b ON a.chrom = b.chrom AND a.lo < b.hi AND b.lo < a.hi GROUP BY ALL")
def peak_back_annotation(v: Views) -> DataFrame:
    return peaks.back_annotated(v.peaks.filter("grp = 0").select("chrom", "lo", "hi").distinct(), v.peaks)


_N = "(SELECT count(*) FROM cells)"
_FEATURES = f"""+m AS (SELECT region_id, sum(n)::DOUBLE / {_N} AS mean, sum(n::DOUBLE * n) / {_N} - (sum(n)::DOUBLE / {_N}) * (sum(n)::DOUBLE / {_N}) AS variance FROM counts GROUP BY region_id),
    d AS (SELECT *, ln(variance / mean) AS dispersion FROM m), e AS (SELECT min(mean) AS lo, max(mean) AS hi FROM m),
    b AS (SELECT d.*, greatest(1, ceil((mean - lo) / ((hi - lo) / 20) - 1e-12)) AS bin FROM d, e),
    s AS (SELECT bin, avg(dispersion) AS c, stddev_samp(dispersion) AS sd FROM b GROUP BY bin),
    f AS (SELECT region_id, mean, dispersion, (dispersion - CASE WHEN sd IS NULL THEN 0 ELSE c END) / nullif(coalesce(sd, c), 0) AS normalised FROM b JOIN s USING (bin))"""


@query("counts cells", _FEATURES + " SELECT region_id, round(mean, 6) AS mean, round(variance, 6) AS variance FROM m")
def feature_moments(v: Views) -> DataFrame:
    return rounded(dataset.moments(v.counts, "region_id", v.cells.count()), "mean", "variance")


@query("counts cells", _FEATURES + " SELECT region_id, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, round(normalised, 5) AS normalised, coalesce(mean > 0.0125 AND mean < 3 AND normalised > 0.05, false) AS variable FROM f")
def highly_variable_features(v: Views) -> DataFrame:
    out = diff.variable_features(v.counts.withColumnRenamed("n", "value"), v.cells.count())
    return rounded(rounded(out, "mean", "dispersion"), "normalised", digits=5)


@query("counts cells", _FEATURES + " SELECT region_id FROM f WHERE normalised >= (SELECT min(normalised) FROM (SELECT normalised FROM f WHERE normalised IS NOT NULL ORDER BY normalised DESC, region_id LIMIT 200))")
def highly_variable_top(v: Views) -> DataFrame:
    return diff.variable_features(v.counts.withColumnRenamed("n", "value"), v.cells.count(), top=200).filter("variable").select("region_id")


_CONTRASTS = """+g AS (SELECT DISTINCT grp AS contrast FROM cells), k AS (SELECT contrast, cell_id, grp = contrast AS fg FROM cells, g),
    z AS (SELECT contrast, count(*) FILTER (WHERE fg) AS n1, count(*) FILTER (WHERE NOT fg) AS n2 FROM k GROUP BY 1),
    x AS (SELECT r.region_id, k.contrast, k.fg, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT region_id FROM counts) r CROSS JOIN k LEFT JOIN counts c ON c.region_id = r.region_id AND c.cell_id = k.cell_id)"""


@query("counts cells", """+g AS (SELECT DISTINCT grp AS contrast FROM cells), z AS (SELECT contrast, count(*) FILTER (WHERE grp = contrast) AS n1, count(*) FILTER (WHERE grp <> contrast) AS n2 FROM cells, g GROUP BY 1),
    s AS (SELECT contrast, region_id, sum(CASE WHEN grp = contrast THEN n ELSE 0 END) AS s1, sum(CASE WHEN grp <> contrast THEN n ELSE 0 END) AS s2 FROM counts JOIN cells USING (cell_id), g GROUP BY ALL)
    SELECT contrast, region_id, round(log2((s1 / n1 + 1e-12) / (s2 / n2 + 1e-12)), 6) AS log2fc FROM s JOIN z USING (contrast)""")
def marker_logfc(v: Views) -> DataFrame:
    out = diff.marker_statistics(v.counts.withColumnRenamed("n", "value"), diff.one_against_rest(v.cells, "grp"))
    return rounded(out.select("contrast", "region_id", "log2fc"), "log2fc")


_Z = _CONTRASTS + """,
    r AS (SELECT *, rank() OVER (PARTITION BY region_id, contrast ORDER BY n) + (count(*) OVER (PARTITION BY region_id, contrast, n) - 1) / 2 AS r FROM x),
    s AS (SELECT contrast, region_id, sum(CASE WHEN fg THEN r ELSE 0 END) AS rs FROM r GROUP BY ALL),
    zz AS (SELECT contrast, region_id, (rs - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM s JOIN z USING (contrast))"""


@query("counts cells", _Z + " SELECT contrast, region_id, round(z, 6) AS z FROM zz")
def marker_ranksum_z(v: Views) -> DataFrame:
    values = v.counts.withColumnRenamed("n", "value")
    return rounded(diff.marker_statistics(values, diff.one_against_rest(v.cells, "grp")).select("contrast", "region_id", "z"), "z")


@query("counts cells", """+p AS (SELECT region_id, cell_id % 5 AS k, exp(-sum(n) / 2.0) AS p FROM counts GROUP BY ALL),
    q AS (SELECT *, p * count(*) OVER (PARTITION BY k) / row_number() OVER (PARTITION BY k ORDER BY p) AS q FROM p)
    SELECT region_id, k, round(least(1, min(q) OVER (PARTITION BY k ORDER BY p DESC)), 8) AS adjusted FROM q""")
def marker_bh(v: Views) -> DataFrame:
    p = v.counts.groupBy("region_id", (F.col("cell_id") % 5).alias("k")).agg(F.exp(-F.sum("n") / 2).alias("p"))
    return rounded(stats.benjamini_hochberg(p, ["k"], "p").select("region_id", "k", "adjusted"), "adjusted", digits=8)


#: Cells with many counts against those with few, and regions in 200 pools: groups that differ, so that both bounds
#: keep some features and leave some out. The normal law's tail is by Simpson's rule on 200 steps from 0 to |z|, to some
#: 1e-9, as DuckDB has no error function.
_POOLED = """+pool AS (SELECT region_id % 200 AS region_id, cell_id, sum(n)::BIGINT AS n FROM counts GROUP BY ALL),
    k AS (SELECT g.contrast, t.cell_id, (nr >= 45) = (g.contrast = 'many') AS fg FROM (SELECT cell_id, sum(n) AS nr FROM counts GROUP BY 1) t, (VALUES ('many'), ('few')) g(contrast)),
    z AS (SELECT contrast, count(*) FILTER (WHERE fg) AS n1, count(*) FILTER (WHERE NOT fg) AS n2 FROM k GROUP BY 1),
    x AS (SELECT r.region_id, k.contrast, k.fg, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT region_id FROM pool) r CROSS JOIN k LEFT JOIN pool c ON c.region_id = r.region_id AND c.cell_id = k.cell_id)"""
_MARKERS = _POOLED + _Z.removeprefix(_CONTRASTS) + """,
    tl AS (SELECT contrast, region_id, greatest(0, 1 - 2 * abs(z) / 600 / sqrt(2 * pi()) * sum(CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (z * i / 200) ^ 2))) AS p
        FROM zz, range(201) t(i) GROUP BY contrast, region_id, z),
    q AS (SELECT *, p * count(*) OVER (PARTITION BY contrast) / row_number() OVER (PARTITION BY contrast ORDER BY p) AS q FROM tl),
    adj AS (SELECT *, least(1, min(q) OVER (PARTITION BY contrast ORDER BY p DESC)) AS adjusted_pval FROM q),
    fc AS (SELECT contrast, region_id, log2((sum(n) FILTER (WHERE fg) / any_value(n1) + 1e-12) / (sum(n) FILTER (WHERE NOT fg) / any_value(n2) + 1e-12)) AS log2fc FROM x JOIN z USING (contrast) GROUP BY ALL)"""


@query("counts", _MARKERS + " SELECT contrast, region_id, round(log2fc, 6) AS log2fc, round(adjusted_pval, 6) AS adjusted_pval FROM adj JOIN fc USING (contrast, region_id) WHERE adjusted_pval <= 0.05 AND log2fc >= 0.5849625007211562")
def markers(v: Views) -> DataFrame:
    pools = v.counts.groupBy((F.col("region_id") % 200).alias("region_id"), "cell_id").agg(F.sum("n").alias("value"))
    groups = dataset.cell_stats(v.counts).select("cell_id", F.when(F.col("nr_frag") >= 45, "many").otherwise("few").alias("grp"))
    return rounded(diff.markers(pools, diff.one_against_rest(groups, "grp")), "log2fc", "adjusted_pval")


@query("counts cells", """+k AS (SELECT 'two_against_one' AS contrast, cell_id, grp IN ('BUILDING', 'MACHINERY') AS fg FROM cells WHERE grp IN ('BUILDING', 'MACHINERY', 'FURNITURE')),
    z AS (SELECT contrast, count(*) FILTER (WHERE fg) AS n1, count(*) FILTER (WHERE NOT fg) AS n2 FROM k GROUP BY 1),
    x AS (SELECT r.region_id, k.contrast, k.fg, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT region_id FROM counts SEMI JOIN k USING (cell_id)) r CROSS JOIN k LEFT JOIN counts c ON c.region_id = r.region_id AND c.cell_id = k.cell_id)"""
    + _Z.removeprefix(_CONTRASTS) + " SELECT contrast, region_id, round(log2((s1 / n1 + 1e-12) / (s2 / n2 + 1e-12)), 6) AS log2fc, round(z, 6) AS z FROM zz JOIN (SELECT contrast, region_id, coalesce(sum(n) FILTER (WHERE fg), 0) AS s1, coalesce(sum(n) FILTER (WHERE NOT fg), 0) AS s2 FROM x GROUP BY ALL) USING (contrast, region_id) JOIN z USING (contrast)")
def marker_given_contrast(v: Views) -> DataFrame:
    """Two groups against a third one; cells of the others stay out."""
    contrast = diff.contrast_of(v.cells, "grp", "two_against_one", ["BUILDING", "MACHINERY"], ["FURNITURE"])
    return rounded(diff.marker_statistics(v.counts.withColumnRenamed("n", "value"), contrast), "log2fc", "z")


@query("counts regions", "SELECT r.region_id, r.nr_acc, g.chrom AS source FROM (SELECT region_id, count(*) AS nr_acc FROM counts GROUP BY 1) r LEFT JOIN (SELECT rid, chrom FROM regions WHERE rid % 3 > 0) g ON r.region_id = g.rid")
def region_metadata_join(v: Views) -> DataFrame:
    """Columns added to regions by key; a region without metadata stays."""
    more = v.regions.filter("rid % 3 > 0").select(F.col("rid").alias("region_id"), F.col("chrom").alias("source"))
    d = dataset.Dataset(v.counts, dataset.cell_stats(v.counts), dataset.region_stats(v.counts)).add_region_data(more)
    return d.regions.select("region_id", "nr_acc", "source")


_ONCE = """+o AS (SELECT * FROM genes QUALIFY row_number() OVER (PARTITION BY chrom, lo, hi, strand ORDER BY rid) = 1),
    o2 AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY gene ORDER BY chrom, lo, hi, rid) = 1),
    pr AS (SELECT chrom, CASE WHEN strand = '+' THEN lo ELSE hi END - 10 AS lo, CASE WHEN strand = '+' THEN lo ELSE hi END + 10 AS hi, strand FROM genes),
    bd AS (SELECT chrom, lo, hi, strand FROM pr UNION ALL SELECT chrom, lo, lo + 1, s FROM chromsizes, (VALUES ('+'), ('-')) t(s) UNION ALL SELECT chrom, hi - 1, hi, s FROM chromsizes, (VALUES ('+'), ('-')) t(s)),
    nb AS (SELECT g.*, (SELECT max(b.hi) FROM bd b WHERE b.chrom = g.chrom AND b.strand = g.strand AND b.hi <= g.lo) AS before,
        (SELECT min(b.lo) FROM bd b WHERE b.chrom = g.chrom AND b.strand = g.strand AND b.lo >= g.hi) AS after FROM o2 g),
    sp AS (SELECT *, least(greatest(CASE WHEN strand = '+' THEN lo - before ELSE after - hi END, 1000), 100000)::INTEGER AS up, least(greatest(CASE WHEN strand = '+' THEN after - hi ELSE lo - before END, 1000), 100000)::INTEGER AS down
        FROM nb WHERE before IS NOT NULL AND after IS NOT NULL)"""
_DIST = _ONCE + """, rs AS (SELECT *, CASE WHEN strand = '+' THEN lo - up ELSE lo - down END AS slo, CASE WHEN strand = '+' THEN hi + down ELSE hi + up END AS shi FROM sp),
    nr AS (SELECT r.rid AS region_id, s.gene, s.strand, s.hi - s.lo AS width, s.lo - round_even(r.lo + (r.hi - r.lo) / 2, 0)::INTEGER AS a, s.hi - round_even(r.lo + (r.hi - r.lo) / 2, 0)::INTEGER AS b
        FROM regions r JOIN rs s ON r.chrom = s.chrom AND r.lo < s.shi AND s.slo < r.hi),
    ds AS (SELECT region_id, gene, width, (CASE WHEN a > 0 AND b > 0 THEN 1 WHEN a < 0 AND b < 0 THEN -1 ELSE 0 END) * (CASE WHEN strand = '+' THEN 1 ELSE -1 END) * least(abs(a), abs(b)) AS distance FROM nr),
    md AS (SELECT median(hi - lo) AS f FROM o2),
    wt AS (SELECT region_id, gene, distance, (CASE WHEN distance = 0 THEN 1 + exp(-1) ELSE exp(-abs(distance) / 5000.0) + exp(-1) END) * f / width AS weight FROM ds, md)"""


@query("genes chromsizes", _ONCE + " SELECT gene, chrom, lo, hi, strand, up, down FROM sp")
def gene_search_space(v: Views) -> DataFrame:
    return genes.search_space(genes.first_of_each(v.genes), v.chromsizes).select("gene", "chrom", "lo", "hi", "strand", "up", "down")


@query("genes chromsizes regions", _DIST + " SELECT region_id, gene, distance FROM ds")
def gene_distance(v: Views) -> DataFrame:
    return genes.distances(v.regions, genes.search_space(genes.first_of_each(v.genes), v.chromsizes)).select("region_id", "gene", "distance")


@query("genes chromsizes regions", _DIST + " SELECT region_id, gene, round(weight, 6) AS weight FROM wt")
def gene_region_weights(v: Views) -> DataFrame:
    return rounded(genes.region_weights(v.regions, v.genes, v.chromsizes).select("region_id", "gene", "weight"), "weight")


@query("genes chromsizes regions counts", _DIST + """, gi AS (SELECT region_id, sum(n) AS t, sum(n * i) AS s, count(*) AS m FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY n) AS i FROM counts) GROUP BY 1)
    SELECT region_id, gene, round(weight * (exp(1 - (2 * s - (m + 1) * t) / (m * t)) + exp(-1)), 6) AS weight FROM wt JOIN gi USING (region_id)
    WHERE distance = 0 OR region_id NOT IN (SELECT r.rid FROM regions r JOIN pr ON r.chrom = pr.chrom AND r.lo < pr.hi AND pr.lo < r.hi)""")
def gene_region_weights_even(v: Views) -> DataFrame:
    """Weights that favour regions which few cells have, without promoters of other genes."""
    even = stats.gini(v.counts, "region_id", "n")
    out = genes.region_weights(v.regions, v.genes, v.chromsizes, ginis=even, remove_promoters=True)
    return rounded(out.select("region_id", "gene", "weight"), "weight")


@query("genes chromsizes regions counts", _DIST + """, lk AS (SELECT gene, count(*) AS links FROM wt GROUP BY 1)
    SELECT gene, cell_id, round(sum(n * weight) / any_value(links), 6) AS value FROM counts JOIN wt USING (region_id) JOIN lk USING (gene) GROUP BY gene, cell_id""")
def gene_activity(v: Views) -> DataFrame:
    weights = genes.region_weights(v.regions, v.genes, v.chromsizes)
    return rounded(genes.gene_activity(v.counts.withColumnRenamed("n", "value"), weights), "value")


@query("genes", "SELECT gene, CASE WHEN strand = '+' THEN lo - 500 ELSE lo - 100 END AS lo, CASE WHEN strand = '+' THEN hi + 100 ELSE hi + 500 END AS hi FROM genes")
def gene_extend(v: Views) -> DataFrame:
    return genes.stretched(v.genes, 500, 100).select("gene", "lo", "hi")


@query("fragments", "SELECT cb, count(*) AS unique_nr_frag FROM fragments GROUP BY cb")
def barcode_counter(v: Views) -> DataFrame:
    return v.fragments.groupBy("cb").agg(F.count("*").alias("unique_nr_frag"))
