"""Barcodes: counts, sizes, filters, start sites, thresholds."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calling, density, fragments, thresholds, tss
from ..operators.saving import shared_dir
from ..sources import bgzf
from . import qc
from .registry import Views, query, rounded

_STATS = """+s AS (SELECT cb, sum(score)::BIGINT AS total_fragments_count, count(*) AS unique_fragments_count,
        count(*) FILTER (WHERE hi - lo BETWEEN 147 AND 294) AS mono, count(*) FILTER (WHERE hi - lo < 147) AS free FROM fragments GROUP BY cb HAVING count(*) > 10),
    stats AS (SELECT cb, row_number() OVER (ORDER BY total_fragments_count DESC, cb) AS barcode_rank, total_fragments_count, unique_fragments_count,
        total_fragments_count - unique_fragments_count AS duplication_count, (total_fragments_count - unique_fragments_count)::DOUBLE / total_fragments_count AS duplication_ratio,
        mono::DOUBLE / free AS nucleosome_signal FROM s)"""
_FRIP = _STATS + """, h AS (SELECT cb, sum(score)::BIGINT AS total_fragments_in_peaks_count, count(*) AS unique_fragments_in_peaks_count FROM fragments a
        WHERE EXISTS (SELECT 1 FROM regions b WHERE a.chrom = b.chrom AND a.lo < b.hi AND b.lo < a.hi) GROUP BY cb),
    frip AS (SELECT stats.*, coalesce(total_fragments_in_peaks_count, 0) AS total_fragments_in_peaks_count, coalesce(unique_fragments_in_peaks_count, 0) AS unique_fragments_in_peaks_count,
        coalesce(unique_fragments_in_peaks_count, 0)::DOUBLE / unique_fragments_count AS fraction_of_fragments_in_peaks FROM stats LEFT JOIN h USING (cb))"""


@query("fragments", _STATS + " SELECT * REPLACE (round(duplication_ratio, 6) AS duplication_ratio, round(nucleosome_signal, 6) AS nucleosome_signal) FROM stats")
def barcode_stats(v: Views) -> DataFrame:
    return rounded(fragments.barcode_stats(v.fragments), "duplication_ratio", "nucleosome_signal")


@query("fragments regions", _FRIP + """ SELECT * REPLACE (round(duplication_ratio, 6) AS duplication_ratio, round(nucleosome_signal, 6) AS nucleosome_signal,
    round(fraction_of_fragments_in_peaks, 6) AS fraction_of_fragments_in_peaks) FROM frip""")
def barcode_frip(v: Views) -> DataFrame:
    return rounded(qc.barcode_frip(v.fragments, v.regions), "duplication_ratio", "nucleosome_signal", "fraction_of_fragments_in_peaks")


@query("fragments regions", _FRIP.replace("count(*) > 10", "count(*) > 0") + """ SELECT cb, barcode_rank, unique_fragments_count, total_fragments_in_peaks_count,
    round(fraction_of_fragments_in_peaks, 6) AS fraction_of_fragments_in_peaks FROM frip""")
def barcode_frip_any(v: Views) -> DataFrame:
    """The flagship: all barcodes, ranked, with their fraction of fragments in peaks."""
    out = qc.barcode_frip(v.fragments, v.regions, more_than=0)
    columns = ("cb", "barcode_rank", "unique_fragments_count", "total_fragments_in_peaks_count", "fraction_of_fragments_in_peaks")
    return rounded(out.select(*columns), "fraction_of_fragments_in_peaks")


@query("fragments regions", _FRIP + " SELECT cb, total_fragments_in_peaks_count, unique_fragments_in_peaks_count FROM h")
def fragments_in_peaks(v: Views) -> DataFrame:
    return fragments.in_regions(v.fragments, v.regions)


@query("fragments", "SELECT abs(hi - lo) AS insert_size, count(*) AS fragments_count, round(count(*) / sum(count(*)) OVER (), 9) AS fragments_ratio FROM fragments GROUP BY 1")
def insert_size_distribution(v: Views) -> DataFrame:
    return rounded(fragments.insert_sizes(v.fragments), "fragments_ratio", digits=9)


@query("fragments", "SELECT chrom, lo // 5000 AS lo, 5000 AS hi, cb, count(*)::INTEGER AS score FROM fragments GROUP BY ALL")
def fragment_dedup(v: Views) -> DataFrame:
    coarse = v.fragments.select("chrom", F.floor(F.col("lo") / 5000).cast("int").alias("lo"), F.lit(5000).alias("hi"), "cb")
    return fragments.collapsed(coarse)


@query("fragments", "SELECT chrom, lo, hi, cb, count(*)::INTEGER AS score FROM fragments GROUP BY ALL")
def fragment_scores_from_text(v: Views) -> DataFrame:
    return fragments.with_scores(v.fragments.withColumn("score", F.lit(".")))


@query("fragments", _STATS + " SELECT cb, unique_fragments_count FROM stats ORDER BY unique_fragments_count DESC, cb LIMIT 25")
def top_barcodes(v: Views) -> DataFrame:
    return fragments.passing_barcodes(fragments.barcode_stats(v.fragments), top=25).select("cb", "unique_fragments_count")


@query("fragments", _STATS + " SELECT cb, unique_fragments_count FROM stats WHERE unique_fragments_count >= 70")
def barcodes_min_count(v: Views) -> DataFrame:
    return fragments.passing_barcodes(fragments.barcode_stats(v.fragments), at_least=70).select("cb", "unique_fragments_count")


@query("fragments", "SELECT chrom, lo, hi, cb, score, rid FROM fragments WHERE cb IN (SELECT cb FROM fragments GROUP BY cb HAVING count(*) >= 70)")
def fragments_for_barcodes(v: Views) -> DataFrame:
    chosen = fragments.passing_barcodes(fragments.barcode_stats(v.fragments), at_least=70)
    return fragments.of_barcodes(v.fragments, chosen.select("cb").union(chosen.select("cb")))


@query("fragments", "SELECT chrom, lo, hi, cb, score, rid, 's' || (substr(cb, 6)::BIGINT % 3) AS label FROM fragments")
def pseudobulk_fragments(v: Views) -> DataFrame:
    number = F.expr("cast(substr(cb, 6) as bigint) % 3")
    cells = v.fragments.select("cb").distinct().select("cb", F.concat(F.lit("s"), number.cast("string")).alias("label"))
    return fragments.pseudobulk(v.fragments, cells, "label").select("chrom", "lo", "hi", "cb", "score", "rid", "label")


@query("fragments", """+e AS (SELECT chrom, lo AS x, 1 AS d FROM fragments UNION ALL SELECT chrom, hi, -1 FROM fragments),
    s AS (SELECT chrom, x, sum(d) AS d FROM e GROUP BY ALL),
    c AS (SELECT chrom, x AS lo, lead(x) OVER w AS hi, (sum(d) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS depth FROM s WINDOW w AS (PARTITION BY chrom ORDER BY x))
    SELECT chrom, lo, hi, depth FROM c WHERE depth > 0""")
def fragment_coverage(v: Views) -> DataFrame:
    return fragments.coverage(v.fragments)


_CUTS = """+n AS (SELECT a.cb, a.lo, a.hi, b.pos, CASE b.strand WHEN '+' THEN 1 ELSE -1 END AS g FROM fragments a JOIN tss b
        ON a.chrom = b.chrom AND a.lo < b.pos + 2001 AND b.pos - 2000 < a.hi WHERE b.strand IN ('+', '-')),
    cuts AS (SELECT cb, position, count(*) AS n FROM (SELECT cb, (lo - pos) * g AS position FROM n UNION ALL SELECT cb, (hi - {last} - pos) * g FROM n)
        WHERE position BETWEEN -2000 AND 2000 GROUP BY ALL)"""
_PROFILE = """, grid AS (SELECT k, p::INTEGER AS position FROM (SELECT DISTINCT k FROM keyed), range(-2000, 2001) r(p)),
    d AS (SELECT k, position, coalesce(n, 0) AS n FROM grid LEFT JOIN keyed USING (k, position)),
    m AS (SELECT *, avg(n) OVER (PARTITION BY k ORDER BY position ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS smoothed FROM d),
    e AS (SELECT k, (avg(smoothed) FILTER (WHERE position < -1900) + avg(smoothed) FILTER (WHERE position > 1900)) / 2 AS level FROM m GROUP BY k),
    prof AS (SELECT m.*, smoothed / greatest(level, 0.2) AS normalised FROM m JOIN e USING (k))"""


@query("fragments tss", _CUTS.format(last=1) + " SELECT cb, position, n FROM cuts")
def tss_cut_sites(v: Views) -> DataFrame:
    return tss.cut_sites(v.fragments, v.tss)


@query("fragments tss", _CUTS.format(last=0) + " SELECT cb, position, n FROM cuts")
def tss_cut_matrix(v: Views) -> DataFrame:
    return tss.cut_matrix(v.fragments, v.tss)


@query("fragments tss", _CUTS.format(last=1) + ", keyed AS (SELECT 1 AS k, position, sum(n)::BIGINT AS n FROM cuts GROUP BY position)" + _PROFILE + " SELECT position, n, round(smoothed, 6) AS smoothed, round(normalised, 6) AS normalised FROM prof")
def tss_profile_sample(v: Views) -> DataFrame:
    return rounded(tss.sample_profile(tss.sample_cuts(v.fragments, v.tss)), "smoothed", "normalised")


@query("fragments tss", _CUTS.format(last=1) + ", keyed AS (SELECT cb AS k, position, n FROM cuts)" + _PROFILE + " SELECT k AS cb, round(avg(normalised), 6) AS tss_enrichment FROM prof WHERE position BETWEEN -50 AND 50 GROUP BY k")
def tss_enrichment_per_cell(v: Views) -> DataFrame:
    return rounded(tss.enrichment_of(v.fragments, v.tss), "tss_enrichment")


def _histogram(source: str, value: str, bins: int) -> str:
    """CTE h: bin, n, centre of an expression over a table with rows."""
    return f"""v AS (SELECT ({value})::DOUBLE AS x FROM {source}), r AS (SELECT min(x) - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS low, max(x) + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS high FROM v),
        c AS (SELECT least(floor((x - low) * {bins} / (high - low)), {bins - 1})::INTEGER AS bin, count(*) AS n FROM v, r GROUP BY 1),
        h AS (SELECT b::INTEGER AS bin, coalesce(n, 0) AS n, low + (b + 0.5) * ((high - low) / {bins}) AS centre FROM r, range({bins}) t(b) LEFT JOIN c ON c.bin = b WHERE low IS NOT NULL)"""


_OTSU = """w AS (SELECT bin, centre, sum(n) OVER b AS w1, sum(n) OVER a AS w2, sum(n * centre) OVER b AS s1, sum(n * centre) OVER a AS s2 FROM h
        WINDOW b AS (ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""
_OTSU_PICK = "SELECT round(centre, 6) AS threshold FROM w WHERE w1 > 0 AND w2 > 0 ORDER BY round(w1 * w2 * (s1 / w1 - s2 / w2) ^ 2, 3) DESC, bin LIMIT 1"


@query("fragments", _STATS + ", " + _histogram("stats", "unique_fragments_count", 50) + " SELECT bin, n, round(centre, 6) AS centre FROM h")
def histogram_of_counts(v: Views) -> DataFrame:
    h = thresholds.histogram(fragments.barcode_stats(v.fragments), "unique_fragments_count", (), 50)
    return rounded(h.select("bin", "n", "centre"), "centre")


@query("fragments", _STATS + ", " + _histogram("stats", "log10(unique_fragments_count)", 50) + ", " + _OTSU + " " + _OTSU_PICK)
def otsu_threshold(v: Views) -> DataFrame:
    stats = fragments.barcode_stats(v.fragments).select(F.log10("unique_fragments_count").alias("x"))
    return rounded(thresholds.otsu(stats, "x", (), 50), "threshold")


@query("fragments regions", _FRIP + " SELECT cb FROM frip WHERE unique_fragments_count > 60 AND fraction_of_fragments_in_peaks > 0.1")
def barcodes_passing_thresholds(v: Views) -> DataFrame:
    stats = qc.barcode_frip(v.fragments, v.regions).withColumn("tss_enrichment", F.lit(1.0))
    return qc.passing(stats, None, 60, 0, 0.1)


_MEASURES = ("tss_enrichment", "fraction_of_fragments_in_peaks", "duplication_ratio")
_QC = _FRIP + ", " + _CUTS.format(last=1).removeprefix("+") + ", keyed AS (SELECT cb AS k, position, n FROM cuts)" + _PROFILE + """,
    te AS (SELECT k AS cb, avg(normalised) AS tss_enrichment FROM prof WHERE position BETWEEN -50 AND 50 GROUP BY k),
    qc AS (SELECT frip.*, """ + ", ".join(f"log10({c} + 1) AS log10_{c}" for c in qc.COUNTS) + """, coalesce(tss_enrichment, 0::DOUBLE) AS tss_enrichment FROM frip LEFT JOIN te USING (cb))"""
_DENSITIES = ", pts AS (" + " UNION ALL ".join(f"SELECT '{m}' AS m, cb, log10_unique_fragments_count AS x, {m} AS y FROM qc" for m in _MEASURES) + """),
    kv AS (SELECT m, count(*) AS n, var_samp(x) * count(*) ^ (-1.0 / 3) AS a, covar_samp(x, y) * count(*) ^ (-1.0 / 3) AS b, var_samp(y) * count(*) ^ (-1.0 / 3) AS c FROM pts GROUP BY m HAVING count(*) > 1),
    kd AS (SELECT *, a * c - b * b AS det FROM kv WHERE a * c - b * b > 0),
    dens AS (SELECT m, p.cb, sum(exp(-0.5 * (c * (p.x - q.x) ^ 2 - 2 * b * (p.x - q.x) * (p.y - q.y) + a * (p.y - q.y) ^ 2) / det)) / (2 * pi() * sqrt(any_value(det)) * any_value(n)) AS density
        FROM pts p JOIN pts q USING (m) JOIN kd USING (m) GROUP BY m, p.cb),
    wide AS (SELECT cb, """ + ", ".join(f"max(density) FILTER (WHERE m = '{m}') AS density_{m}" for m in _MEASURES) + " FROM dens GROUP BY cb)"
_REAL = ("duplication_ratio", "nucleosome_signal", "fraction_of_fragments_in_peaks", "tss_enrichment", *(f"log10_{c}" for c in qc.COUNTS))


@query("fragments regions tss", _QC + _DENSITIES + " SELECT qc.* REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _REAL) + "), " + ", ".join(f"round(density_{m}, 5) AS density_{m}" for m in _MEASURES) + " FROM qc LEFT JOIN wide USING (cb)")
def barcode_qc(v: Views) -> DataFrame:
    """All measures of every barcode, with the densities of three of them."""
    out = rounded(qc.barcode_qc(v.fragments, v.regions, v.tss), *_REAL)
    return rounded(out, *(f"density_{m}" for m in _MEASURES), digits=5)


def _otsu_of(value: str, where: str, p: str, bins: int = 5000) -> str:
    """CTEs named by the prefix p, up to {p}w: Otsu's sums of an expression over qc."""
    text = _histogram(f"qc WHERE {where}", value, bins) + ", " + _OTSU
    for name in ("v", "r", "c", "h", "w"):
        text = re.sub(rf"(?<![\w.(]){name} AS \(SELECT", f"{p}{name} AS (SELECT", text)
        text = re.sub(rf"\b(FROM|JOIN|,) {name}\b(?! AS)", rf"\1 {p}{name}", text)
    return text.replace("ON c.bin", f"ON {p}c.bin")


_CUT = "(SELECT centre FROM {0}w WHERE w1 > 0 AND w2 > 0 ORDER BY round(w1 * w2 * (s1 / w1 - s2 / w2) ^ 2, 3) DESC, bin LIMIT 1)"


@query("fragments regions tss", _QC + ", " + _otsu_of("log10(unique_fragments_count)", "unique_fragments_count >= 10", "f") + ", " + _otsu_of("tss_enrichment", "tss_enrichment >= 0", "t")
    + f" SELECT round(10 ^ {_CUT.format('f')}, 6) AS unique_fragments, round({_CUT.format('t')}, 6) AS tss_enrichment")
def otsu_qc_thresholds(v: Views) -> DataFrame:
    return rounded(qc.otsu_thresholds(qc.barcode_qc(v.fragments, v.regions, v.tss, densities=False), 10, 0.0), "unique_fragments", "tss_enrichment")


@query("fragments regions", _FRIP + """, u AS (SELECT cb, log10(unique_fragments_count) AS x, fraction_of_fragments_in_peaks AS y FROM frip),
    k AS (SELECT count(*) AS n, var_samp(x) * count(*) ^ (-1.0 / 3) AS a, covar_samp(x, y) * count(*) ^ (-1.0 / 3) AS b, var_samp(y) * count(*) ^ (-1.0 / 3) AS c FROM u)
    SELECT p.cb, round(sum(exp(-0.5 * (c * (p.x - q.x) ^ 2 - 2 * b * (p.x - q.x) * (p.y - q.y) + a * (p.y - q.y) ^ 2) / (a * c - b * b))) / (2 * pi() * sqrt(any_value(a * c - b * b)) * any_value(n)), 6) AS density
    FROM u p, u q, k GROUP BY p.cb""")
def barcode_density(v: Views) -> DataFrame:
    points = qc.barcode_frip(v.fragments, v.regions).select("cb", F.log10("unique_fragments_count").alias("x"), F.col("fraction_of_fragments_in_peaks").alias("y"))
    return rounded(density.density(points, "x", "y").select("cb", "density"), "density")


@query("fragments", "SELECT chrom, lo, hi, cb, score FROM fragments WHERE chrom = 'view' AND lo < 1500000 AND hi > 500000")
def fragments_of_a_range(v: Views) -> DataFrame:
    """A chromosome's stretch of block-gzipped, indexed files that are written from the fragments first."""
    at = f"{shared_dir(v.spark)}/fragments-{uuid.uuid4().hex}"
    bgzf.write_bgzf(v.fragments.select("chrom", "lo", "hi", "cb", "score"), at)
    kept = bgzf.read_bgzf(v.spark, at, v.fragments.select("chrom", "lo", "hi", "cb", "score").schema)
    return kept.filter("chrom = 'view' and lo < 1500000 and hi > 500000")


@query("peaks", """+e AS (SELECT grp, chrom, x, sum(d) AS d FROM (SELECT grp, chrom, greatest(lo - 73, 0) AS x, 1 AS d FROM peaks WHERE lo + 73 > 0 UNION ALL SELECT grp, chrom, lo + 73, -1 FROM peaks WHERE lo + 73 > 0
        UNION ALL SELECT grp, chrom, greatest(hi - 73, 0), 1 FROM peaks WHERE hi + 73 > 0 UNION ALL SELECT grp, chrom, hi + 73, -1 FROM peaks WHERE hi + 73 > 0) GROUP BY ALL HAVING sum(d) <> 0),
    p AS (SELECT grp, chrom, x AS lo, lead(x) OVER w AS hi, sum(d) OVER w AS height FROM e WINDOW w AS (PARTITION BY grp, chrom ORDER BY x)),
    s AS (SELECT * FROM p WHERE height > 0), b AS (SELECT grp, height, sum(hi - lo) AS bases FROM s GROUP BY ALL), g AS (SELECT 12960000 AS genome),
    m AS (SELECT grp, height, bases, sum(bases * height) OVER (PARTITION BY grp) / genome AS mean, sum(bases) OVER (PARTITION BY grp ORDER BY height DESC) AS r, genome FROM b, g),
    t AS (SELECT grp, height, mean, r, genome, -log10(sum(exp(i * ln(mean) - mean - lgamma(i + 1)))) AS lp FROM (SELECT *, unnest(range(height::BIGINT, height::BIGINT + 100)) AS i FROM m) GROUP BY ALL),
    h AS (SELECT grp, height, mean, lp, greatest(0, max(lp - log10(genome) + log10(r)) OVER (PARTITION BY grp ORDER BY height)) AS lq FROM t),
    k AS (SELECT s.*, mean, lp, lq, max(hi) OVER (PARTITION BY grp, chrom ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s JOIN h USING (grp, height) WHERE lq >= -log10(0.05)),
    c AS (SELECT *, sum(CASE WHEN prev IS NULL OR lo > prev + 30 THEN 1 ELSE 0 END) OVER (PARTITION BY grp, chrom ORDER BY lo) AS run FROM k),
    q AS (SELECT grp, chrom, min(lo) AS lo, max(hi) AS hi, arg_max((lo, hi, height, mean, lp, lq), (height, -lo)) AS t FROM c GROUP BY grp, chrom, run HAVING max(hi) - min(lo) >= 146)
    SELECT grp, chrom, lo::BIGINT AS lo, hi::BIGINT AS hi, grp || '_peak_' || row_number() OVER (PARTITION BY grp ORDER BY chrom, lo) AS name, floor(10 * round(t[6], 6))::BIGINT AS score, '.' AS strand,
        round((t[3] + 1) / (t[4] + 1), 6) AS fold_change, round(t[5], 6) AS minus_log10_p, round(t[6], 6) AS minus_log10_q, ((t[1] + t[2]) // 2 - lo)::BIGINT AS summit FROM q""")
def called_peaks(v: Views) -> DataFrame:
    """Peaks of the cuts of each group's fragments, in a genome of five chromosomes."""
    found = calling.call_peaks(calling.cuts(v.peaks.select("grp", "chrom", "lo", "hi")), 5 * 2_592_000)
    return rounded(found, "fold_change", "minus_log10_p", "minus_log10_q").withColumn("score", F.floor(10 * F.col("minus_log10_q")).cast("long"))
