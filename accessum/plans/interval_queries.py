"""Interval algebra, region ids and annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import regions as fr
from ..operators import enrichment, intervals, signatures
from ..sources import annotation
from .registry import Views, query, rounded

_MEET = "a.chrom = b.chrom AND a.lo < b.hi AND b.lo < a.hi"
_PAIR = "a.chrom, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi, a.rid AS rid_1, b.rid AS rid_2"


def _slim(df: DataFrame) -> DataFrame:
    return df.select("chrom", "lo", "hi", "rid")


def _cut(df: DataFrame) -> DataFrame:
    return df.select("chrom", "lo", "hi", "rid_1", "rid_2")


@query("fragments regions", f"SELECT {_PAIR} FROM fragments a JOIN regions b ON {_MEET}")
def interval_intersect_all(v: Views) -> DataFrame:
    return _cut(intervals.intersection(_slim(v.fragments), _slim(v.regions)))


@query("fragments regions", f"SELECT {_PAIR} FROM fragments a JOIN regions b ON a.chrom = b.chrom AND a.lo >= b.lo AND a.hi <= b.hi")
def interval_containment(v: Views) -> DataFrame:
    return _cut(intervals.intersection(_slim(v.fragments), _slim(v.regions), "containment"))


@query("fragments regions", f"SELECT {_PAIR} FROM fragments a JOIN regions b ON {_MEET} QUALIFY row_number() OVER (PARTITION BY a.rid ORDER BY b.lo, b.hi DESC, b.rid) = 1")
def interval_first(v: Views) -> DataFrame:
    return _cut(intervals.intersection(_slim(v.fragments), _slim(v.regions), "first"))


@query("fragments regions", f"SELECT {_PAIR} FROM fragments a JOIN regions b ON {_MEET} QUALIFY row_number() OVER (PARTITION BY a.rid ORDER BY b.lo DESC, b.hi, b.rid DESC) = 1")
def interval_last(v: Views) -> DataFrame:
    return _cut(intervals.intersection(_slim(v.fragments), _slim(v.regions), "last"))


_OUTER = "coalesce(a.chrom, b.chrom) AS chrom, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi, a.rid AS rid_1, b.rid AS rid_2"


@query("regions blacklist", f"SELECT {_OUTER} FROM regions a LEFT JOIN blacklist b ON {_MEET}")
def interval_left(v: Views) -> DataFrame:
    return _cut(intervals.intersection(_slim(v.regions), _slim(v.blacklist), "left"))


@query("regions blacklist", f"SELECT {_OUTER} FROM regions a RIGHT JOIN blacklist b ON {_MEET}")
def interval_right(v: Views) -> DataFrame:
    return _cut(intervals.intersection(_slim(v.regions), _slim(v.blacklist), "right"))


@query("regions blacklist", f"SELECT {_OUTER} FROM regions a FULL JOIN blacklist b ON {_MEET}")
def interval_outer(v: Views) -> DataFrame:
    return _cut(intervals.intersection(_slim(v.regions), _slim(v.blacklist), "outer"))


@query("fragments regions", f"SELECT a.chrom, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi, a.lo AS lo_1, a.hi AS hi_1, b.lo AS lo_2, b.hi AS hi_2, a.rid, b.rid AS rid_2 FROM fragments a JOIN regions b ON {_MEET}")
def interval_shaped(v: Views) -> DataFrame:
    found = intervals.intersection(_slim(v.fragments), _slim(v.regions))
    return intervals.shaped(found, True, True, True, True)


_ANY = f"EXISTS (SELECT 1 FROM blacklist b WHERE {_MEET})"


@query("fragments blacklist", f"SELECT chrom, lo, hi, rid FROM fragments a WHERE {_ANY}")
def interval_overlap_semi(v: Views) -> DataFrame:
    return intervals.overlap(_slim(v.fragments), v.blacklist)


@query("fragments regions", f"SELECT a.chrom, a.lo, a.hi, a.rid FROM fragments a JOIN regions b ON {_MEET}")
def interval_overlap_all(v: Views) -> DataFrame:
    return intervals.overlap(_slim(v.fragments), _slim(v.regions), "all")


@query("fragments blacklist", "SELECT a.chrom, a.lo, a.hi, a.rid FROM fragments a JOIN blacklist b ON a.chrom = b.chrom AND a.lo >= b.lo AND a.hi <= b.hi")
def interval_overlap_containment(v: Views) -> DataFrame:
    return intervals.overlap(_slim(v.fragments), _slim(v.blacklist), "all", kind="containment")


@query("fragments blacklist", f"SELECT chrom, lo, hi, rid FROM fragments a WHERE NOT {_ANY}")
def interval_overlap_anti(v: Views) -> DataFrame:
    return intervals.overlap(_slim(v.fragments), v.blacklist, "anti")


@query("regions chromsizes", "SELECT a.chrom, a.lo, a.hi, a.rid FROM regions a JOIN chromsizes b ON a.chrom = b.chrom AND a.lo >= b.lo AND a.hi <= b.hi")
def interval_within_bounds(v: Views) -> DataFrame:
    return intervals.within_bounds(_slim(v.regions), v.chromsizes)


_CLUSTER = """+m AS (SELECT *, max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fragments),
    k AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT chrom, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM k GROUP BY chrom, k"""


@query("fragments", _CLUSTER)
def interval_merge(v: Views) -> DataFrame:
    return intervals.merged(_slim(v.fragments))


@query("genes regions", """SELECT a.rid, (SELECT max(b.hi)::BIGINT FROM regions b WHERE b.chrom = a.chrom AND b.hi <= a.lo) AS before,
    (SELECT min(b.lo)::BIGINT FROM regions b WHERE b.chrom = a.chrom AND b.lo >= a.hi) AS after FROM genes a""")
def nearest_boundary(v: Views) -> DataFrame:
    return intervals.nearest_ends(_slim(v.genes), v.regions)


@query("tss", "SELECT count(*) FILTER (WHERE strand NOT IN ('+', '-')) = 0 AS stranded FROM tss")
def strandedness(v: Views) -> DataFrame:
    return intervals.is_stranded(v.tss)


@query("regions", "SELECT rid, chrom || ':' || lo || '-' || hi AS region FROM regions")
def region_ids(v: Views) -> DataFrame:
    return v.regions.select("rid", fr.region_id().alias("region"))


@query("regions", "SELECT rid, chrom, lo, hi FROM regions")
def parse_region_ids(v: Views) -> DataFrame:
    return fr.with_coordinates(v.regions.select("rid", fr.region_id().alias("region"))).select("rid", "chrom", "lo", "hi")


@query("cells", "SELECT cell_id, split_part(cell_name, '___', 1) AS barcode FROM cells")
def strip_cell_tag(v: Views) -> DataFrame:
    return v.cells.select("cell_id", fr.untagged().alias("barcode"))


_ALIAS = "(VALUES ('view', 'v1', 'NC_000001.1', 'CM000001.1'), ('click', 'v2', 'NC_000002.1', 'CM000002.1'), ('signup', 'v3', 'NC_000003.1', 'CM000003.1'), ('chrX', 'error', NULL, 'purchase')) t(ucsc, ensembl, refseq, genbank)"


@query("fragments", f"SELECT coalesce(t.ensembl, f.chrom) AS chrom, count(*) AS n FROM fragments f LEFT JOIN {_ALIAS} ON f.chrom = t.ucsc GROUP BY 1")
def chrom_alias_map(v: Views) -> DataFrame:
    table = v.spark.sql(f"SELECT * FROM {_ALIAS}")
    return annotation.renamed_chromosomes(v.fragments, table, "ucsc", "ensembl").groupBy("chrom").agg(F.count("*").alias("n"))


@query("fragments", f"""+c AS (SELECT DISTINCT chrom FROM fragments), t AS (SELECT * FROM {_ALIAS}),
    l AS (SELECT 'ucsc' AS source, ucsc AS x, 1 AS o FROM t UNION SELECT 'ensembl', ensembl, 2 FROM t UNION SELECT 'refseq', refseq, 3 FROM t UNION SELECT 'genbank', genbank, 4 FROM t),
    n AS (SELECT source, o, count(chrom) AS n FROM l LEFT JOIN c ON l.x = c.chrom GROUP BY ALL)
    SELECT source, n, row_number() OVER (ORDER BY n DESC, o) = 1 AS best FROM n""")
def chrom_source_guess(v: Views) -> DataFrame:
    return annotation.likely_source(v.fragments, v.spark.sql(f"SELECT * FROM {_ALIAS}"))


@query(sql="""WITH k AS (SELECT s_suppkey AS i, s_suppkey::VARCHAR AS k, lpad(s_suppkey::VARCHAR, 6, '0') AS z FROM supplier),
    t AS (SELECT CASE i % 3 WHEN 0 THEN ['chr' || k, k, 'CM' || z || '.1', 'NC_' || z || '.2'] WHEN 1 THEN ['NC_' || z || '.1', k, 'chr' || k] ELSE ['GL' || z || '.1', 'chrUn_' || k, 'un' || k] END AS names FROM k),
    s AS (SELECT CASE WHEN p_partkey % 3 = 2 THEN 'chrUn_' ELSE 'chr' END || p_partkey AS ucsc, p_size::BIGINT AS length FROM part WHERE p_partkey % 5 <> 0)
    SELECT ucsc, length, ensembl, refseq, genbank FROM (SELECT list_filter(names, lambda x: x LIKE 'chr%')[1] AS ucsc,
        list_filter(names, lambda x: NOT x LIKE 'chr%' AND NOT x LIKE 'NC%' AND NOT x LIKE '%.%')[1] AS ensembl,
        list_filter(names, lambda x: x LIKE 'NC%')[1] AS refseq, list_filter(names, lambda x: x LIKE '%.%' AND NOT x LIKE 'NC%')[1] AS genbank FROM t) JOIN s USING (ucsc)""")
def chrom_alias_kinds(v: Views) -> DataFrame:
    """Lists of names, one a supplier, in which kinds are in different places or missing."""
    k, z = F.col("s_suppkey").cast("string"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    full = F.array(of("chr", k), k, of("CM", z, ".1"), of("NC_", z, ".2"))
    short, loose = F.array(of("NC_", z, ".1"), k, of("chr", k)), F.array(of("GL", z, ".1"), of("chrUn_", k), of("un", k))
    kind = F.col("s_suppkey") % 3
    names = v.spark.read.parquet(f"{v.sf_dir}/supplier.parquet").select(F.when(kind == 0, full).when(kind == 1, short).otherwise(loose).alias("names"))
    parts = v.spark.read.parquet(f"{v.sf_dir}/part.parquet").filter("p_partkey % 5 <> 0")
    sizes = parts.select(F.concat(F.when(F.col("p_partkey") % 3 == 2, "chrUn_").otherwise("chr"), F.col("p_partkey").cast("string")).alias("ucsc"), F.col("p_size").cast("long").alias("length"))
    return annotation.aliases_of_list(names, sizes)


@query(sql="""SELECT 'chr' || (s_nationkey % 5) AS chrom, (s_suppkey * 31)::INTEGER - 1 AS lo, (s_suppkey * 31)::INTEGER AS hi, s_name AS gene, '.' AS score,
    CASE s_suppkey % 3 WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE '.' END AS strand, CASE WHEN s_suppkey % 4 = 0 THEN 'lncRNA' ELSE 'protein_coding' END AS transcript_type
    FROM supplier WHERE s_suppkey % 4 <> 0""")
def tss_annotation(v: Views) -> DataFrame:
    s = v.spark.read.parquet(f"{v.sf_dir}/supplier.parquet")
    number = F.when(F.col("s_suppkey") % 3 == 1, 1).when(F.col("s_suppkey") % 3 == 2, -1).otherwise(0)
    kind = F.when(F.col("s_suppkey") % 4 == 0, "lncRNA").otherwise("protein_coding")
    table = s.select(F.concat(F.lit("chr"), (F.col("s_nationkey") % 5).cast("string")).alias("chrom"), (F.col("s_suppkey") * 31).alias("tss"), number.alias("strand"), F.col("s_name").alias("gene"), kind.alias("transcript_type"))
    return annotation.tss_of_transcripts(table)


@query(sql="SELECT n_name AS display_name, lower(n_name) AS name FROM nation WHERE lower(n_name) LIKE '%tion_1%'")
def dataset_name_search(v: Views) -> DataFrame:
    n = v.spark.read.parquet(f"{v.sf_dir}/nation.parquet").select(F.col("n_name").alias("display_name"), F.lower("n_name").alias("name"))
    return annotation.datasets_of_species(n, "Tion_1")


@query("regions blacklist", f"SELECT DISTINCT b.rid AS signature, a.rid AS region_id FROM regions a JOIN blacklist b ON {_MEET}")
def signature_regions(v: Views) -> DataFrame:
    return signatures.signature_regions(_slim(v.regions), v.blacklist.withColumnRenamed("rid", "signature"))


@query("regions", "SELECT DISTINCT chrom || ':' || lo || '-' || hi AS region FROM regions WHERE chrom = 'view'")
def signature_of_term(v: Views) -> DataFrame:
    listed = v.regions.groupBy(F.col("chrom").alias("term"), (F.col("rid") % 50).alias("row")).agg(F.array_join(F.collect_list(fr.region_id()), ", ").alias("regions"))
    return signatures.term_regions(listed, "view")


@query("regions tss gene_terms chromsizes", """+s AS (SELECT gene, t.chrom, pos, z.lo AS first, z.hi AS last, greatest(z.lo, pos - CASE WHEN strand = '-' THEN 1000 ELSE 5000 END) AS b,
        least(z.hi, pos + CASE WHEN strand = '-' THEN 5000 ELSE 1000 END) AS e FROM tss t JOIN chromsizes z ON t.chrom = z.chrom WHERE pos >= z.lo AND pos < z.hi),
    d AS (SELECT gene, chrom, least(b, greatest(pos - 1000000, first, coalesce(max(e) OVER p, first))) AS lo, greatest(e, least(pos + 1000000, last, coalesce(min(b) OVER n, last))) AS hi FROM s
        WINDOW p AS (PARTITION BY chrom ORDER BY pos, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY chrom ORDER BY pos, gene ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    o AS (SELECT DISTINCT gene, term FROM gene_terms SEMI JOIN d USING (gene)),
    c AS (SELECT term, sum(greatest(0, hi - greatest(lo, coalesce(prev, lo)))) AS covered FROM (SELECT term, lo, hi, max(hi) OVER (PARTITION BY term, chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
        FROM d JOIN o USING (gene)) GROUP BY term),
    h AS (SELECT DISTINCT r.rid, gene FROM regions r JOIN d ON r.chrom = d.chrom AND (r.lo + r.hi) // 2 >= d.lo AND (r.lo + r.hi) // 2 < d.hi),
    k AS (SELECT term, count(DISTINCT rid) AS regions, count(DISTINCT gene) AS genes_hit FROM h JOIN o USING (gene) GROUP BY term),
    a AS (SELECT (SELECT count(*) FROM regions) AS n, (SELECT count(DISTINCT gene) FROM h) AS drawn, (SELECT count(DISTINCT gene) FROM d) AS population, (SELECT sum(hi - lo) FROM chromsizes) AS genome),
    x AS (SELECT g.term, g.genes, coalesce(regions, 0) AS regions, coalesce(genes_hit, 0) AS genes_hit, covered::DOUBLE / genome AS share, n, drawn, population
        FROM (SELECT term, count(*) AS genes FROM o GROUP BY term) g JOIN c USING (term) LEFT JOIN k USING (term) CROSS JOIN a),
    b AS (SELECT term, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(share) + (n - i) * ln(1 - share))) AS p FROM (SELECT *, unnest(range(regions, n + 1)) AS i FROM x) GROUP BY term),
    y AS (SELECT term, sum(exp(lgamma(genes + 1) - lgamma(i + 1) - lgamma(genes - i + 1) + lgamma(population - genes + 1) - lgamma(drawn - i + 1) - lgamma(population - genes - drawn + i + 1)
        - lgamma(population + 1) + lgamma(drawn + 1) + lgamma(population - drawn + 1))) AS p
        FROM (SELECT *, unnest(range(greatest(genes_hit, drawn + genes - population, 0), least(genes, drawn) + 1)) AS i FROM x) GROUP BY term),
    r AS (SELECT x.*, least(b.p, 1) AS pb, least(y.p, 1) AS ph, count(*) OVER () AS m, row_number() OVER (ORDER BY b.p) AS rb, row_number() OVER (ORDER BY y.p) AS rh FROM x JOIN b USING (term) JOIN y USING (term))
    SELECT term, regions, round(n * share, 6) AS expected, round(regions / (n * share), 6) AS fold, round(share, 6) AS share, round(pb, 6) AS p_binomial,
        round(least(1, min(pb * m / rb) OVER (ORDER BY round(pb, 12) DESC RANGE UNBOUNDED PRECEDING)), 6) AS q_binomial, genes, genes_hit, round(ph, 6) AS p_hypergeometric,
        round(least(1, min(ph * m / rh) OVER (ORDER BY round(ph, 12) DESC RANGE UNBOUNDED PRECEDING)), 6) AS q_hypergeometric FROM r""")
def term_enrichment(v: Views) -> DataFrame:
    """Terms of genes in whose domains more regions lie than chance explains."""
    regulatory = enrichment.domains(v.tss, v.chromsizes)
    return rounded(enrichment.enrichment(v.regions, regulatory, v.gene_terms, v.chromsizes), "expected", "fold", "share", "p_binomial", "q_binomial", "p_hypergeometric", "q_hypergeometric")
