"""Gene and chromosome annotation: start sites, chromosome sizes and aliases. Services are read from saved responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.regions import strand_of

#: Column names of start-site and chromosome files.
TSS_COLUMNS = ("# Chromosome", "Start", "End", "Gene", "Score", "Strand", "Transcript_type")
TSS_NAMES = ("chrom", "lo", "hi", "gene", "score", "strand", "transcript_type")
ALIASES = ("ucsc", "ensembl", "refseq", "genbank")
#: Forms of names, from the public descriptions of accession numbers. GenBank's are 1 letter and 5 digits, 2
#: letters and 6 or 8 digits, or for shotgun assemblies 4 letters and 8 digits or more, or 6 and 9 or more; RefSeq's genomic
#: ones are a prefix, an underscore and digits or a shotgun accession. Both end with a version.
_PATTERNS = {
    "ucsc": r"^chr",
    "genbank": r"^([A-Z][0-9]{5}|[A-Z]{2}[0-9]{6}|[A-Z]{2}[0-9]{8}|[A-Z]{4}[0-9]{8,}|[A-Z]{6}[0-9]{9,})\.[0-9]+$",
    "refseq": r"^(AC|NC|NG|NT|NW|NZ)_([0-9]{6,}|[A-Z]{4}[0-9]{8,}|[A-Z]{6}[0-9]{9,})\.[0-9]+$",
}


def read_tss(spark: SparkSession, path: str) -> DataFrame:
    """chrom, lo, hi, gene, score, strand, transcript_type from a file with a '# Chromosome' header."""
    df = spark.read.csv(path, sep="\t", header=True, quote="")
    df = df.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(TSS_COLUMNS, TSS_NAMES)])
    return df.withColumns({"lo": F.col("lo").cast("int"), "hi": F.col("hi").cast("int")})


def write_tss(df: DataFrame, path: str) -> None:
    df.select(*[F.col(b).alias(a) for a, b in zip(TSS_COLUMNS, TSS_NAMES)]).write.csv(path, sep="\t", header=True, quote="", mode="overwrite")


def tss_of_transcripts(transcripts: DataFrame, types: tuple[str, ...] | None = ("protein_coding",)) -> DataFrame:
    """Start sites of a saved transcript table: chrom, tss (from 1), strand (1, -1), gene, transcript_type; no types: all."""
    if types:
        transcripts = transcripts.filter(F.col("transcript_type").isin(*types))
    return transcripts.select("chrom", (F.col("tss") - 1).cast("int").alias("lo"), F.col("tss").cast("int").alias("hi"), "gene", F.lit(".").alias("score"), strand_of("strand").alias("strand"), "transcript_type")


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """ucsc, length, ensembl, refseq, genbank, whichever of the two spellings of the last two a file has."""
    df = spark.read.csv(path, sep="\t", header=True, quote="").withColumnRenamed("# ucsc", "ucsc")
    for old, new in (("refseq_id", "refseq"), ("genbank_id", "genbank")):
        df = df.withColumnRenamed(old, new)
    return df.withColumn("length", F.col("length").cast("long"))


def aliases_of_list(table: DataFrame, sizes: DataFrame, names: str = "names") -> DataFrame:
    """ucsc, length, ensembl, refseq, genbank from lists of a sequence's names, sorted into their kinds by pattern.

    table: one column, an array of names; sizes: ucsc, length; sequences without a size are left out.
    """

    def pick(pattern: str, wanted: bool = True):
        def test(x):
            return x.rlike(pattern) if wanted else ~x.rlike(pattern)

        return F.try_element_at(F.filter(F.col(names), test), F.lit(1))

    other = "|".join(f"(?:{p})" for p in _PATTERNS.values())
    found = table.select(pick(_PATTERNS["ucsc"]).alias("ucsc"), pick(other, False).alias("ensembl"), pick(_PATTERNS["refseq"]).alias("refseq"), pick(_PATTERNS["genbank"]).alias("genbank"))
    return found.join(sizes.select("ucsc", "length"), "ucsc").select("ucsc", "length", "ensembl", "refseq", "genbank")


def aliases_of_report(response: DataFrame, column: str = "body") -> DataFrame:
    """ucsc, length, ensembl, refseq, genbank from a saved sequence report (JSON); ensembl is the GenBank name of sequences
    whose UCSC name holds '_', else the chromosome's name."""
    schema = "reports array<struct<ucsc_style_name:string,length:long,chr_name:string,refseq_accession:string,genbank_accession:string>>"
    r = response.select(F.explode(F.from_json(column, schema)["reports"]).alias("r")).select("r.*")
    ensembl = F.when(F.contains("ucsc_style_name", F.lit("_")), F.col("genbank_accession")).otherwise(F.col("chr_name"))
    return r.select(F.col("ucsc_style_name").alias("ucsc"), "length", ensembl.alias("ensembl"), F.col("refseq_accession").alias("refseq"), F.col("genbank_accession").alias("genbank"))


def datasets_of_species(datasets: DataFrame, species: str) -> DataFrame:
    """Rows of a saved dataset list (display_name, name) whose name holds the species, whatever the case."""
    low = species.lower()
    return datasets.filter(F.lower("display_name").contains(low) | F.lower("name").contains(low))


def renamed_chromosomes(bed: DataFrame, aliases: DataFrame, source: str, target: str) -> DataFrame:
    """bed with chromosome names of one source changed to another's; unmapped names stay. aliases: a row a sequence."""
    m = aliases.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("_from"), F.col(target).alias("_to")).dropDuplicates(["_from"])
    return bed.join(m, F.col("chrom") == F.col("_from"), "left").withColumn("chrom", F.coalesce("_to", "chrom")).drop("_from", "_to")


def likely_source(bed: DataFrame, aliases: DataFrame) -> DataFrame:
    """source, n, best: how many names of each source are among bed's chromosomes; the largest is best, ties in order of ALIASES."""
    long = aliases.select(*ALIASES).unpivot([], list(ALIASES), "source", "chrom").filter("chrom is not null").distinct()
    hits = long.join(bed.select("chrom").distinct(), "chrom", "left_semi").groupBy("source").agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*[F.lit(a) for a in ALIASES]), F.col("source"))
    all_sources = bed.sparkSession.createDataFrame([(a,) for a in ALIASES], "source string")
    out = all_sources.join(hits, "source", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc("n"), order)) == 1)
