"""Command line: python -m accessum.cli qc|tss|topics ..."""

from __future__ import annotations

import argparse
import sys

from .session import session


def _qc(a) -> None:
    from .plans import qc
    from .sources import annotation, bed

    spark = session()
    sites = annotation.read_tss(spark, a.tss).withColumnRenamed("lo", "pos")
    regions = bed.read_bed(spark, a.regions).select("chrom", "lo", "hi")
    qc.run(bed.read_fragments(spark, a.fragments), regions, sites, a.output, more_than=a.min_fragments)


def _tss(a) -> None:
    from .sources import annotation

    spark = session()
    types = None if a.types in ("", "all") else tuple(a.types.split(","))
    out = annotation.tss_of_transcripts(spark.read.csv(a.transcripts, sep="\t", header=True), types)
    if a.aliases:
        out = annotation.renamed_chromosomes(out, annotation.read_chrom_sizes(spark, a.aliases), a.source, a.target)
    annotation.write_tss(out, a.output)


def _topics(a) -> None:
    from .operators import gibbs, models

    spark = session()
    counts = spark.read.parquet(a.counts)
    for k in a.topics:
        if a.method == "variational":
            m = models.fit(counts, k, a.iterations, a.alpha, a.eta, seed=a.seed)
        else:
            sampled = gibbs.sample(counts, k, a.iterations, a.alpha, a.eta, seed=a.seed)
            m = sampled.model()
            sampled.metrics(counts).write.parquet(f"{a.output}/topics_{k}/metrics", mode="overwrite")
        m.cell_topic.write.parquet(f"{a.output}/topics_{k}/cell_topic", mode="overwrite")
        m.topic_region.write.parquet(f"{a.output}/topics_{k}/topic_region", mode="overwrite")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("accessum")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("qc", help="measures per barcode, thresholds and passing barcodes")
    for name in ("fragments", "regions", "tss", "output"):
        q.add_argument(f"--{name}", required=True)
    q.add_argument("--min-fragments", type=int, default=10)
    q.set_defaults(run=_qc)
    t = sub.add_parser("tss", help="start sites from a saved transcript table")
    for name in ("transcripts", "output"):
        t.add_argument(f"--{name}", required=True)
    t.add_argument("--types", default="protein_coding", help="comma-separated; all or empty for every type")
    t.add_argument("--aliases", help="chromosome sizes and aliases")
    t.add_argument("--source", default="ensembl")
    t.add_argument("--target", default="ucsc")
    t.set_defaults(run=_tss)
    m = sub.add_parser("topics", help="topic models of a count table")
    for name in ("counts", "output"):
        m.add_argument(f"--{name}", required=True)
    m.add_argument("--topics", type=int, nargs="+", required=True)
    m.add_argument("--method", choices=("gibbs", "variational"), default="gibbs", help="sampled, or fitted by Spark's variational method")
    m.add_argument("--iterations", type=int, default=500)
    m.add_argument("--alpha", type=float, default=50.0)
    m.add_argument("--eta", type=float, default=0.1)
    m.add_argument("--seed", type=int, default=555)
    m.set_defaults(run=_topics)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    a.run(a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
