import gzip

import pytest

from accessum.sources import annotation, bed, tables


def test_fragments_from_text(spark, tmp_path):
    p = tmp_path / "f.tsv.gz"
    with gzip.open(p, "wt") as f:
        f.write("# a comment\n\nchr1\t1\t5\tAA\t.\nchr1\t1\t5\tAA\t.\nchr2\t3\t9\tBB\t.\n")
    assert sorted(map(tuple, bed.read_fragments(spark, str(p)).collect())) == [("chr1", 1, 5, "AA", 2), ("chr2", 3, 9, "BB", 1)]
    q = tmp_path / "g.tsv"
    q.write_text("chr1\t1\t5\tAA\t3\nchr1\t1\t5\tAA\t4\n")
    assert sorted(x.score for x in bed.read_fragments(spark, str(q)).collect()) == [3, 4]
    (tmp_path / "short.bed").write_text("chr1\t1\t5\n")
    with pytest.raises(ValueError):
        bed.read_fragments(spark, str(tmp_path / "short.bed"))
    assert bed.read_bed(spark, str(tmp_path / "short.bed")).columns == ["chrom", "lo", "hi"]
    (tmp_path / "empty.bed").write_text("")
    assert bed.read_bed(spark, str(tmp_path / "empty.bed")).isEmpty()


def test_peaks_and_barcodes(spark, tmp_path):
    p = tmp_path / "x_peaks.narrowPeak"
    p.write_text("chr1\t10\t90\tp1\t50\t.\t3.5\t2.0\t1.5\t40\n")
    assert bed.read_narrow_peaks(spark, str(p)).first().summit == 40
    p.write_text("")
    with pytest.raises(ValueError):
        bed.read_narrow_peaks(spark, str(p))
    assert bed.read_narrow_peaks(spark, str(p), skip_empty=True).isEmpty()
    (tmp_path / "b.tsv").write_text("AA\t1\nBB\t2\n")
    assert [x.cb for x in bed.read_barcodes(spark, str(tmp_path / "b.tsv")).collect()] == ["AA", "BB"]


def test_tss_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 4, 5, "G", ".", "+", "protein_coding")], "chrom string, lo int, hi int, gene string, score string, strand string, transcript_type string")
    annotation.write_tss(df, str(tmp_path / "tss"))
    assert annotation.read_tss(spark, str(tmp_path / "tss")).collect() == df.collect()
    (tmp_path / "sizes.tsv").write_text("# ucsc\tlength\tensembl\trefseq_id\tgenbank_id\nchr1\t10\t1\tNC_1.1\tCM1.1\n")
    assert annotation.read_chrom_sizes(spark, str(tmp_path / "sizes.tsv")).columns == ["ucsc", "length", "ensembl", "refseq", "genbank"]
    report = '{"reports": [{"ucsc_style_name": "chr1", "length": 9, "chr_name": "1", "refseq_accession": "r", "genbank_accession": "g"}, {"ucsc_style_name": "chrUn_x", "length": 3, "chr_name": "Un", "refseq_accession": "r2", "genbank_accession": "g2"}]}'
    got = annotation.aliases_of_report(spark.createDataFrame([(report,)], "body string")).collect()
    assert [(x.ucsc, x.ensembl) for x in got] == [("chr1", "1"), ("chrUn_x", "g2")]


def test_matrix_and_qc_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("region\tc1\tc2\nchr1:1-5\t0\t2\nchr1:7-9\t1\t0\n")
    d = tables.read_count_matrix(spark, str(tmp_path / "m.tsv"), project="p")
    assert sorted(map(tuple, d.counts.select("region_id", "cell_id", "n").collect())) == [("chr1:1-5", "c2___p", 2), ("chr1:7-9", "c1___p", 1)]
    tables.write_qc({"barcodes": spark.createDataFrame([("a",)], "cb string")}, str(tmp_path / "qc"))
    assert (tmp_path / "qc.barcodes.parquet").exists() and (tmp_path / "qc.barcodes.tsv").exists()


def test_qc_run_and_stream(spark, tmp_path):
    from accessum import adapters
    from accessum.plans import qc
    from accessum.streaming import fragments as fs

    sf = "/root/testdata/sf0.001"
    view = lambda n: adapters.view(spark, sf, n)
    good = qc.run(view("fragments"), view("regions"), view("tss"), str(tmp_path / "out"), more_than=0)
    assert good.columns == ["cb"] and (tmp_path / "out.barcode_stats.parquet").exists()
    folder = tmp_path / "in"
    view("fragments").select("chrom", "lo", "hi", "cb", "score").write.csv(str(folder), sep="\t")
    q = fs.to_table(fs.running_counts(fs.fragment_stream(spark, str(folder))), str(tmp_path / "counts"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    want = view("fragments").groupBy("cb").count().collect()
    assert {(x.cb, x.unique_fragments_count) for x in spark.read.parquet(str(tmp_path / "counts")).collect()} == {(x["cb"], x["count"]) for x in want}


def test_cli_parses():
    from accessum.cli import parser

    assert parser().parse_args(["topics", "--counts", "c", "--output", "o", "--topics", "2", "5"]).topics == [2, 5]
