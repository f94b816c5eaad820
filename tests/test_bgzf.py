"""Block-gzipped files: every cut gives every line once, indexes lose nothing and spare reading, and other readers agree."""

import gzip
import random

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan
from pyspark.sql import types as T

from accessum.sources import bed, bgzf

SCHEMA = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("name", T.StringType())])


def members(text, sizes):
    """text in members of the sizes given, in turn: lines cross them anywhere."""
    out, at, i = [], 0, 0
    while at < len(text):
        n = sizes[i % len(sizes)]
        out.append(bgzf.compressed(text[at : at + n]))
        at, i = at + n, i + 1
    return b"".join(out) + bgzf.END


def made(seed, n=400):
    r = random.Random(seed)
    rows = sorted((f"chr{r.randint(1, 3)}", lo, lo + r.choice([0, 1, 50, 3000, 200_000]), "n" * r.choice([1, 5, 300])) for lo in (r.randrange(3_000_000) for _ in range(n)))
    return rows, "".join("\t".join(map(str, x)) + "\n" for x in rows).encode()


def read_by(reader):
    """Bytes of text in a reader's ranges."""
    total = 0
    for t in reader.partitions():
        for r in t.ranges:
            with open(r.path, "rb") as f:
                total += sum(map(len, bgzf._lines(f, r)))
    return total


def test_cuts_anywhere_give_every_line_once(tmp_path):
    for seed, sizes in enumerate([[7], [64], [1000, 3], [5000], [40, 1, 900]]):
        rows, text = made(seed, 120)
        text = text[:-1] if seed % 2 else text  # the last line may lack its end
        at = tmp_path / f"{seed}.bed.gz"
        at.write_bytes(members(text, sizes))
        assert gzip.decompress(at.read_bytes()) == text and bgzf.is_bgzf(str(at))
        for split in (1, 100, 700, 10_000, 1 << 30):
            reader = bgzf._Reader([str(at)], SCHEMA, split)
            parts = reader.partitions()
            got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
            assert got == rows
            assert len(parts) > 5 or split > 100 or sizes == [5000]


def test_written_files_have_indexes_that_spare_reading(spark, tmp_path):
    rows, _ = made(9, 60_000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    at = str(tmp_path / "out")
    bgzf.write_bgzf(df, at)
    files = sorted((tmp_path / "out").glob("*.gz"))
    lines = [x for f in files for x in gzip.decompress(f.read_bytes()).decode().splitlines()]
    assert sorted(lines) == sorted("\t".join(map(str, x)) for x in rows) and len(list((tmp_path / "out").iterdir())) == 2 * len(files)
    back = bgzf.read_bgzf(spark, at, SCHEMA, split=20_000)
    assert sorted(map(tuple, back.collect())) == rows
    every = back.rdd.getNumPartitions()
    assert every > 8
    for chrom, lo, hi in (("chr2", 1_000_000, 1_050_000), ("chr1", 0, 1), ("chr3", 2_999_000, 3_300_000), ("chr9", 0, 10**6)):
        part = back.filter((back.chrom == chrom) & (back.lo < hi) & (back.hi > lo))
        assert sorted(map(tuple, part.collect())) == [x for x in rows if x[0] == chrom and x[1] < hi and x[2] > lo]
        assert f"EqualTo(chrom,{chrom})" in part._sc._jvm.PythonSQLUtils.explainString(part._jdf.queryExecution(), "formatted")
        asked = bgzf._Reader(list(map(str, files)), SCHEMA, 20_000)
        assert asked.pushFilters([EqualTo(("chrom",), chrom), LessThan(("lo",), hi), GreaterThan(("hi",), lo)]) == []
        assert read_by(asked) < read_by(bgzf._Reader(list(map(str, files)), SCHEMA, 20_000)) / 4
    two = back.filter("chrom in ('chr1', 'chr3') and lo >= 2000000 and hi <= 2500000")
    assert sorted(map(tuple, two.collect())) == [x for x in rows if x[0] in ("chr1", "chr3") and x[1] >= 2_000_000 and x[2] <= 2_500_000]
    whole = back.filter("lo > 2900000")
    assert sorted(map(tuple, whole.collect())) == [x for x in rows if x[1] > 2_900_000]


def test_index_against_every_interval(tmp_path):
    rows, text = made(4, 3000)
    index, at, out = bgzf.Index(), 0, b""
    for i in range(0, len(rows), 40):
        held = b""
        for x in rows[i : i + 40]:
            line = ("\t".join(map(str, x)) + "\n").encode()
            index.add(x[0], x[1], x[2], at << 16 | len(held), at << 16 | len(held) + len(line))
            held += line
        out += bgzf.compressed(held)
        at = len(out)
    f = tmp_path / "a.bed.gz"
    f.write_bytes(out + bgzf.END)
    (tmp_path / "a.bed.gz.tbi").write_bytes(index.to_bytes())
    again = bgzf.Index.read(str(f))
    assert {c: x[0] for c, x in again.chromosomes.items()} == {c: x[0] for c, x in index.chromosomes.items()}
    r = random.Random(2)
    for _ in range(60):
        lo = r.randrange(3_000_000)
        hi = lo + r.choice([1, 1000, 10**6])
        chrom = f"chr{r.randint(1, 3)}"
        got = [tuple(x.values()) for a, b in again.ranges([chrom], lo, hi) for t in [b"".join(bgzf._lines(open(f, "rb"), bgzf.Range("", a, b, True, False)))] for x in bgzf._parsed(t, bgzf.to_arrow_schema(SCHEMA)).to_pylist()]
        want = [x for x in rows if x[0] == chrom and x[1] < hi and x[2] > lo]
        assert [x for x in got if x[0] == chrom and x[1] < hi and x[2] > lo] == want and len(got) == len(set(got)) or len(set(rows)) < len(rows)


def test_bed_reader_takes_them_and_plain_gzip_alike(spark, tmp_path):
    rows, text = made(7, 200)
    text = b"# made\n\n" + text
    blocked, plain = tmp_path / "a.bed.gz", tmp_path / "b.bed.gz"
    blocked.write_bytes(members(text, [300]))
    plain.write_bytes(gzip.compress(text))
    one, two = bed.read_bed(spark, str(blocked)), bed.read_bed(spark, str(plain))
    assert one.schema == two.schema and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) == rows
    assert not bgzf.is_bgzf(str(plain))
    frag = tmp_path / "f.tsv.gz"
    frag.write_bytes(members(b"chr1\t1\t5\tAA\t2\nchr1\t4\t9\tBB\t1\n", [11]))
    assert sorted(map(tuple, bed.read_fragments(spark, str(frag)).select("chrom", "lo", "hi", "cb", "score").collect())) == [("chr1", 1, 5, "AA", 2), ("chr1", 4, 9, "BB", 1)]


def test_empty_nulls_broken(spark, tmp_path):
    at = tmp_path / "e.bed.gz"
    at.write_bytes(bgzf.END)
    assert bgzf.read_bgzf(spark, str(at), SCHEMA).count() == 0 and bgzf.first_line(str(at)) is None
    bgzf.write_bgzf(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    bgzf.write_bgzf(spark.createDataFrame([("c", 1, 2, None)], SCHEMA), str(tmp_path / "null"))
    assert [tuple(r) for r in bgzf.read_bgzf(spark, str(tmp_path / "null"), SCHEMA).collect()] == [("c", 1, 2, ".")]
    (tmp_path / "cut.bed.gz").write_bytes(members(b"c\t1\t2\tx\n" * 50, [100])[:-60])
    with pytest.raises(Exception, match="broken"):
        bgzf.read_bgzf(spark, str(tmp_path / "cut.bed.gz"), SCHEMA).count()
    with pytest.raises(ValueError):
        bgzf.write_bgzf(spark.createDataFrame([(1, "c")], "lo int, chrom string"), str(tmp_path / "x"))
