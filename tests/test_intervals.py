import random

import pytest

from accessum.operators import intervals as iv

COLUMNS = "chrom string, lo int, hi int, rid long"
R1 = [("chr1", 1, 3, 1), ("chr1", 4, 9, 2), ("chr1", 10, 11, 3)]
R2 = [("chr1", 2, 3, 1), ("chr1", 2, 9, 2), ("chr1", 9, 10, 3)]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame(R1, COLUMNS), spark.createDataFrame(R2, COLUMNS)


def test_examples(two):
    a, b = two
    assert rows(iv.intersection(a, b), "lo", "hi", "rid_1") == [(2, 3, 1), (2, 3, 1), (4, 9, 2)]
    assert rows(iv.intersection(a, b, "first"), "lo", "hi", "rid_1", "rid_2") == [(2, 3, 1, 2), (4, 9, 2, 2)]
    assert rows(iv.intersection(a, b, "last"), "rid_1", "rid_2") == [(1, 1), (2, 2)]
    assert rows(iv.intersection(a, b, "containment"), "lo", "hi", "rid_2") == [(4, 9, 2)]
    assert rows(iv.overlap(a, b), "rid") == [(1,), (2,)]
    assert rows(iv.overlap(a, b, "all"), "rid") == [(1,), (1,), (2,)]
    assert rows(iv.overlap(a, b, "all", kind="containment"), "rid") == [(2,)]
    assert rows(iv.overlap(a, b, "anti", kind="containment"), "rid") == [(1,), (3,)]
    shaped = iv.shaped(iv.intersection(a, b), coords_1=True, coords_2=True, info_1=True)
    assert shaped.columns == ["chrom", "lo", "hi", "lo_1", "hi_1", "lo_2", "hi_2", "rid"]
    with pytest.raises(ValueError):
        iv.intersection(a, b, "sideways")


def test_only_shared_chromosomes(spark, two):
    a = two[0].union(spark.createDataFrame([("chr2", 1, 5, 9)], COLUMNS))
    assert rows(iv.overlap(a, two[1], "anti"), "rid") == [(3,), (9,)]
    assert rows(iv.overlap(a, two[1], "anti", shared_only=True), "rid") == [(3,)]
    assert rows(iv.intersection(a, two[1], "outer"), "rid_1", "rid_2") == sorted([(1, 1), (1, 2), (2, 2), (3, None), (9, None), (None, 3)], key=repr)


@pytest.mark.parametrize("width", [1, 7, 64, 4096])
def test_against_brute_force(spark, width):
    r = random.Random(width)
    make = lambda n: [(r.choice(["a", "b", "c-1:x"]), s := r.randrange(-50, 300), s + r.choice([0, 1, 2, 5, 40, 130]), i) for i in range(n)]
    one, two = make(120), make(90) + [("only", 1, 9, 900)]
    a, b = spark.createDataFrame(one, COLUMNS), spark.createDataFrame(two, COLUMNS)
    meet = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    want = sorted((x[3], y[3]) for x in one for y in two if meet(x, y))
    assert rows(iv.pairs(a, b, width=width), "rid_1", "rid_2") == sorted(want, key=repr)
    hit = {i for i, _ in want}
    assert rows(iv.overlap(a, b, width=width), "rid") == sorted(((i,) for i in hit), key=repr)
    assert rows(iv.overlap(a, b, "anti", width=width), "rid") == sorted(((x[3],) for x in one if x[3] not in hit), key=repr)


def test_clusters_and_coverage(spark):
    from accessum.operators.fragments import coverage

    r = random.Random(3)
    data = [("a", s := r.randrange(0, 3000), s + r.randrange(1, 30), i) for i in range(150)] + [("a", 5000, 5010, 900), ("a", 5010, 5020, 901), ("b", 1, 2, 902)]
    df = spark.createDataFrame(data, COLUMNS)
    want, reach = [], {}
    for c, lo, hi, _ in sorted(data):
        if c in reach and lo < reach[c]:
            want[-1][2], want[-1][3] = max(want[-1][2], hi), want[-1][3] + 1
        else:
            want.append([c, lo, hi, 1])
        reach[c] = max(reach.get(c, 0), hi)
    assert rows(iv.merged(df), "chrom", "lo", "hi", "n") == sorted(map(tuple, want), key=repr)
    assert iv.clusters(df, width=64).select("rid", "cluster").exceptAll(iv.clusters(df).select("rid", "cluster")).isEmpty()
    depth = {}
    for c, lo, hi, d in coverage(df).collect():
        for x in range(lo, hi):
            depth[c, x] = d
    brute = {}
    for c, lo, hi, _ in data:
        for x in range(lo, hi):
            brute[c, x] = brute.get((c, x), 0) + 1
    assert depth == brute


def test_nearest_across_bins(spark):
    r = random.Random(8)
    make = lambda n: [("a", s := r.randrange(0, 900), s + r.randrange(1, 60), i) for i in range(n)]
    one, two = make(60), make(25)
    got = {x.rid: (x.before, x.after) for x in iv.nearest_ends(spark.createDataFrame(one, COLUMNS), spark.createDataFrame(two, COLUMNS), width=50).collect()}
    for _, lo, hi, i in one:
        assert got[i] == (max((y[2] for y in two if y[2] <= lo), default=None), min((y[1] for y in two if y[1] >= hi), default=None))


def test_empty_and_null(spark, two):
    none = two[0].limit(0)
    odd = spark.createDataFrame([(None, 1, 2, 1), ("chr1", None, 2, 2), ("chr1", 5, 5, 3)], COLUMNS)
    assert iv.pairs(none, two[1]).isEmpty() and iv.pairs(two[0], none).isEmpty()
    assert rows(iv.overlap(odd, two[1], "anti"), "rid") == [(1,), (2,)]
    assert iv.merged(none).isEmpty()
    assert rows(iv.is_stranded(spark.createDataFrame([("+",), (None,)], "strand string")), "stranded") == [(False,)]


def test_region_ids(spark):
    from accessum.functions.regions import untagged, with_coordinates

    df = with_coordinates(spark.createDataFrame([("chr1:5-10",), ("HLA-A*01:3-4",), ("x:y:1-2",), ("nothing",), (None,)], "region string"))
    assert [tuple(x)[1:] for x in df.collect()] == [("chr1", 5, 10), ("HLA-A*01", 3, 4), ("x:y", 1, 2), (None, None, None), (None, None, None)]
    cells = spark.createDataFrame([("ACGT-1___s",), ("plain",)], "cell_name string")
    assert [x[0] for x in cells.select(untagged()).collect()] == ["ACGT-1", "plain"]
    dashed = spark.createDataFrame([("ACGT-1-s",), ("cell_7-3-s",)], "cell_name string")
    assert [x[0] for x in dashed.select(untagged("cell_name", "-")).collect()] == ["ACGT-1", "cell_7-3"]
