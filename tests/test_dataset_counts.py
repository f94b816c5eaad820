"""Datasets of fragments: what is filtered before counting equals what create() filters after it, and no pair is shuffled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from accessum.operators import dataset, intervals


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    frags = [("c%d" % r.randrange(2), lo := r.randrange(900), lo + r.choice([0, 1, 30, 200]), "b%d" % r.randrange(12)) for _ in range(150)]
    regions = [("c%d" % r.randrange(2), lo := r.randrange(900), lo + r.choice([15, 64, 300])) for _ in range(30)]
    black = [("c0", 100, 140, 0), ("c1", 500, 501, 1)]
    kinds = "chrom string, lo int, hi int"
    return (spark.createDataFrame(frags * 2, kinds + ", cb string"), spark.createDataFrame(regions, kinds).distinct(), spark.createDataFrame(black, kinds + ", rid int"))


@pytest.mark.parametrize("options", [{}, {"is_acc": 2}, {"min_frag": 9, "min_cell": 2}, {"is_acc": 2, "min_frag": 9, "min_cell": 2, "tag": False}])
@pytest.mark.parametrize("black", [False, True])
def test_filtered_before_counting(tables, options, black):
    frags, regions, blacklist = tables
    options = options | ({"blacklist": blacklist} if black else {})
    got = dataset.Dataset.from_fragments(frags, regions, duplicates=False, **options)
    want = dataset.Dataset.create(dataset.counts_of(frags, regions), **options)
    rows = lambda df, like: sorted(map(tuple, df.select(*like.columns).collect()), key=repr)
    assert rows(got.counts, want.counts) == rows(want.counts, want.counts) != []
    assert rows(got.regions, want.regions) == rows(want.regions, want.regions) and rows(got.cells, want.cells) == rows(want.cells, want.cells)


def test_pairs_are_not_shuffled(tables):
    """What is shuffled are fragments, regions, and sums by one of them; counts by region and cell were, several times."""
    frags, regions, blacklist = tables
    d = dataset.Dataset.from_fragments(frags, regions, blacklist=blacklist, min_frag=3)
    plan = d.regions._jdf.queryExecution().executedPlan().toString()
    assert "_bin" in plan and not re.findall(r"Exchange hashpartitioning\(cell_id", plan)


def test_partitions_of_pairs_are_not_put_together(spark, tables):
    """Few bytes are read and many pairs made of them."""
    frags, regions, _ = tables
    plan = intervals.counted_pairs(frags, regions, ("cb",), 16)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(chrom#\d+, _width#\w+, _bin#\w+, \d+\), REPARTITION_BY_NUM", plan)) == 2
    of = {r["cb"]: r["n"] for r in intervals.pairs_of(frags, regions, ("cb",), 16).collect()}
    want = intervals.pairs(frags, regions).groupBy("cb_1").agg(F.count("*").alias("n")).collect()
    assert of == {r["cb_1"]: r["n"] for r in want}
