import random

import pytest

from accessum.operators import intervals as iv

COLUMNS = "chrom string, lo int, hi int, rid long, tag string"


def _rows(rnd, n):
    return [("c%d" % rnd.randint(0, 1), lo := rnd.randint(-40, 200), lo + rnd.choice([0, 1, 5, 30, 90]), i, "t%d" % i) for i in range(n)]


@pytest.mark.parametrize("how", ["first", "last"])
def test_one_partner_is_that_of_loops(spark, how):
    rnd = random.Random(5)
    one, two = _rows(rnd, 80), _rows(rnd, 60)
    two += [(c, lo, hi, rid + 100, "again") for c, lo, hi, rid, _ in two[:30]]  # the same bounds, other rows
    two += [("c1", 2**31 - 300, 2**31 - 1, 900, "far"), ("c1", 2**31 - 300, 2**31 - 2, 901, "far")]
    one += [("c1", 2**31 - 200, 2**31 - 150, 99, "far")]
    want = {}
    for a in one:
        met = [b for b in two if a[0] == b[0] and a[1] < b[2] and b[1] < a[2]]
        if met:
            b = (min if how == "first" else max)(met, key=lambda b: (b[1], -b[2], b[3]))
            want[a[3]] = (a[0], max(a[1], b[1]), min(a[2], b[2]), a[4], b[1], b[2], b[3], b[4])
    got = iv.intersection(spark.createDataFrame(one, COLUMNS), spark.createDataFrame(two, COLUMNS), how, width=64).collect()
    assert len(got) == len(want)
    assert {r.rid_1: (r.chrom, r.lo, r.hi, r.tag_1, r.lo_2, r.hi_2, r.rid_2, r.tag_2) for r in got} == want


@pytest.mark.parametrize("how", ["first", "last"])
def test_pairs_are_not_sorted_to_pick_one(spark, how):
    rnd = random.Random(6)
    a, b = (spark.createDataFrame(_rows(rnd, 9), COLUMNS) for _ in range(2))
    plan = iv.intersection(a, b, how)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "SortAggregate" in line and "rid_1" in line]
