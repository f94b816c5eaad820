import random
from collections import Counter

import pytest

from accessum.operators import tss


def _tables(spark):
    rnd = random.Random(4)
    frags = [("c%d" % rnd.randint(0, 1), lo := rnd.randint(-60, 400), lo + rnd.choice([-5, 0, 1, 2, 30, 90]), "b%d" % rnd.randint(0, 5)) for _ in range(300)]
    frags += [(None, 1, 5, "b0"), ("c0", None, 5, "b0"), ("c0", 90, 99, None)]
    sites = [("c0", 100, "+"), ("c0", 100, "+"), ("c0", 117, "-"), ("c1", 5, "-"), ("c1", 300, "."), ("c1", 333, "+")]
    return frags, sites, spark.createDataFrame(frags, "chrom string, lo int, hi int, cb string"), spark.createDataFrame(sites, "chrom string, pos int, strand string")


@pytest.mark.parametrize("f, last", [(tss.cut_sites, 1), (tss.cut_matrix, 0)])
@pytest.mark.parametrize("most", [0, 100])
def test_counts_are_those_of_loops(spark, monkeypatch, f, last, most):
    monkeypatch.setattr(tss, "MOST_SITES", most)
    monkeypatch.setattr(tss, "TASK_FRAGMENTS", 40)
    frags, sites, a, b = _tables(spark)
    want = Counter()
    for chrom, lo, hi, cb in frags:
        for c, pos, strand in sites:
            if c == chrom and lo is not None and strand != "." and lo < pos + 21 and pos - 20 < hi:
                want.update((cb, (at - pos) * (1 if strand == "+" else -1)) for at in (lo, hi - last) if abs(at - pos) <= 20)
    assert {(r.cb, r.position): r.n for r in f(a, b, 20).collect()} == want


@pytest.mark.parametrize("f", [tss.cut_sites, tss.cut_matrix])
def test_cuts_near_sites_are_not_shuffled(spark, monkeypatch, f):
    monkeypatch.setattr(tss, "TASK_FRAGMENTS", 40)
    _, _, a, b = _tables(spark)
    plan = f(a, b, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(cb" in plan and "position" not in plan.split("hashpartitioning(")[1].split(")")[0]
