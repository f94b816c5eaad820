"""Pile-ups and called peaks against plain loops over positions."""

import math
import random
from collections import Counter
from decimal import Decimal, localcontext

import numpy as np
import pytest

from accessum.functions import tails
from accessum.operators import calling

GENOME = 60_000


def made(seed=1):
    r = random.Random(seed)
    rows = [("one", "a", lo := r.randrange(20_000), lo + r.randrange(1, 300)) for _ in range(250)] + [("one", "b", lo := r.randrange(3000), lo + 120) for _ in range(40)]
    for centre in (2000, 9000, 9400, 15_000):
        rows += [("one", "a", lo := centre + r.randrange(-60, 60), lo + r.randrange(80, 250)) for _ in range(40)]
    rows += [("two", "a", 4090 + i % 3, 4300 - i % 5) for i in range(30)] + [("two", "a", 10, 10), ("two", "b", 0, 50)]
    return rows


def depth(rows):
    out = Counter()
    for g, c, lo, hi in rows:
        out.update((g, c, p) for p in range(lo, hi))
    return out


@pytest.mark.parametrize("width", [1 << 20, 512])
def test_pile_up_is_each_positions_depth(spark, width):
    rows, got = made(), {}
    piled = calling.pile_up(spark.createDataFrame(rows, "grp string, chrom string, lo int, hi int"), width=width).collect()
    for r in piled:
        got.update({(r["grp"], r["chrom"], p): r["height"] for p in range(r["lo"], r["hi"])})
    assert got == dict(depth(rows)) and sum(r["hi"] - r["lo"] for r in piled) == len(got)


def test_cuts(spark):
    df = spark.createDataFrame([("g", "c", 100, 500), ("g", "c", 10, 30)], "grp string, chrom string, lo int, hi int")
    got = {(r["lo"], r["hi"]) for r in calling.cuts(df).collect()}
    assert got == {(27, 173), (427, 573), (0, 83), (0, 103)}


def plain(rows, q, gap, least):
    deep, out = depth(rows), []
    for g in sorted({x[0] for x in rows}):
        at = {(c, p): d for (h, c, p), d in deep.items() if h == g}
        mean = sum(at.values()) / GENOME
        bases = Counter(at.values())
        tail = lambda k: 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k)) if k < 3 else sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k, k + 80))
        adjusted, least_q = {}, 1.0
        for k in sorted(bases):
            adjusted[k] = tail(k) * GENOME / sum(n for d, n in bases.items() if d >= k)
        for k in sorted(bases):  # the least of it and all of less height
            least_q = min(least_q, adjusted[k])
            adjusted[k] = least_q
        good = sorted(x for x, d in at.items() if adjusted[d] <= q)
        runs = []
        for c, p in good:
            if runs and runs[-1][0] == c and p - runs[-1][2] <= gap:
                runs[-1][2] = p + 1
            else:
                runs.append([c, p, p + 1])
        number = 0
        for c, lo, hi in runs:
            if hi - lo >= least:
                number += 1
                top = max(at.get((c, p), 0) for p in range(lo, hi))
                first = next(p for p in range(lo, hi) if at.get((c, p)) == top)
                end = first
                while at.get((c, end)) == top:
                    end += 1
                out.append((g, c, lo, hi, f"{g}_peak_{number}", (first + end) // 2 - lo, (top + 1) / (mean + 1), -math.log10(tail(top)), -math.log10(adjusted[top])))
    return out


@pytest.mark.parametrize("width", [1 << 20, 700])
@pytest.mark.parametrize("q,gap,least", [(0.05, 30, 146), (1e-6, 0, 20)])
def test_peaks_against_plain_loops(spark, q, gap, least, width):
    rows = made()
    got = calling.call_peaks(spark.createDataFrame(rows, "grp string, chrom string, lo int, hi int").repartition(5), GENOME, q, gap, least, width)
    got = sorted((r["grp"], r["chrom"], r["lo"], r["hi"], r["name"], r["summit"], r["fold_change"], r["minus_log10_p"], r["minus_log10_q"], r["score"], r["strand"]) for r in got.collect())
    want = sorted(plain(rows, q, gap, least))
    assert len(got) == len(want) > 3
    for a, b in zip(got, want):
        assert a[:6] == b[:6] and a[6:9] == pytest.approx(b[6:9], rel=1e-6) and a[9] == int(10 * a[8]) and a[10] == "."


def test_poisson_tail_against_sixty_digits():
    cases = [(k, m) for k in (0, 1, 2, 5, 30, 400) for m in (0.01, 0.7, 3.0, 40.0, 380.0)]
    got = tails.log_poisson_tail(*(np.array(x, float) for x in zip(*cases)))
    with localcontext() as c:
        c.prec = 60
        for (k, m), g in zip(cases, got):
            term, total = Decimal(1), Decimal(0)
            for i in range(k + 1500):
                total, term = total + (term if i >= k else 0), term * Decimal(m) / (i + 1)
            assert g == pytest.approx(float(total.ln() - Decimal(m)), rel=1e-9, abs=1e-9), (k, m)


def test_no_tags(spark):
    assert calling.call_peaks(spark.createDataFrame([], "grp string, chrom string, lo int, hi int"), GENOME).collect() == []
