"""The audit against a plain replay of every order, document by document."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from accessum.llm import filter_audit
from accessum.llm.queries import op11_filter_audit

NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(docs, labels):
    first, good, toxic = {}, set(), set()
    for d in docs:
        if d["doc_id"] is not None:
            first[d["text"] or ""] = min(d["doc_id"], first.get(d["text"] or "", d["doc_id"]))
    for x in labels:
        if x["doc_id"] is not None:
            good |= {x["doc_id"]} if x["quality"] == 1 else set()
            toxic |= {x["doc_id"]} if x["toxic"] == 1 else set()
    out, of_filter = defaultdict(Counter), Counter()
    for d in docs:
        t, part = d["text"] or "", d["source"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": any(c in t for c in "#$%&*|"),
            "E": d["doc_id"] is not None and d["doc_id"] > first[t],
        }
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out[part, "".join(order), step]
                removed = failed[f] and not gone
                row["redundant"] += failed[f] and gone
                gone |= failed[f]
                row["kept"] += not gone
                row["removed"] += removed
                row["unique_fails"] += [k for k, v in failed.items() if v] == [f]
                row["good_lost"] += removed and d["doc_id"] in good
                row["toxic_lost"] += removed and d["doc_id"] in toxic
                of_filter[part, f] += removed
    for part, order, step in out:
        out[part, order, step]["shapley"] = of_filter[part, order[step - 1]]
    return {k: tuple(int(v[n]) for n in NAMES) for k, v in out.items()}


def rows(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in df.collect()}


def test_whole_table(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert rows(op11_filter_audit(spark, "/root/testdata/sf0.001")) == plain(small.collect(), labels.collect())


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (4, None, 1), (4, 1, None), (9, 0, 1), (None, 1, 1), (-7, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(odd, labels)
    assert got.count() == len(rows(got))
    assert rows(got) == plain(odd.collect(), labels.collect())


def test_all_shares_of_one_part_and_its_ties(spark):
    docs = spark.createDataFrame([(i, "Same TEXT # of all" if i % 3 else None, "hot") for i in range(300)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, int(i == 7)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = rows(filter_audit.filter_audit(docs, labels))
    assert got == plain(docs.collect(), labels.collect())
    assert len(got) == 600
    for order in {k[1] for k in got}:  # every document is kept to the end or removed at one step
        assert sum(got["hot", order, s][1] for s in range(1, 6)) + got["hot", order, 5][0] == 300


def test_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(empty, labels).collect() == []


def test_texts_meet_no_python_and_orders_are_broadcast(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plan = filter_audit.filter_audit(small, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "BroadcastNestedLoopJoin" in plan and "partial_count" in plan
