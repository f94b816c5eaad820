"""Windows found by doubling against every window compared as words."""

import hashlib
import random
import re

import pytest

from accessum.llm import windows
from accessum.llm.queries import op12_repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, length=20):
    """One (id, words, removed, spans, kept) a row; rows of one id must be alike or too short to matter."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for at in range(len(words) - length + 1):
            w = tuple(words[at : at + length])
            if w in seen:
                gone[at : at + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(words), sum(gone), spans, " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "n_spans", "kept").collect()), key=repr)


def test_whole_table(spark, small):
    rows = {r["doc_id"]: r for r in op12_repeated_windows(spark, "/root/testdata/sf0.001").collect()}
    want = plain([(r["doc_id"], r["text"]) for r in small.collect()])
    assert len(rows) == len(want) and sum(x[2] for x in want) > 1000
    for i, n, removed, spans, kept in want:
        r = rows[i]
        assert (r["n_words"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("chunk,bucket", [(8 << 20, 2_000_000), (3000, 97)])
def test_repeats_within_and_across_documents(spark, chunk, bucket):
    """Few words, so that windows of the lower levels repeat everywhere; chunks and buckets small or large."""
    r = random.Random(5)
    line = lambda n, k: [r.choice("abcdefgh"[:k]) for _ in range(n)]
    passages = [line(n, 8) for n in (20, 21, 39, 40, 41, 70)]
    rows = []
    for i in range(150):
        words = line(r.choice([0, 5, 19, 20, 60]), r.choice([1, 2, 8]))
        for p in r.sample(passages, r.randint(0, 3)):
            words += p + line(r.randint(0, 30), 8)
        rows.append((r.randint(-1000, 10**12), (r.choice([" ", "\n", "\t \x0b"])).join(words) + r.choice(["", " ", "\x1c"])))
    rows += [(i, rows[7][1]) for i in range(2000, 2040)] + [(9, None), (10, ""), (11, " \n"), (None, " ".join(passages[5]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    limits = windows.Limits(chunk=chunk, bucket=bucket)
    for length, first in ((20, None), (20, 20), (8, 1), (40, 5)):
        assert got(windows.remove_repeated_windows(docs, length, first, limits=limits)) == plain(rows, length)


def test_odd_rows(spark, odd):
    """Rows of one id follow each other in some order: of alike ones the first stays."""
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for limits in (windows.Limits(), windows.Limits(chunk=1000, bucket=5000)):
        assert got(windows.remove_repeated_windows(odd, limits=limits)) == plain(rows)


def test_rows_of_one_id_and_text_count_in_turn(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text)] * 9, "doc_id int, text string").repartition(4)
    done = got(windows.remove_repeated_windows(docs, limits=windows.Limits(chunk=100)))
    assert [x[2] for x in done].count(0) == 1 and [x[2] for x in done].count(50) == 8


def test_nothing_repeats_and_nothing_at_all(spark, empty):
    assert windows.remove_repeated_windows(empty).collect() == []
    docs = spark.createDataFrame([(i, " ".join(f"{i}-{j}" for j in range(30))) for i in range(20)], "doc_id long, text string")
    assert {(x[1], x[2]) for x in got(windows.remove_repeated_windows(docs))} == {(30, 0)}
    assert {x[1:] for x in got(windows.remove_repeated_windows(docs.selectExpr("doc_id", "cast(null as string) text")))} == {(0, 0, 0, "")}


def test_what_is_refused(spark):
    with pytest.raises(TypeError):
        windows.remove_repeated_windows(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(ValueError):
        windows.remove_repeated_windows(spark.createDataFrame([(1, "b")], "doc_id long, text string"), 20, 3)


def test_chunks_are_read_in_place(spark, small):
    """Levels join marks to chunks without an exchange of the chunks."""
    plan = windows.remove_repeated_windows(small)._jdf.queryExecution().executedPlan().toString()
    join = plan.index("ShuffledHashJoin")
    right = plan.index("Exchange hashpartitioning", join)
    assert plan.index("Bucketed: true") < right
