"""Tries against sorted counts, and the audit against plain arithmetic over every term, source and pair."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from accessum.llm import divergence, tries
from accessum.llm.queries import op13_source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, least=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        terms = TERM.findall((r["text"] or "").translate(SMALL))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = set()

    def ranked(lang, source, part, found, top=None):
        for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top], 1):
            out.add((lang, source, part, item, value, rank))

    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v, of = len(kept), {s: [counts[lang, s][t] for t in kept] for s in sources}
        p = {s: [1 + 10**9 * (c + 2) // (sum(n) + 2 * v) for c in n] for s, n in of.items()}
        every = [sum(c) for c in zip(*of.values())]
        q = [1 + 10**9 * (c + 2) // (sum(every) + 2 * v) for c in every]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            ranked(lang, s, "pair", [(sum(map(f, p[s], p[x])), x) for x in sources if x != s])
            ranked(lang, s, "term", [(f(a, b), t) for t, c, a, b in zip(kept, of[s], p[s], q) if c and a > b], 10)
    return out


def rows(df):
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def words(seed, n):
    r = random.Random(seed)
    return [bytes(r.choice(b"ab\xc3\xa9") for _ in range(r.randint(1, 9))) for _ in range(n)]


def rows_of(found, depth):
    """Subtree rows of {term: {source: count}}, in which a term's documents are the sum of its counts."""
    terms = sorted(found)
    sizes = np.array([len(found[t]) for t in terms])
    sources, counts = (np.array([f(x) for t in terms for x in found[t].items()], np.int64) for f in (lambda x: x[0], lambda x: x[1]))
    return list(tries.subtrees(b"", terms, np.array([sum(found[t].values()) for t in terms]), sizes, sources, counts, depth))


def test_subtrees_merge_and_walk_in_byte_order():
    want, roots = defaultdict(Counter), {}
    for seed in range(5):
        found = defaultdict(Counter)
        for i, w in enumerate(words(seed, 300)):
            found[w][i % 3 - 1] += 1
            want[w][i % 3 - 1] += 1
        for row in rows_of(found, 2):
            assert [row["path"] + t for t in tries.terms_of(row)] == sorted(t for t in found if t[:2] == row["path"])
            tries.merge(roots.setdefault(row["path"], tries.Node()), row)
    got = [x for path in sorted(roots) for x in tries.walk(roots[path], path)]
    assert [t for t, _ in got] == sorted(want)
    assert all(x.counts == dict(want[t]) and x.docs == sum(want[t].values()) for t, x in got)


def test_terms_one_within_another_are_no_deep_recursion():
    root = tries.Node()
    for start in (1, 2):
        for row in rows_of({b"a" * n: {7: n} for n in range(start, 4000, 2)}, 3):
            tries.merge(tries.down(root, row["path"]), row)
    assert [(len(t), x.counts[7]) for t, x in tries.walk(root)] == [(n, n) for n in range(1, 4000)]


def test_whole_table(spark, small):
    assert rows(op13_source_divergence(spark, "/root/testdata/sf0.001")) == plain(small.collect())


def test_odd_rows(spark, odd):
    assert rows(divergence.divergence_audit(odd)) == plain(odd.collect())
    assert rows(divergence.divergence_audit(odd, least=2)) == plain(odd.collect(), 2)


def test_ties_groups_without_terms_and_langs_of_one_source(spark):
    texts = [("en", "a", "Zeta alpha éa é"), ("en", "b", "beta gamma"), ("en", None, "12 34 _"), ("en", "c", None), ("de", "only", "eins zwei drei"), ("", "x", "!"), (None, "y", "9")] * 12
    docs = spark.createDataFrame(texts, "lang string, source string, text string")
    got = rows(divergence.divergence_audit(docs))
    assert got == plain(docs.collect())
    assert [x[3] for x in sorted(got, key=lambda x: x[5]) if x[:3] == ("en", "a", "term")] == ["alpha", "zeta", "é", "éa"]
    assert {x[4] for x in got if x[0] == "" and x[2] == "pair"} == {0}


def test_small_blocks_and_heavy_prefixes_change_nothing(spark, small):
    limits = divergence.Limits(depth=2, most_terms=200, most_held=500, most_words=3000, block=7, piece=100)
    assert divergence.term_tries(small, limits=limits).selectExpr("max(length(path)) n").first().n > 2
    assert rows(divergence.divergence_audit(small, limits=limits)) == plain(small.collect())


def test_scaled_is_exact():
    r = random.Random(1)
    for _ in range(2000):
        of = r.randint(2, 290_000_000_000_000)
        c = r.randint(0, of - 2)
        assert int(divergence._scaled(np.array([c]), np.int64(of))[0]) == 1 + 10**9 * (c + 2) // of


def test_empty(spark, empty):
    assert divergence.divergence_audit(empty).collect() == []
