import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from accessum.llm import media, mixing, sharding


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000])
def test_png_round_trip(n):
    body = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    samples, size = media.from_png(media.to_png(body))
    assert size == n and samples.tobytes() == media.padded(body) and samples.tobytes()[:n] == body
    damaged = bytearray(media.to_png(body))
    damaged[-20] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(damaged))


def test_text_media(odd):
    got = media.text_media(odd).collect()
    want = []
    for r in odd.collect():
        b = (r.text or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        want.append((r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.caption == f"text of {r.n_bytes} bytes of document {r.doc_id}" and r.position == 1 and r.digest == r.media_sha256
        assert len({x.feature for x in got if x.payload_sha256 == r.payload_sha256}) == 1


def test_pages_keep_order_and_captions(spark):
    page = "<html><head><title>no</title><style>p{}</style></head><body><p>One <b>bold</b>&amp; more</p><script>no()</script><img src='a.png' alt='A'>Two<figure><img src='media:sha256-ff'><figcaption>The <i>cap</i></figcaption></figure><p>Three<br>Four<p><img alt='no source'><video src='v'></video>"
    assert [(x["kind"], x["text"] or x["src"], x["digest"], x["caption"]) for x in media.parse_page(page)] == [
        ("text", "One bold& more", None, None), ("media", "a.png", None, "A"), ("text", "Two", None, None), ("media", "media:sha256-ff", "ff", "The cap"),
        ("text", "Three", None, None), ("text", "Four", None, None), ("media", "v", None, None),
    ]
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (None, "<p>x"), (1, page)], "doc_id long, html string")
    facts = spark.createDataFrame([("ff", 7)], "media_sha256 string, width int")
    rows = media.resolve(media.interleaved(df), facts).collect()
    assert len(rows) == 15 and sum(r.width == 7 for r in rows) == 2
    for doc in (1, None):
        places = [r.position for r in rows if r.doc_id == doc]
        assert sorted(set(places)) == list(range(len(set(places))))


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    items = media.interleaved(pages, "page_id").collect()
    assert len(items) == pages.count() and all([x.position for x in r["items"]] == list(range(len(r["items"]))) for r in items)


def plan_of(docs, **options):
    return mixing.mix_plan(docs, **options).collect()


def test_targets_and_copies(odd, small):
    for docs in (odd, small):
        rows = plan_of(docs)
        assert len(rows) == docs.count()
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        for r in rows:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(sizes)))
        free, want, left = set(sizes), {}, sum(sizes.values())
        while free:
            share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
            over = {s for s in free if share[s] > 3 * sizes[s]}
            if not over:
                want |= share
                break
            want |= {s: 3 * sizes[s] for s in over}
            left -= sum(3 * sizes[s] for s in over)
            free -= over
        biggest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
        for s in sizes:
            assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 2 * biggest[s] + 1
        for r in rows:
            assert r.source_size == sizes[r.source]
            if sizes[r.source]:
                assert int(target[r.source] / sizes[r.source]) <= r.copies <= int(target[r.source] / sizes[r.source]) + 1


def test_reruns_agree_and_rows_repeat(odd):
    assert sorted(map(repr, plan_of(odd))) == sorted(map(repr, plan_of(odd)))
    plan = mixing.mix_plan(odd)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    want = {k: v for k, v in plan.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if v}
    assert {k: v for k, v in mixed.groupBy("doc_id").count().collect()} == want


def test_shards(odd, small):
    for docs, shards in ((odd, 4), (small, 40), (small, 1)):
        rows = sharding.balanced_shards(docs, shards).collect()
        assert len(rows) == docs.count()
        assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect() if r.doc_id is not None)
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        share, last = sum(r.size for r in rows) / shards, None
        for k in sorted(by):
            assert sorted(r.slot for r in by[k]) == list(range(len(by[k])))
            ordered = sorted(by[k], key=lambda r: r.slot)
            ids = [-(10**9) if r.doc_id is None else r.doc_id for r in ordered]
            assert ids == sorted(ids) and (last is None or ids[0] >= last)
            last = ids[-1]
            assert abs(sum(r.size for r in by[k]) - share) <= ordered[0].size + ordered[-1].size + max(r.size for r in rows)


def test_empty(empty):
    assert media.text_media(empty).isEmpty() and mixing.mix_plan(empty).isEmpty() and mixing.mix(empty).isEmpty()
    assert sharding.balanced_shards(empty).isEmpty()
