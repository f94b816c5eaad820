import hashlib
import re

import corpus_pipeline
from accessum.llm import queries


def stages(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs)
    return out


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs, good, exact, near, mixed, encoded = stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf, tmp_path)
    for df in (good, exact, near, mixed):
        assert df.schema.names == docs.schema.names
    texts = lambda df: {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in df.collect()}
    a, b, c = texts(good), texts(exact), texts(near)
    first = {}
    for i in sorted(a):
        first.setdefault(a[i], i)
    assert set(b) == set(first.values()) and set(c) <= set(b)
    copies = mixed.groupBy("doc_id").count().collect()
    assert {r.doc_id for r in copies} <= set(c) and max(r["count"] for r in copies) <= 3
    whole = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in mixed.collect()}
    rows = encoded.collect()
    assert len(rows) == mixed.count() and all(r.whole and r.decoded_sha256 == whole[r.doc_id] and len(r.ids) == r.n_tokens for r in rows)
    again = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.ids_sha256) for r in again.collect()) == sorted((r.doc_id, r.ids_sha256) for r in rows)


def test_odd_and_empty(spark, odd, empty, tmp_path):
    sf = "/root/testdata/sf0.001"
    last = stages(spark, odd, sf, tmp_path / "odd")[-1]
    assert last.count() >= 0
    assert stages(spark, empty, sf, tmp_path / "empty")[-1].isEmpty()


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
