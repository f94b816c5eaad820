import re
import zlib

import numpy as np
import pytest

from accessum.llm import licenses, quality


def test_pieces_of_long_texts_sum_up():
    net = quality.ByteConvNet.fresh()
    r = np.random.default_rng(0)
    for n in (0, 1, 31, 32, 33, 128, 129, 5000, 40_001):
        t = r.integers(32, 127, n, dtype=np.uint8).tobytes()
        assert net.score([t], 1 << 18)[0] == pytest.approx(net.score([t], 1000)[0], abs=1e-7)  # single precision
    many = [r.integers(32, 127, n, dtype=np.uint8).tobytes() for n in (5, 700, 0, 90, 20_000)]
    assert np.allclose(net.score(many), [net.score([t])[0] for t in many], atol=1e-9)
    full = r.integers(32, 127, quality.CHUNK, dtype=np.uint8).tobytes()
    assert net.score([full, b"#" * 500])[0] == pytest.approx(net.score([full, b"other"])[0], abs=1e-12)
    assert net.score([]).shape == (0,)


def test_gradients_match_differences():
    net = quality.ByteConvNet.fresh(3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    texts, y, w = [b"some words here, and more of them " * 9, b"###$$$ " * 30], np.array([1, 0]), np.ones(2)

    def responses(data, texts, chunks):
        flat = net.weights["embed"][data]
        n = (len(data) - quality.WIDTH) // quality.HOP
        win = np.stack([flat[i * quality.HOP : i * quality.HOP + quality.WIDTH].ravel() for i in range(n)])
        active = np.maximum(win @ net.weights["filters"] + net.weights["bias"], 0)
        ends = np.cumsum(chunks * quality.STEP + 2 * quality.BLOCK)
        for t, start, end in zip(texts, [0, *ends], ends):
            active[(start + len(t) + 1) // 2 : end // 2] = 0
        return win, active

    net.responses = responses

    def loss():
        p = np.clip(net.score(texts), 1e-12, 1 - 1e-12)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(texts, y, w)
    for k in ("filters", "dense", "out", "bias"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = net.weights[k][at]
        net.weights[k][at] = old + 1e-5
        up = loss()
        net.weights[k][at] = old - 1e-5
        down = loss()
        net.weights[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=0.05)


def test_scores_are_the_plain_sums():
    """Each filter at each second place of each chunk, one by one."""
    net = quality.ByteConvNet.fresh(5)
    w, r = net.weights, np.random.default_rng(2)
    for n in (0, 1, 7, 95, 96, 97, 128, 129, 300):
        t = r.integers(32, 127, n, dtype=np.uint8).tobytes()
        data = t + bytes(600)
        best = []
        for c in range(max(1, -(-(n - quality.BLOCK) // quality.STEP))):
            most = np.zeros(quality.FILTERS)
            for p in range(c * quality.STEP, c * quality.STEP + quality.CHUNK, quality.HOP):
                if p < max(1, n):
                    x = np.concatenate([w["embed"][b] for b in data[p : p + quality.WIDTH]])
                    most = np.maximum(most, x @ w["filters"] + w["bias"])
            best.append(most)
        hidden = np.tanh(np.mean(best, 0) @ w["dense"] + w["dense_bias"])
        assert net.score([t])[0] == pytest.approx(1 / (1 + np.exp(-(hidden @ w["out"] + w["out_bias"][0]))), abs=1e-5)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    again = quality.fit_quality(docs, labels)
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").collect()
    for r in rows[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert sum(r.predicted for r in held if r.quality) / sum(r.quality for r in held) > 0.97


def test_quality_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (3, None, 0), (99, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(odd, labels, rows=50, n_bytes=3000)
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.score_quality(empty, model).isEmpty() and quality.keep_good(empty, model).isEmpty()
    for few in (labels.limit(0), labels.filter("quality = 1")):
        constant = quality.fit_quality(odd, few)
        assert constant.prior is not None and {r.score for r in quality.score_quality(odd, constant).collect()} == {constant.prior}


def test_licence_model():
    m = licenses.fit_licences()
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            found, p, share = m.classify(t)
            assert found == family and p > 0.5 and share == 1
    for t in [*licenses.OTHER, "nothing at all", "", "We took the licence plate off.", "A long walk " * 50]:
        assert m.classify(t)[0] == licenses.UNKNOWN
    varied = [("Distributed here, licensed under the Apache License, Version 2.0 as ever", "apache-2.0"), ("code released under the MIT license by us", "mit"), ("this is licensed under CC BY-NC 4.0 only", "cc-by-nc-4.0")]
    for t, family in varied:
        assert m.classify(t)[0] == family


@pytest.mark.parametrize("name", ["odd", "small"])
def test_scan_is_the_models(name, request):
    docs, m = request.getfixturevalue(name), licenses.fit_licences()
    want = []
    for r in docs.collect():
        found = [(i, *m.classify(x)) for i, x in enumerate(re.split(licenses.PARAGRAPHS, (r.text or "").lower()))]
        found = [f for f in found if f[1] != licenses.UNKNOWN and f[2] >= licenses.LEAST_PROBABILITY]
        want.append((r.doc_id, ",".join(sorted({f[1] for f in found})), len(found), sum(f[3] >= licenses.LEAST_CONTAINED for f in found), found[0][0] if found else None, min((f[2] for f in found), default=None)))
    got = [(r.doc_id, r.licences, r.n_paragraphs, r.n_confirmed, r.first_paragraph, r.probability) for r in licenses.licence_scan(docs).collect()]
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want] and any(x[2] for x in want)
    assert [x[5] for x in got] == [x[5] and pytest.approx(x[5], abs=1e-4) for x in want]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in the
Software without restriction."""
PROBES = [("Distributed under the GPL v3.", "gpl-3.0"), ("CC BY 4.0", "cc-by-4.0"), ("Apache-2.0", "apache-2.0"), ("Published under CC0 1.0.", "public-domain"), (MIT, "mit"), ("Words of a story.\n\n" + MIT + "\n\nThe end.", "mit"), ("x " * 70_000 + MIT + " y" * 70_000, "mit")]


def test_short_and_wrapped_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PROBES)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.licence_scan(df).collect()}
    for i, (_, family) in enumerate(PROBES):
        assert (got[i].licences, got[i].n_paragraphs, got[i].n_confirmed) == (family, 1, 1), (i, got[i])


def test_scan_runs_no_python(small):
    plan = licenses.licence_scan(small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_scan_of_nothing(empty):
    assert licenses.licence_scan(empty).isEmpty() and licenses.licence_paragraphs(empty).isEmpty()
