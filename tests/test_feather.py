"""Feather matrices in many tasks, against the arrays they were written from."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from accessum.sources import feather, tables


def test_batches_and_columns_become_tasks(spark, tmp_path):
    x = np.arange(70.0).reshape(7, 10)
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(10)]).assign(c3=range(7), text="t")
    at = str(tmp_path / "m.feather")
    with pa.OSFile(at, "wb") as f, pa.ipc.new_file(f, pa.Schema.from_pandas(frame)) as w:
        w.write_table(pa.Table.from_pandas(frame), max_chunksize=3)
    df = feather.read_matrix(spark, at, columns=4)
    assert df.rdd.getNumPartitions() == 9
    got = {(r["row"], r["name"]): r["value"] for r in df.collect()}
    assert got == {(i + 1, c): float(frame[c][i]) for i in range(7) for c in frame.columns if c != "text"}


@pytest.mark.parametrize("compression", ["uncompressed", "lz4", "zstd"])
def test_models(spark, tmp_path, compression):
    r = np.random.default_rng(1)
    cells, regions = (pd.DataFrame(r.random((3, n)), columns=[f"{k}:{i}-{i + 9}" for i in range(n)]) for k, n in (("cell", 8), ("chr1", 20)))
    for name, df in (("cell_topic", cells), ("topic_region", regions)):
        df.to_feather(tmp_path / f"{name}.feather", compression=compression)
    one, two = tables.read_model(spark, str(tmp_path / "cell_topic.feather"), str(tmp_path / "topic_region.feather"))
    for df, key, want in ((one, "cell_id", cells), (two, "region_id", regions)):
        assert {(x[key], x["topic"]): x["p"] for x in df.collect()} == {(c, i + 1): want[c][i] for c in want for i in range(3)}


def test_no_rows_and_nulls(spark, tmp_path):
    pd.DataFrame({"a": pd.Series([], dtype=float)}).to_feather(tmp_path / "e.feather")
    assert feather.read_matrix(spark, str(tmp_path / "e.feather")).count() == 0
    pd.DataFrame({"a": [1.0, None]}).to_feather(tmp_path / "n.feather")
    assert sorted(map(tuple, feather.read_matrix(spark, str(tmp_path / "n.feather")).collect())) == [(1, "a", 1.0), (2, "a", None)]
