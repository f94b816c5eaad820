"""Rows are told apart by stored numbers: results don't change where a table is split otherwise at each reading."""

import pytest

from accessum.llm import _util, exact_dedup, mixing, simhash, substrings
from accessum.llm import licenses


@pytest.fixture
def restless(spark, monkeypatch, tmp_path):
    """documents of sf0.001, and a staging that changes how tables are split after each table it writes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(7).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "docs"))
    plain, turns = _util.stage, iter(range(10**6))

    def stage(df, name):
        out = plain(df, name)
        spark.conf.set("spark.sql.files.minPartitionNum", [1, 40, 9, 23][next(turns) % 4])
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        return out

    def change():
        for module in (_util, exact_dedup, mixing, simhash, substrings, licenses):
            if hasattr(module, "stage"):
                monkeypatch.setattr(module, "stage", stage)

    yield lambda: spark.read.parquet(str(tmp_path / "docs")), change
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("f", [exact_dedup.drop_exact_copies, simhash.drop_near_copies, mixing.mix, substrings.remove_repeats, licenses.licence_scan])
def test_other_splits(restless, f):
    docs, change = restless
    rows = lambda: sorted(repr([v for k, v in r.asDict().items() if k != "row_id"]) for r in f(docs()).collect())
    want = rows()
    change()
    assert rows() == want
