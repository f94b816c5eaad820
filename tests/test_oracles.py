"""Every query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from accessum.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: Their dense SQL or output is large; the others show the same operators at this size.
HEAVY = {"impute_accessibility", "normalize_scores"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted((tuple(round(float(v), 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - HEAVY))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(map(tuple, df.select(*columns).collect())) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql(spark, name):
    """Their values are held in test_statistics.py and test_lda_passes.py; here all columns are computed."""
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(rows)) == len(rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
