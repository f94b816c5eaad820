import random

import pytest

#: Columns beside those of documents, some named as the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, row_id long, _row string, _times int, kept boolean, fp long, body string"


def odd_rows():
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "Delta,", "é", "日本", "x"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = line(60_000)
    texts = [None, "", " ", "\n\t ", "one", "one", "one two", "ONE two", "one  two", long, long + " more", line(40), line(400), "<|endoftext|> don't", "Licensed under CC BY-NC 4.0.", "a" * 5000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [(4, "one", "en", "s1"), (4, "one", "en", "s1"), (4, "other", None, None), (None, "one", None, None), (None, None, None, None), (-7, "one two", "en", "s0")]
    return [(*x, None, 1, "k", 5, "r", 2, False, 3, "b") for x in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns; a table, as operators on rows ask for."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
