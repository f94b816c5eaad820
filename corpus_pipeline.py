"""From raw documents to a mixed, encoded corpus: quality, exact and near copies, source weights, token ids.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. docs is a table that is written before and read again, never a plan that may
give other rows when read twice. No SQL can express the classifier, the fingerprints' links or the encoder, so
ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accessum.llm import byte_bpe, exact_dedup, mixing, quality, simhash
from accessum.llm._util import stage

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labels of documents in docs, doesn't reject."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by their SimHash fingerprints, within 2 bits or by a similarity of 0.8 on five-word shingles, the
    row with the smallest id."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target weight asks for."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and digests of ids and decoded bytes, a row for each row of the mix."""
    return byte_bpe.round_trip(docs, byte_bpe.vocabulary_path(), keep_ids=True)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
