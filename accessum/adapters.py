"""The domain's tables as views over the driver's tables, in SQL that Spark and DuckDB both read but for what `_other` lists.

Column names avoid reserved words: chrom, lo, hi. `cell_topic` and `counts` have different cells and are never joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _case(k: str) -> str:
    names = ("view", "click", "signup", "error", "purchase")
    return f"CASE {k} % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


_SECONDS = {"spark": "(unix_timestamp(ts) - 1704067200)", "duckdb": "(floor(epoch(ts)) - 1704067200)"}
_TOPICS = {
    "spark": """SELECT vec_id AS cell_id, label, pos + 1 AS topic, cast(abs(x) AS double) / sum(cast(abs(x) AS double)) OVER (PARTITION BY vec_id) AS p
        FROM embeddings LATERAL VIEW posexplode(slice(embedding, 1, 10)) e AS pos, x""",
    "duckdb": """SELECT vec_id AS cell_id, label, t::INTEGER AS topic, abs(embedding[t])::DOUBLE / sum(abs(embedding[t])::DOUBLE) OVER (PARTITION BY vec_id) AS p
        FROM embeddings, range(1, 11) r(t)""",
}
_TEN = {"spark": "(SELECT explode(sequence(1, 10)) AS topic)", "duckdb": "(SELECT unnest(range(1, 11))::INTEGER AS topic)"}

#: name: (tables read, SQL with {seconds}, {topics}, {ten} for what differs)
_VIEWS = {
    "fragments": (("events",), """SELECT event_type AS chrom, cast({seconds} AS int) AS lo, cast({seconds} AS int) + 1 + cast(floor(value) AS int) AS hi,
        concat('cell_', cast(user_id AS {string})) AS cb, cast(1 + event_id % 4 AS int) AS score, event_id AS rid FROM events"""),
    "regions": (("part",), f"""SELECT {_case('p_partkey')} AS chrom, cast((p_partkey * 7919) % 2592000 AS int) AS lo,
        cast((p_partkey * 7919) % 2592000 + 200 + 16 * p_size AS int) AS hi, p_partkey AS rid FROM part"""),
    "tss": (("supplier",), f"""SELECT {_case('s_suppkey')} AS chrom, cast((s_suppkey * 25867) % 2592000 AS int) AS pos,
        CASE WHEN s_suppkey % 10 = 9 THEN '.' WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, s_name AS gene, s_suppkey AS rid FROM supplier"""),
    "genes": (("supplier",), f"""SELECT {_case('s_suppkey')} AS chrom, cast((s_suppkey * 25867) % 2592000 AS int) AS lo,
        cast((s_suppkey * 25867) % 2592000 + 1000 + (s_suppkey % 50) * 200 AS int) AS hi, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
        s_name AS gene, s_suppkey AS rid FROM supplier WHERE s_suppkey % 10 <> 9"""),
    "gene_terms": (("supplier",), """SELECT s_name AS gene, concat('term_', cast(s_nationkey AS {string})) AS term FROM supplier
        UNION ALL SELECT s_name, CASE WHEN s_acctbal < 0 THEN 'owed' ELSE 'owing' END FROM supplier"""),
    "blacklist": (("nation",), f"""SELECT {_case('n_nationkey')} AS chrom, cast((n_nationkey * 103687) % 2592000 AS int) AS lo,
        cast((n_nationkey * 103687) % 2592000 + 20000 AS int) AS hi, n_nationkey AS rid FROM nation"""),
    "chromsizes": (("events",), "SELECT DISTINCT event_type AS chrom, 0 AS lo, 2592000 AS hi FROM events"),
    "peaks": (("events",), """SELECT cast(user_id % 4 AS int) AS grp, event_type AS chrom, cast({seconds} AS int) AS lo,
        cast({seconds} AS int) + 1 + cast(floor(value) AS int) AS hi, cast(floor(value / 2) AS int) AS summit, value AS score,
        concat('peak_', cast(event_id AS {string})) AS name, event_id AS rid FROM events"""),
    "counts": (("lineitem", "orders"), """SELECT l_partkey AS region_id, o_custkey AS cell_id, cast(count(*) AS int) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, o_custkey"""),
    "cells": (("customer",), """SELECT c_custkey AS cell_id, c_mktsegment AS grp,
        concat('BC', cast(c_custkey AS {string}), '___s', cast(c_nationkey % 3 AS {string})) AS cell_name FROM customer"""),
    "vectors": (("embeddings",), "SELECT vec_id AS cell_id, label, embedding AS x FROM embeddings"),
    "cell_topic": (("embeddings",), "{topics}"),
    "topic_region": (("part",), """SELECT region_id, topic, cast(w AS double) / sum(w) OVER (PARTITION BY topic) AS p FROM
        (SELECT p_partkey AS region_id, topic, (p_partkey * topic * 31) % 97 + 1 AS w FROM part CROSS JOIN {ten} t) x"""),
}


def sql(name: str, engine: str) -> str:
    """The view's SQL for 'spark' or 'duckdb'."""
    return _VIEWS[name][1].format(seconds=_SECONDS[engine], topics=_TOPICS[engine], ten=_TEN[engine], string={"spark": "string", "duckdb": "varchar"}[engine])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _VIEWS[name][0]}
    body = sql(name, "spark")
    # each table is handed over as a DataFrame, so that no view of one query is seen by another
    for t in tables:
        body = _in_from(body, t)
    return spark.sql(body, **tables)


def _in_from(body: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", body)


def with_views(main: str, *names: str) -> str:
    """DuckDB SQL that defines the views it uses and then `main`."""
    head = ", ".join(f"{n} AS ({sql(n, 'duckdb')})" for n in names)
    return f"WITH {head}{', ' if main.lstrip().startswith('+') else ' '}{main.lstrip().removeprefix('+')}"
