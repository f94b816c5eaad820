"""Filter interaction audit: what each filter removes in every order in which five filters can be applied.

Every document's failed filters are replayed against every order: a document meets 120 rows, one an order, and each of
these five steps. A step removes the document where its filter is the first in the order that the document fails. The
sums of steps are conditional counts that Spark combines within each task, so what is shuffled is a row for each part,
order and step of a task, however many documents there are.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import stage

#: A filter's place in this text is its bit in a document's failures.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
WORD, CAPITAL, MARKUP = r"[^\x20\x09-\x0D]+", "[A-Z]", "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails: few words, few distinct words, many capitals, markup."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    fails = (n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 100 * F.regexp_count(text, F.lit(CAPITAL)) > MOST_CAPITALS * F.length(text), text.rlike(MARKUP))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def document_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, part, failed (bits of FILTERS): one row a row of docs.

    E fails where a row of a smaller id has the same text, told by SHA-256. Rows of one id don't fail for each other, and
    a null id is neither smaller nor larger than any. Texts are read once; joins see what is staged of them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("digest"), text_failures(text).alias("failed")
    )
    known = stage(read, "failures")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return known.join(first, "digest", "left").select("doc_id", "part", (F.col("failed") + F.when(copied, 1 << FILTERS.index("E")).otherwise(0)).alias("failed"))


def order_steps(spark: SparkSession) -> DataFrame:
    """filter_order, steps (step, bit, before: the bits of the order's earlier filters): 120 rows."""
    rows = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(x) for x in order]
        rows.append(("".join(order), [(i + 1, b, sum(bits[:i])) for i, b in enumerate(bits)]))
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step:int,bit:int,before:int>>")


def audit(failures: DataFrame) -> DataFrame:
    """part, filter_order, step and COUNTS, all orders and steps of each part, and shapley: the step's filter's removals
    over all orders, at any step. failures: part, failed, good, toxic."""
    replayed = failures.crossJoin(F.broadcast(order_steps(failures.sparkSession)))  # 120 rows, whatever the input
    steps = replayed.select("part", "filter_order", "failed", "good", "toxic", F.explode("steps").alias("s")).select("part", "filter_order", "failed", "good", "toxic", "s.*")
    here = F.col("failed").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("failed").bitwiseAND(F.col("before")) != 0
    first = here & ~earlier
    counted = (~here & ~earlier, first, here & earlier, F.col("failed") == F.col("bit"), first & F.col("good"), first & F.col("toxic"))
    sums = steps.groupBy("part", "filter_order", "step").agg(*[F.count_if(c).alias(name) for name, c in zip(COUNTS, counted)])
    same = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # 120 rows a filter
    return sums.withColumn("shapley", F.sum("removed").over(same))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """audit() of docs: counts by source, order and step; null sources and empty ones are the part ''.

    A document is good or toxic if any row of labels (doc_id, quality, toxic) of its id says so; null labels say
    nothing. Null texts are empty ones. Each row counts, repeated ones too. Empty docs: no rows.
    """
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    failures = document_failures(docs, id_col, text_col, source_col).join(said, "doc_id", "left")
    return audit(failures.select("part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]))
