"""Connected components of a table of links: in one task while they are few, else by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import stage, unsent, unstage

#: Links up to which one task (some 100 bytes each) does without rounds, each of which costs the driver plans, jobs and staged tables.
MOST_AT_ONCE = 1 << 20


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, in order, and for each the smallest one reachable."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[i], root[j]
        i, j, a, b = (x[a != b] for x in (i, j, a, b))
        if not len(i):
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _at_once(links: DataFrame) -> DataFrame:
    """node, root of whole-number links (u, v), in one task."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches):
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if ends:
            nodes, roots = _roots(*(np.concatenate(x) for x in zip(*ends)))
            for lo in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (nodes, roots)], ["node", "root"])

    return links.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands the smallest node it sees to its larger neighbours."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    least = stage(least, "least")
    return both.filter("v > u").join(unsent(least), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours, and itself, to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    tied = down.join(unsent(least.withColumnRenamed("u", "w")), F.col("u") == F.col("w")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node that has a link: root is the smallest node reachable. links: two columns of one ordered type.

    Null ends and loops are ignored; repeated links count once. Each round is staged, so lineage stays short and a
    lost executor costs a part of one round. Rounds grow with the logarithm of the longest path. Joins are of two staged
    tables, which can be split where one node has very many links. Up to MOST_AT_ONCE links of whole numbers need no
    rounds.
    """
    u, v = links.columns
    now = stage(links.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if dict(now.dtypes)["u"] in ("int", "bigint") and now.count() <= MOST_AT_ONCE:
        return _at_once(now)
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = state
        after = stage(_small_star(_large_star(now)).filter("u != v").distinct(), "links")
        unstage(now)
        now = after
    raise RuntimeError(f"no end after {most_rounds} rounds")
