"""Topic tables: smoothing, scaling, binarization, quality and annotation. Long form: id, topic, p."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import thresholds

NTOP, TINY = 2000, 1e-100


def smoothed(df: DataFrame, id_col: str) -> DataFrame:
    """p * (ln(p + tiny) - mean over the id's topics of ln(p + tiny))."""
    ln = F.log(F.col("p") + F.lit(TINY))
    return df.withColumn("p", F.col("p") * (ln - F.avg(ln).over(Window.partitionBy(id_col))))


def cutoffs(df: DataFrame, id_col: str, method: str = "otsu", bins: int = thresholds.BINS, ntop: int = NTOP) -> DataFrame:
    """topic, threshold on p scaled to 0..1 within the topic. ntop: the score at place ntop from 0 (equal scores all drop out)."""
    scaled = df.withColumn("scaled", stats.min_max("p", ["topic"]))
    if method == "ntop":
        w = Window.partitionBy("topic").orderBy(F.desc("scaled"), id_col)
        return scaled.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") == ntop + 1).select("topic", F.col("scaled").alias("threshold"))
    f = {"otsu": thresholds.otsu, "yen": thresholds.yen, "li": thresholds.li}.get(method)
    if f is None:
        raise ValueError(f"method is {method!r}")
    return f(scaled, "scaled", ("topic",), bins)


def binarized(df: DataFrame, id_col: str, method: str = "otsu", smooth: bool = False, bins: int = thresholds.BINS, ntop: int = NTOP, predefined: DataFrame | None = None) -> DataFrame:
    """topic, id, score (p as it is, smoothed if asked) of what lies above its topic's threshold; all topics in one plan."""
    if smooth:
        df = smoothed(df, id_col)
    cut = predefined if predefined is not None else cutoffs(df, id_col, method, bins, ntop)
    scaled = df.withColumn("scaled", stats.min_max("p", ["topic"]))
    return scaled.join(F.broadcast(cut), "topic").filter(F.col("scaled") > F.col("threshold")).select("topic", id_col, F.col("p").alias("score"))  # cut: one row a topic


def topic_metrics(cell_topic: DataFrame, cell_sizes: DataFrame, coherence: DataFrame | None = None) -> DataFrame:
    """topic, assignments (cells' sizes shared by topic), log10_assignments, marginal, gini; coherence where given.

    cell_sizes: cell_id, nr_frag.
    """
    weighted = cell_topic.join(cell_sizes.select("cell_id", "nr_frag"), "cell_id").groupBy("topic").agg(F.sum(F.col("p") * F.col("nr_frag")).alias("assignments"))
    whole = F.sum("assignments").over(Window.partitionBy(F.lit(0)))
    out = weighted.withColumns({"log10_assignments": F.log10("assignments"), "marginal": F.col("assignments") / whole}).join(stats.gini(cell_topic, "topic", "p"), "topic")
    return out if coherence is None else out.join(coherence, "topic", "left")


def annotated(members: DataFrame, cells: DataFrame, group: str, general: float = 0.2) -> DataFrame:
    """topic, groups (those that a one-sided test of proportions ties to the topic at 5 %, sorted), cell_ratio, group_ratio, is_general.

    members: topic, cell_id of the binarized topics; cells: cell_id and the group. A group's share of its cells in the
    topic is held against the topic's share of all cells.
    """
    upper = 1.6448536269514722  # the normal law's 95 % point
    sizes = cells.groupBy(group).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("cells"), F.count("*").alias("groups"))
    hit = members.join(cells, "cell_id").groupBy("topic", group).agg(F.count("*").alias("hits"))
    share = hit.groupBy("topic").agg(F.sum("hits").alias("in_topic"))
    tested = hit.join(share, "topic").join(F.broadcast(sizes), group).crossJoin(F.broadcast(total))  # one row
    p = F.col("hits") / F.col("size")
    z = (p - F.col("in_topic") / F.col("cells")) / F.sqrt(p * (1 - p) / F.col("size"))
    tied = (p >= 1) | (z > upper)
    out = tested.groupBy("topic").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(tied, F.col(group)))), ", ").alias("groups"), F.first(F.col("in_topic") / F.col("cells")).alias("cell_ratio"),
        (F.count_if(tied) / F.first("groups")).alias("group_ratio"),
    )
    return out.withColumn("is_general", F.col("cell_ratio") - F.col("group_ratio") > general)


def select_topics(metrics: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Topics whose metrics lie strictly between the bounds given."""
    for name, (low, high) in ranges.items():
        if low is not None:
            metrics = metrics.filter(F.col(name) > low)
        if high is not None:
            metrics = metrics.filter(F.col(name) < high)
    return metrics.select("topic")


def group_means(cell_topic: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """topic, group, mean p, and whether the group is the topic's largest (ties to the first group)."""
    means = cell_topic.join(cells, "cell_id").groupBy("topic", group).agg(F.avg("p").alias("mean"))
    w = Window.partitionBy("topic").orderBy(F.desc("mean"), group)
    return means.withColumn("top", F.row_number().over(w) == 1)
