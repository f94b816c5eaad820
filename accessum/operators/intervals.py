"""Interval algebra on half-open intervals (chrom, lo, hi).

Two intervals overlap when lo1 < hi2 and lo2 < hi1. Joins are equi-joins on (chrom, bin): each interval is dealt to the
bins it touches, and a pair is kept in one bin only, that of the larger of the two starts, which both sides touch; so
no distinct is needed, and a long chromosome is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1024
_KEYS = ("chrom", "lo", "hi")


def bin_of(position: str | Column, width: int) -> Column:
    """The bin of a position; negative positions round down."""
    return F.floor((F.col(position) if isinstance(position, str) else position).cast("long") / F.lit(width)).cast("long")


def bins(lo: str = "lo", hi: str = "hi", width: int = BIN) -> Column:
    """All bins that an interval touches; one for an interval without length."""
    return F.sequence(bin_of(lo, width), bin_of(F.greatest(F.col(lo), F.col(hi) - 1), width))


def _tagged(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == "chrom" else f"{c}_{tag}") for c in df.columns])


def pairs(a: DataFrame, b: DataFrame, kind: str = "overlap", width: int = BIN) -> DataFrame:
    """Every pair of an interval of a and one of b: chrom, then a's columns with _1 and b's with _2.

    kind: 'overlap', or 'containment' (a's lies within b's). Null coordinates pair with nothing; repeated rows pair
    each for itself.
    """
    if kind not in ("overlap", "containment"):
        raise ValueError(f"kind is {kind!r}")
    one, two = _tagged(a, "1"), _tagged(b, "2").withColumn("_bin", F.explode(bins("lo_2", "hi_2", width)))
    if kind == "containment":  # the bin of a's start is touched by whatever contains it
        one = one.withColumn("_bin", bin_of("lo_1", width))
        holds = (F.col("lo_1") >= F.col("lo_2")) & (F.col("hi_1") <= F.col("hi_2")) & ((F.col("lo_1") < F.col("hi_2")) | (F.col("lo_2") == F.col("hi_2")))
        return one.join(two, ["chrom", "_bin"]).filter(holds).drop("_bin")
    one = one.withColumn("_bin", F.explode(bins("lo_1", "hi_1", width)))
    meet = (F.col("lo_1") < F.col("hi_2")) & (F.col("lo_2") < F.col("hi_1"))
    once = F.col("_bin") == F.greatest(bin_of("lo_1", width), bin_of("lo_2", width))
    return one.join(two, ["chrom", "_bin"]).filter(meet & once).drop("_bin")


def counted_pairs(a: DataFrame, b: DataFrame, by: tuple[str, ...], width: int = BIN) -> DataFrame:
    """chrom, lo_2, hi_2, by's columns of a (with _1), n: how many overlapping pairs of pairs() each interval of b has with each value.

    An interval of b is in one bin only, that of its start, in bins at least as wide as itself, and a's go to all bins whose
    intervals they may meet. So all pairs of one lie in one task and are counted where they are made, none is shuffled.
    """
    keys = ["lo_2", "hi_2", *[f"{c}_1" for c in by]]
    return _met(a, b, by, width).groupBy("chrom", "_width", "_bin", *keys).agg(F.count("*").alias("n")).select("chrom", *keys, "n")


def pairs_of(a: DataFrame, b: DataFrame, by: tuple[str, ...], width: int = BIN) -> DataFrame:
    """by's columns, n: the sums of counted_pairs() over all intervals of b; a task keeps a row for each value only."""
    return _met(a, b, by, width).groupBy(*[F.col(f"{c}_1").alias(c) for c in by]).agg(F.count("*").alias("n"))


def _met(a: DataFrame, b: DataFrame, by: tuple[str, ...], width: int) -> DataFrame:
    """Overlapping pairs, each interval of b in the bin of its start only.

    Bins' widths are powers of two times width, one for each order of length that b has.
    """
    length = F.greatest(F.col("hi_2") - F.col("lo_2"), F.lit(1))
    size = F.pow(F.lit(2), F.greatest(F.ceil(F.log2(length / width)), F.lit(0))).cast("long") * width
    two = _tagged(b.select(*_KEYS), "2").filter(F.col("lo_2").isNotNull() & F.col("hi_2").isNotNull()).withColumn("_width", size)
    sizes = two.select("_width").distinct()  # some twenty rows at most
    two = two.withColumn("_bin", F.floor(F.col("lo_2").cast("long") / F.col("_width")).cast("long"))
    one = _tagged(a.select(*_KEYS, *by), "1").crossJoin(F.broadcast(sizes))
    home = lambda x: F.floor(x.cast("long") / F.col("_width")).cast("long")
    # starts from lo_1 - width (an interval of b is no longer than that) to before hi_1
    first = home(F.col("lo_1").cast("long") - F.col("_width"))
    one = one.withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, home(F.col("hi_1").cast("long") - 1)))))
    meet = (F.col("lo_1") < F.col("hi_2")) & (F.col("lo_2") < F.col("hi_1"))
    # little is shuffled and much is made of it, so partitions mustn't be put together by what they read
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, two = (df.repartition(parts, "chrom", "_width", "_bin") for df in (one, two))
    return one.join(two, ["chrom", "_width", "_bin"]).filter(meet)


def intersection(a: DataFrame, b: DataFrame, how: str = "all", rid: str = "rid", shared_only: bool = False, width: int = BIN) -> DataFrame:
    """Overlapping pairs with their common stretch: chrom, lo, hi, a's columns with _1, b's with _2.

    how: 'all'; 'containment'; 'first' or 'last' (one partner for each row of a, in order of start, then end
    descending, then rid); 'left', 'right', 'outer' (rows without partner too, the other side null and lo, hi their
    own). shared_only keeps such rows only on chromosomes that both sides have.
    """
    if how in ("first", "last"):
        found = _one_partner(a, b, how, rid, width)
    else:
        found = pairs(a, b, "containment" if how == "containment" else "overlap", width)
    common = lambda df: df.withColumns({"lo": F.greatest("lo_1", "lo_2"), "hi": F.least("hi_1", "hi_2")})  # noqa: E731  greatest and least skip nulls
    out = common(found)
    for side, (x, y, tag) in {"left": (a, b, "1"), "right": (b, a, "2")}.items():
        if how in (side, "outer"):
            alone = overlap(x, y, how="anti", rid=rid, shared_only=shared_only, width=width)
            out = out.unionByName(common(_tagged(alone, tag).select("*", *[F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c.endswith("_2" if tag == "1" else "_1")])))
    if how not in ("all", "containment", "first", "last", "left", "right", "outer"):
        raise ValueError(f"how is {how!r}")
    return out.select("chrom", "lo", "hi", *[c for c in found.columns if c != "chrom"])


def _one_partner(a: DataFrame, b: DataFrame, how: str, rid: str, width: int) -> DataFrame:
    """pairs() with the first or last partner only, in order of start, then end descending, then rid.

    Partners are compared as one number of start and end, which is aggregated in place while pairs are made; rows of b with
    the same bounds are one partner, and the row itself is joined at the end. So no pair is sorted or shuffled, but one for each row
    of a and bin. Coordinates are below 2 ** 31, as those of chromosomes.
    """
    pick, row_of = (F.min, F.min_by) if how == "first" else (F.max, F.max_by)
    start, end, span = F.col("lo_2").cast("long"), F.col("hi_2").cast("long"), 1 << 32
    found = pairs(a, b.select(*_KEYS).distinct(), width=width)
    keys = ["chrom", *[f"{c}_1" for c in a.columns if c != "chrom"]]
    best = found.groupBy(*keys).agg(pick(start * span + ((1 << 31) - 1 - end)).alias("_place"))
    best = best.withColumns({"_lo": F.shiftright("_place", 32), "_hi": (1 << 31) - 1 - F.col("_place").bitwiseAND(F.lit(span - 1))})
    two = _tagged(b, "2")
    rows = two.groupBy("chrom", start.alias("_lo"), end.alias("_hi")).agg(row_of(F.struct(*[c for c in two.columns if c != "chrom"]), F.struct(f"{rid}_2")).alias("_r"))
    return best.join(rows, ["chrom", "_lo", "_hi"]).select(*keys, "_r.*")


def shaped(found: DataFrame, coords_1: bool = False, coords_2: bool = False, info_1: bool = False, info_2: bool = False, suffix: str = "_2") -> DataFrame:
    """intersection()'s columns as asked for: chrom, lo, hi, then coordinates, then other columns of either side.

    a's other columns lose their suffix; b's keep it (as `suffix`) only where a's are there too.
    """
    other = lambda tag: [c for c in found.columns if c.endswith(tag) and c[:-2] not in _KEYS]
    columns = ["chrom", "lo", "hi"]
    columns += ["lo_1", "hi_1"] * coords_1 + ["lo_2", "hi_2"] * coords_2
    out = [F.col(c) for c in columns]
    out += [F.col(c).alias(c[:-2]) for c in other("_1") if info_1]
    out += [F.col(c).alias(c[:-2] + (suffix if info_1 else "")) for c in other("_2") if info_2]
    return found.select(*out)


def overlap(a: DataFrame, b: DataFrame, how: str = "semi", rid: str = "rid", kind: str = "overlap", shared_only: bool = False, width: int = BIN) -> DataFrame:
    """Rows of a by their partners in b; a.rid must be unique.

    how: 'semi' (once each), 'all' (once for every partner), 'anti' (rows without any). shared_only: 'anti' gives
    only rows of chromosomes on which some row of a has a partner, as engines that go chromosome by chromosome do.
    """
    if how == "all":
        found = pairs(a, b, kind, width)
        return found.select("chrom", *[F.col(f"{c}_1").alias(c) for c in a.columns if c != "chrom"]).select(*a.columns)
    hits = pairs(a, b.select(*_KEYS), kind, width).select(F.col(f"{rid}_1").alias("_hit"), F.col("chrom").alias("_chrom")).distinct()
    if how == "semi":
        return a.join(hits, F.col(rid) == F.col("_hit"), "left_semi")
    if how != "anti":
        raise ValueError(f"how is {how!r}")
    alone = a.join(hits, F.col(rid) == F.col("_hit"), "left_anti")
    return alone.join(hits.select("_chrom").distinct(), F.col("chrom") == F.col("_chrom"), "left_semi") if shared_only else alone


def within_bounds(a: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of a that lie within their chromosome's bounds; sizes has one row a chromosome: chrom, lo, hi."""
    s = sizes.select(F.col("chrom").alias("_chrom"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return a.join(s, (F.col("chrom") == F.col("_chrom")) & (F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi")), "left_semi")


def is_stranded(df: DataFrame) -> DataFrame:
    """One row: stranded, whether every strand is + or -; true for no rows, false where a strand is null."""
    return df.agg((F.count_if(~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False))) == 0).alias("stranded"))


def clusters(a: DataFrame, slack: int = 0, keys: tuple[str, ...] = ("chrom",), width: int = 1 << 20) -> DataFrame:
    """a with `cluster`, the smallest lo of the run of intervals that overlap one another in a chain; book-ended ones don't.

    slack: gap up to which intervals still join (0: they must overlap). Gaps and islands in two steps, so that a
    chromosome isn't one task: ends are carried from bin to bin by one row a bin.
    """
    keys = list(keys)
    binned = a.withColumn("_bin", bin_of("lo", width))
    w = Window.partitionBy(*keys, "_bin").orderBy("lo", "hi")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    over_bins = Window.partitionBy(*keys).orderBy("_bin")
    ends = binned.groupBy(*keys, "_bin").agg(F.max("hi").alias("_end")).withColumn("_carried", F.max("_end").over(over_bins.rowsBetween(Window.unboundedPreceding, -1)))
    reach = F.greatest(F.max("hi").over(before), F.col("_carried"))
    marked = binned.join(ends.drop("_end"), [*keys, "_bin"]).withColumn("_start", F.when(reach.isNull() | (F.col("lo") >= reach + slack), F.col("lo")))
    marked = marked.withColumn("_own", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = marked.groupBy(*keys, "_bin").agg(F.max("_start").alias("_last")).withColumn("_open", F.last("_last", ignorenulls=True).over(over_bins.rowsBetween(Window.unboundedPreceding, -1)))
    out = marked.join(last.drop("_last"), [*keys, "_bin"])
    return out.withColumn("cluster", F.coalesce("_own", "_open")).drop("_bin", "_carried", "_start", "_own", "_open")


def merged(a: DataFrame, slack: int = 0, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Clusters as intervals: keys, lo, hi, n (members)."""
    return clusters(a, slack, keys).groupBy(*keys, "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("cluster")


def nearest_ends(a: DataFrame, b: DataFrame, rid: str = "rid", width: int = 1 << 20) -> DataFrame:
    """rid, before (the largest b.hi at or before a.lo) and after (the smallest b.lo at or after a.hi); null where none.

    Overlapping intervals of b are passed over, but where they end or start exactly at a's bounds. As-of lookups within
    bins, with what earlier and later bins hold carried by one row a bin.
    """

    def as_of(points: DataFrame, asked: DataFrame, forward: bool) -> DataFrame:
        best, sign = (F.min, -1) if forward else (F.max, 1)
        # points come before questions at the same position
        both = points.select("chrom", F.col("at").alias("_at"), F.lit(0).alias("_q"), F.col("at").alias("_p"), F.lit(None).cast(dict(asked.dtypes)[rid]).alias(rid)).unionByName(
            asked.select("chrom", F.col("at").alias("_at"), F.lit(1).alias("_q"), F.lit(None).cast("long").alias("_p"), rid)
        )
        both = both.withColumn("_bin", bin_of("_at", width))
        order = F.col("_at") * sign
        near = best("_p").over(Window.partitionBy("chrom", "_bin").orderBy(order, "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        by_bin = Window.partitionBy("chrom").orderBy(F.col("_bin") * sign).rowsBetween(Window.unboundedPreceding, -1)
        carried = both.groupBy("chrom", "_bin").agg(best("_p").alias("_b")).withColumn("_far", best("_b").over(by_bin)).drop("_b")
        return both.withColumn("_near", near).filter("_q = 1").join(carried, ["chrom", "_bin"]).select(rid, F.coalesce("_near", "_far").alias("found"))

    number = lambda c: F.col(c).cast("long").alias("at")
    up = as_of(b.select("chrom", number("hi")), a.select("chrom", number("lo"), rid), False).withColumnRenamed("found", "before")
    down = as_of(b.select("chrom", number("lo")), a.select("chrom", number("hi"), rid), True).withColumnRenamed("found", "after")
    return up.join(down, rid)
