"""Scalar functions on region ids, cell ids, strands and coordinates; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGION = r"^(.+):(\d+)-(\d+)$"


def region_id(chrom: str = "chrom", lo: str = "lo", hi: str = "hi") -> Column:
    """chrom:lo-hi."""
    return F.concat(F.col(chrom), F.lit(":"), F.col(lo).cast("string"), F.lit("-"), F.col(hi).cast("string"))


def with_coordinates(df: DataFrame, column: str = "region") -> DataFrame:
    """df with chrom, lo and hi parsed from region ids; null where an id doesn't parse. Chromosome names may hold - and :."""
    part = lambda i: F.regexp_extract(F.col(column), REGION, i)
    number = lambda i: F.when(part(i) != "", part(i)).cast("int")
    return df.withColumns({"chrom": F.when(part(1) != "", part(1)), "lo": number(2), "hi": number(3)})


def cell_id(barcode: str | Column, sample: str | Column) -> Column:
    """barcode___sample."""
    return F.concat(F.col(barcode) if isinstance(barcode, str) else barcode, F.lit("___"), F.col(sample) if isinstance(sample, str) else sample)


def untagged(name: str = "cell_name", separator: str = "___") -> Column:
    """The barcode of a tagged cell id. With '-' the tag is found by barcode patterns, as barcodes hold a '-' too."""
    c = F.col(name)
    if separator != "-":
        return F.split_part(c, F.lit(separator), F.lit(1))
    exact = F.regexp_extract(c, r"^([ACGT]*-[0-9]+)-", 1)
    return F.when(exact != "", exact).otherwise(F.regexp_extract(c, r"^(\w*-[0-9]*)", 1))


def extended(up: int | Column, down: int | Column, strand: str = "strand", lo: str = "lo", hi: str = "hi") -> tuple[Column, Column]:
    """Bounds moved up- and downstream by the strand; callers drop rows whose strand is neither + nor -."""
    plus = F.col(strand) == "+"
    up, down = (F.lit(x) if isinstance(x, int) else x for x in (up, down))
    return F.col(lo) - F.when(plus, up).otherwise(down), F.col(hi) + F.when(plus, down).otherwise(up)


def strand_of(number: str | Column) -> Column:
    """1, -1 and others as +, - and '.'."""
    n = F.col(number) if isinstance(number, str) else number
    return F.when(n == 1, "+").when(n == -1, "-").otherwise(".")


def log10_or_minus_infinity(x: str | Column) -> Column:
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log10(x))


def ratio(n: str | Column, d: str | Column) -> Column:
    """IEEE division: x/0 is infinite and 0/0 is NaN, where SQL's division would fail."""
    n, d = ((F.col(x) if isinstance(x, str) else x).cast("double") for x in (n, d))
    return F.when(d != 0, n / F.when(d != 0, d)).when(n == 0, F.lit(float("nan"))).otherwise(F.signum(n) * F.lit(float("inf")))
