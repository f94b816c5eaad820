from pyspark.sql import functions as F

from accessum.operators import intervals as iv


def test_bins_hold_few_rows_that_do_not_meet(spark):
    """Regions of 600 bases and fragments of 100: under four comparisons for each pair that is found."""
    a = spark.range(500).select(F.lit("c").alias("chrom"), (F.col("id") * 131).cast("int").alias("lo"), (F.col("id") * 131 + 100).cast("int").alias("hi"), F.col("id").alias("rid"))
    b = spark.range(500).select(F.lit("c").alias("chrom"), (F.col("id") * 130).cast("int").alias("lo"), (F.col("id") * 130 + 600).cast("int").alias("hi"), F.col("id").alias("rid"))
    one, two = (df.select("rid", F.explode(iv.bins()).alias("bin")) for df in (a, b))
    assert one.join(two, "bin").count() < 4 * iv.pairs(a, b).count()
