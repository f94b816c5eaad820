from accessum.operators import models
from accessum.plans import catalogue


def test_model_selection_reads_the_tables_once(spark):
    """The finished plan reads tables of counts that were written once, not the tables that they are made from."""
    plan = catalogue.QUERIES["model_selection"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_metrics_read_the_tokens_once(spark):
    tokens = spark.createDataFrame([(r, c, 1 + (r + c) % 2) for r in range(6) for c in range(5)], "region_id long, cell_id long, topic int")
    by = [tokens.filter("topic > -77").groupBy(x, "topic").count().withColumnRenamed("count", "n") for x in ("region_id", "cell_id")]
    counts = tokens.selectExpr("region_id", "cell_id", "1 as n")
    plan = models.evaluate(*by, counts, 2, 25.0, 0.1, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "-77" not in plan  # metrics read what was written of them
