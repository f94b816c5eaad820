import numpy as np
import pytest

from accessum.operators import models


def test_products_without_a_join(spark):
    rng = np.random.default_rng(5)
    p = rng.random((40, 4))
    rows = [(r, t + 1, float(p[r, t])) for r in range(40) for t in range(4)]
    df = spark.createDataFrame(rows, "region_id long, topic int, p double")
    got = {(r.i, r.j): r.g for r in models.topic_products(df).collect()}
    want = p.T @ p
    assert got == pytest.approx({(i + 1, j + 1): want[i, j] for i in range(4) for j in range(i, 4)})
    n = np.sqrt(np.diag(want))
    density = np.mean([want[i, j] / n[i] / n[j] for i in range(4) for j in range(i + 1, 4)])
    plan = models.cosine_density(df)
    assert plan.first()[0] == pytest.approx(density)


def test_a_table_whose_size_is_taken_for_small_is_not_broadcast(spark):
    """Topics crossed with regions count as few bytes before they are made; the table itself must not go to the driver."""
    from accessum.plans import catalogue

    df = catalogue.QUERIES["topic_cosine_density"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("part.parquet") + plan.count("p_partkey#") > 0
    # beside the cross join with ten topics only tables of topics are joined
    assert "region_id#" not in "".join(line for line in plan.splitlines() if "Join Inner" in line and "region_id" in line)
