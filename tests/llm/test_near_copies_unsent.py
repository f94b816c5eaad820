"""No table of the near-copy stage goes whole through the driver: a table's files can be forty times smaller than its rows."""

import random

import pytest

from accessum.llm import components, simhash


def broadcasts_after(spark, last: int) -> tuple[int, int]:
    """Broadcasts in executions after `last`, and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    found = store.executionsList()
    ids = [found.apply(i).executionId() for i in range(found.size())]
    names = []
    for i in (i for i in ids if i > last):
        nodes = store.planGraph(i).allNodes()
        names += [nodes.apply(k).name() for k in range(nodes.size())]
    return names.count("BroadcastExchange"), max(ids, default=-1)


def near_copies() -> list[tuple[int, str]]:
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    families = [[r.choice(words) for _ in range(80)] for _ in range(4)]
    rows = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(60)]
    for f, base in enumerate(families):
        for k in range(50):  # over TIED_AT_ONCE, so that blocks are compared, too
            text = list(base)
            text[r.randrange(80)] = f"x{k}"
            rows.append((1000 * (f + 1) + k, " ".join(text)))
    return rows


@pytest.mark.parametrize("most", [None, 0])
def test_joins_send_no_table_whole(spark, monkeypatch, most):
    if most is not None:  # components by rounds
        monkeypatch.setattr(components, "MOST_AT_ONCE", most)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) > 0
    last = broadcasts_after(spark, -1)[1]
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert set(range(60)) < kept and {1000, 2000, 3000, 4000} <= kept and len(kept) < 100
    sent, now = broadcasts_after(spark, last)
    assert now > last + 10 and sent == 0
