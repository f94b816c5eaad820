"""Few links get their components in one task, without rounds; many ones, and other types, by rounds; both agree."""

import numpy as np
import pytest

from accessum.llm import components


def links_of(kind=int):
    r = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in r.integers(-400, 400, (500, 2))] + [(1000 + i, 1001 + i) for i in range(100)] + [(7, 5000 + i) for i in range(300)]
    pairs += [(2**62, -(2**62)), (3, 3), (None, 4), (7, None), (5, 6), (6, 5), (5, 6)]
    return [tuple(None if x is None else kind(x) for x in p) for p in pairs]


def roots_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize(("kind", "type_", "most"), [(int, "long", None), (int, "long", 0), (str, "string", None)])
def test_both_ways_agree(spark, monkeypatch, kind, type_, most):
    if most is not None:
        monkeypatch.setattr(components, "MOST_AT_ONCE", most)
    got = components.components(spark.createDataFrame(links_of(kind), f"a {type_}, b {type_}")).collect()
    assert {r.node: r.root for r in got} == roots_of(links_of(kind)) and len(got) == len({r.node for r in got})


def test_few_links_need_no_rounds(spark, monkeypatch):
    """Each round's plans, jobs and staged tables stay in the driver's memory."""
    names, plain = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: names.append(name) or plain(df, name))
    components.components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")).collect()
    assert names == ["links"]


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()
