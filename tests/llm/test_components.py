"""Connected components against union-find."""

import numpy as np
import pytest

from quillon.llm.components import components

CHAIN = [(100 + i, 101 + i) for i in range(25)]


@pytest.mark.parametrize("edges", [[], [(5, 1), (5, 2), (9, 8), (9, 7), (8, 3), (4, 4)], CHAIN, CHAIN[::-1] + [(1, 110)], [tuple(map(int, e)) for e in np.random.default_rng(0).integers(0, 60, (50, 2))]])
def test_components(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in out} == {x: find(x) for x in parent} and len(out) == len(parent)
