"""Connected components against union-find."""

import numpy as np
import pytest

from civicframe.llm import components as C


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in pairs:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("few", [64, 3, 1])
def test_stars_and_chains(spark, monkeypatch, few):
    """Nodes with many edges, by broadcast, give what those with few give."""
    monkeypatch.setattr(C, "FEW", few)
    rng = np.random.default_rng(few)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))]
    pairs += [(1000, i) for i in range(1001, 1400)] + [(i, 5000) for i in range(1400, 1700)] + [(1399, 1400), (5000, 6000), (None, 3), (4, None), (8, 8)]
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == union_find(pairs)


def test_names_of_text(spark):
    pairs = [("b", "a"), ("c", "b"), ("x", "y"), ("b", "a"), ("q", "q")]
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(pairs, "u string, v string")).collect()}
    assert got == union_find(pairs)


def test_nodes_of_many_edges_are_bounded(spark, monkeypatch):
    """The broadcast side stays within its bound as edges grow, whatever the graph."""
    monkeypatch.setattr(C, "BROADCAST_ROWS", 4)
    monkeypatch.setattr(C, "FEW", 1)
    sizes = []
    plain = C.F.broadcast
    monkeypatch.setattr(C.F, "broadcast", lambda df: (sizes.append(df.count()), plain(df))[1])
    pairs = [(i, j) for i in range(0, 200, 10) for j in range(i + 1, i + 9)]
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == union_find(pairs) and sizes and max(sizes) <= 4
