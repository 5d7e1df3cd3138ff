"""Betweenness with a stated error, against searches from all nodes."""

import random
from collections import defaultdict, deque

import pytest

from corvane.operators import graph, paths


def brute(edges):
    """Shares of ordered pairs, by a search from each node."""
    after, nodes, load = defaultdict(set), {x for e in edges for x in e}, defaultdict(float)
    for a, b in edges:
        after[a].add(b)
    for s in nodes:
        depth, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in after[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        part = defaultdict(float)
        for v in reversed(order):
            part[v] = sum(paths[v] / paths[w] * (1 + part[w]) for w in after[v] if depth[w] == depth[v] + 1)
            if v != s:
                load[v] += part[v]
    n = len(nodes)
    return {v: load[v] / ((n - 1) * (n - 2)) for v in nodes}


def table(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def test_all_pivots_are_exact(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(70)] + [(1, 1), (1, 2), (1, 2)]  # loops and repeats
    got = graph.betweenness_within(table(spark, edges), tolerance=0.0, first=8, block=11).collect()
    want = brute([e for e in edges if e[0] != e[1]])
    assert {r.node for r in got} == {x for e in edges for x in e} and {(r.error, r.n_pivots) for r in got} == {(0.0, len(got))}
    assert {r.node: r.betweenness for r in got} == pytest.approx(want, abs=1e-12)


def test_error_holds_and_sampling_stops_early(spark):
    hub = [(i, 0) for i in range(1, 400)] + [(0, i) for i in range(1, 400)]  # all paths go through node 0
    got = graph.betweenness_within(table(spark, hub), tolerance=0.3, first=32).collect()
    want = brute(hub)
    assert len(got) == 400 and {r.n_pivots for r in got} == {64} and max(r.error for r in got) <= 0.3
    assert all(abs(r.betweenness - want[r.node]) <= r.error for r in got) and want[0] == pytest.approx(1)


def test_small_graphs(spark):
    assert graph.betweenness_within(table(spark, []), 0.1).count() == 0
    assert [(r.betweenness, r.error) for r in graph.betweenness_within(table(spark, [(1, 2)]), 0.1).collect()] == [(0.0, 0.0)] * 2
    assert {r.node: r.betweenness for r in graph.betweenness_within(table(spark, [(1, 1), (2, 2), (3, 3)]), 0.1).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


def test_blocks_of_nodes_and_pivots(spark):
    """Nodes and pivots in several blocks, and a search of more levels than are added up at once."""
    rng = random.Random(5)
    edges = [(rng.randrange(60) * 7, rng.randrange(60) * 7) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(12)] + [(7, 1000)]
    step = table(spark, edges).where("src <> dst").distinct()
    places = paths.numbered(graph.vertex_set(step))
    got = paths.path_loads(step, places, places.select("node"), side=16, lanes=8).collect()
    want, n = brute([e for e in edges if e[0] != e[1]]), places.count()
    assert {r.node for r in got} >= {v for v, x in want.items() if x}
    assert {r.node: r.s / ((n - 1) * (n - 2)) for r in got} == pytest.approx({r.node: want[r.node] for r in got}, abs=1e-12)


def test_stripes_and_batches_of_pivots(spark, monkeypatch):
    """Stripes of two blocks, a value sent once to each stripe, and two batches of pivots; the same sums as in one search."""
    monkeypatch.setattr(paths, "SPAN", 2)
    rng = random.Random(7)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(200)]
    step = table(spark, edges).where("src <> dst").distinct()
    places = paths.numbered(graph.vertex_set(step))
    tiles = paths.tiled(step, places, side=16)
    n = places.count()
    assert (tiles.span, tiles.stripes) == (2, -(-n // 32)) and tiles.forth.count() <= -(-n // 16) * tiles.stripes
    want = brute([e for e in edges if e[0] != e[1]])
    for cells in (10**9, n * 48):
        got = paths.path_loads(step, places, places.select("node"), lanes=8, tiles=tiles, cells=cells).collect()
        assert {r.node: r.s / ((n - 1) * (n - 2)) for r in got} == pytest.approx({r.node: want[r.node] for r in got}, abs=1e-12)
        assert {r.node for r in got} >= {v for v, x in want.items() if x}


def test_values_keep_their_numbers():
    import numpy as np

    for x in ([0.0, 1.0, 65535.0], [65536.0], [0.5, 2.0], [1e300], [-1.0], []):
        assert paths._unpacked(paths._packed(np.array(x))).tolist() == x
