"""Strongly connected groups and layers against plain searches, and on graphs whose depth is in the thousands."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph


def groups(pairs):
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)

    def reach(start):
        seen, todo = set(), [start]
        while todo:
            for y in ahead.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    far = {n: reach(n) for n in {x for p in pairs for x in p}}
    return {(n, min(g), len(g)) for n in far if n in far[n] for g in [[m for m in far[n] if n in far[m]]]}


def layers(pairs):
    of = {n: c for n, c, _ in groups(pairs)}
    needs = {}
    for a, b in pairs:
        if of.get(a, a) != of.get(b, b):
            needs.setdefault(of.get(a, a), set()).add(of.get(b, b))

    @lru_cache(None)
    def layer(x):
        return max((layer(y) + 1 for y in needs.get(x, ())), default=0)

    return {(n, layer(of.get(n, n))) for n in {x for p in pairs for x in p}}


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def both(spark, pairs):
    return {tuple(r) for r in graph.dependency_cycles(frame(spark, pairs)).collect()}, {tuple(r) for r in graph.learning_order(frame(spark, pairs)).collect()}


@pytest.mark.parametrize("seed", [3, 6])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([8, 15, 40])
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.9, 1.2, 2.0])))]
    for c in range(4):
        first, size = 100 + 10 * c, rng.randint(1, 5)
        pairs += [(first + i, first + (i + 1) % size) for i in range(size)] + [(first + size - 1, first + 10)] * rng.randint(0, 1) + [(rng.randrange(n), first)] * rng.randint(0, 1)
    assert both(spark, pairs) == (groups(pairs), layers(pairs))


def test_a_thousand_chained_cycles(spark):
    pairs = [(2 * i, 2 * i + 1) for i in range(1000)] + [(2 * i + 1, 2 * i) for i in range(1000)] + [(2 * i + 1, 2 * i + 2) for i in range(999)]
    found, order = graph.dependency_cycles(frame(spark, pairs)), graph.learning_order(frame(spark, pairs))
    assert {tuple(r) for r in found.collect()} == {(2 * i + j, 2 * i, 2) for i in range(1000) for j in (0, 1)}
    assert {tuple(r) for r in order.collect()} == {(2 * i + j, 999 - i) for i in range(1000) for j in (0, 1)}


def test_a_chain_of_a_hundred_thousand_nodes(spark):
    chain = spark.range(100_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.dependency_cycles(chain).isEmpty()
    order = graph.learning_order(chain)
    assert order.where("layer <> 100000 - node").isEmpty() and order.count() == 100_001


def test_loops_nulls_and_nothing(spark):
    assert both(spark, [(1, 1), (1, 2), (None, 3), (3, None), (2, 2), (2, 2)])[0] == {(1, 1, 1), (2, 2, 1)}
    assert graph.dependency_cycles(frame(spark, [])).isEmpty()
