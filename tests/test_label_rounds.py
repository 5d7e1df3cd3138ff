"""Label propagation against plain counting, with ids that share a number with their votes and with ids that don't; imports sorted once."""

import random
from collections import Counter

import pytest

from corvane.operators import graph
from corvane.sources.fixtures import Tables


def plain(pairs, rounds):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label, settled = {n: n for n in near}, {}
    for _ in range(rounds):
        new = {}
        for n, others in near.items():
            votes = Counter([label[n], *(label[o] for o in others)])
            new[n] = min(votes, key=lambda x: (-votes[x], x))
        settled = {n: new[n] == label[n] for n in near}
        label = new
        if all(settled.values()):
            break
    return {(n, label[n], settled[n]) for n in near}


@pytest.mark.parametrize("at, sign", [(0, 1), ((1 << 62) + 5, 1), (0, -1)])
def test_labels_equal_plain_counting(spark, at, sign):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(130)] + [(0, n) for n in range(60, 160)] + [(7, 7), (200, 200)]
    pairs = [(at + sign * a, at + sign * b) for a, b in pairs]
    got = graph.communities(spark.createDataFrame(pairs + [(None, at), (at, None)], "src long, dst long"), 4)
    assert {tuple(r) for r in got.collect()} == plain(pairs, 4)


def test_imports_are_sorted_once_a_query(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = t("v_imports")
    assert t("v_imports") is rows and len(rows.inputFiles()) and "lineitem" not in " ".join(rows.inputFiles())
    assert Tables(spark, "/root/testdata/sf0.001")("v_imports").exceptAll(rows).isEmpty()
