"""Rounds of ranks and labels shuffle packed neighbours: one row for a usual node, several for one with very many."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph
from corvane.session import written

RING = [(i, i + d) for i in range(40) for d in range(1, 30)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


@pytest.mark.parametrize("metric, array, key", [("communities", "nodes", "other"), ("pagerank", "dsts", "src")])
def test_a_round_has_one_row_for_a_usual_node(spark, monkeypatch, metric, array, key):
    seen = []

    def watched(df, instead_of=None):
        out = written(df, instead_of)
        if array in out.columns:
            seen.append((out.count(), out.select(key).distinct().count(), out.agg(F.sum(F.size(array))).first()[0]))
        return out

    monkeypatch.setattr(graph, "written", watched)
    getattr(graph, metric)(edges(spark, RING), 2).collect()
    ends = len(RING) * (2 if metric == "communities" else 1)
    assert len(seen) == 1 and seen[0][0] == seen[0][1] and seen[0][2] == ends


def test_many_neighbours_are_several_rows_and_each_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "PACK", 8)
    rows = graph.packed(edges(spark, [(1, i) for i in range(100)] + [(2, 5)]), "src", "dst").collect()
    assert sorted(d for r in rows if r.src == 1 for d in r.dsts) == list(range(100)) and {r.n for r in rows if r.src == 1} == {100}
    assert 1 < sum(r.src == 1 for r in rows) <= 13 and [(r.n, r.dsts) for r in rows if r.src == 2] == [(1, [5])]
