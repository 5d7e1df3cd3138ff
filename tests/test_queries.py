"""Every registered query of the base against its DuckDB counterpart, on the smallest tables."""

import math
import os

import duckdb
import pytest

from corvane.plans import catalog
from corvane.sources.fixtures import BASE, Tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, found.fetchall())


def test_all_queries_have_a_name_and_most_an_oracle():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"betweenness", "betweenness_bounded", "lsh_topk", "cells_topk", "modular_communities"}


def test_gold_is_searched_once_a_query(spark):
    t = Tables(spark, SF)
    assert t("v_gold") is t("v_gold") and t("v_gold").columns == ["query_id", "doc_id"]
