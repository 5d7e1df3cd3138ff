"""Registered queries against their DuckDB counterparts, on the smallest tables and on tables of hard rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.llm import queries
from tests_support import HARD, plain_rows

TABLES = ("documents", "conversations", "embeddings", "labels", "benchmark")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """A folder of tables with nulls, empty texts, ties, repeated rows and extra columns whose names clash with ours."""
    folder = tmp_path_factory.mktemp("hard")
    spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long, size long, node long, rank int, kept boolean, norm string").coalesce(2).write.parquet(str(folder / "documents.parquet"))
    turns = [(1, 0, "user", "a\\b</s>"), (1, 1, "assistant", "<|im_end|>\\0\\2"), (1, 1, "assistant", "<|im_end|>\\0\\2"), (2, 0, None, None), (3, None, "assistant", ""), (None, 0, "assistant", "x"), (4, 5, "user\n", "q"), (4, 2, "assistant", "[INST]<<SYS>>é😀\n"), (5, 0, "assistant", "<z"), (5, 0, "assistant", "<|a"), (5, 0, "assistant", "\\"), (5, 0, "assistant", "]"), (5, 0, "<|", "x"), (5, 0, "<z", "y"), (5, 0, "\n", "b")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).write.parquet(str(folder / "conversations.parquet"))
    nan = float("nan")
    vectors = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (200, [nan, 1.0]), (300, None), (1, [1.0, 2.0]), (2, [-1.0, 0.5]), (3, [float("inf"), 0.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (-100, [0.3, -0.7]), (1, [1.0, 2.0]), (2, [9.0, 9.0]), (2, [0.0, 1.0]), (100, [5.0, -2.0]), (None, [1.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).write.parquet(str(folder / "embeddings.parquet"))
    items = [(1, "the same words"), (1, "MIT License a"), (2, None), (None, "é ß 12 A"), (3, ""), (4, "zzz"), (5, "word word x")]
    spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).write.parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def against_sql(spark, name, folder, glob=""):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet{glob}'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert plain_rows(got.columns, got.collect()) == plain_rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_on_driver_tables(spark, name):
    against_sql(spark, name, SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_on_hard_rows(spark, hard, name):
    against_sql(spark, name, hard, "/*.parquet")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_on_empty_tables(spark, empty, name):
    rows = queries.QUERIES[name](spark, empty).collect()
    assert len(rows) == (1 if name == "op9_chat_format" else 0)  # conversation -1 is always there


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op2_language_id", "op5_token_counts", "op6_bpe_round_trip", "op8_quality", "op12_periodic_runs", "op13_token_file"])
def test_one_row_for_each_hard_row(spark, hard, name):
    rows = queries.QUERIES[name](spark, hard).collect()
    assert len(rows) == len(HARD)


def test_top_k_on_hard_rows(spark, hard):
    """Rows that repeat an id are candidates each for itself, and a repeated query id asks with each of its vectors."""
    vectors = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in spark.read.parquet(f"{hard}/embeddings.parquet").collect() if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = []
    for query in {i for i, _ in vectors if i % 100 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i) for j, q in vectors if j == query for i, v in vectors if i != query and len(v) == len(q))
        want += [(query, rank, i, -s) for rank, (s, i) in enumerate(scored[:10], 1)]
    assert sorted(map(tuple, queries.QUERIES["op10_exact_top_k"](spark, hard).collect())) == sorted(want)


def test_chat_on_hard_rows(spark, hard):
    rows = {r.conv_id: r for r in queries.QUERIES["op9_chat_format"](spark, hard).collect()}
    assert rows[1].n_turns == 3 and rows[1].loss_chars == 2 * len("<|im_end|>\\0\\2")
    assert rows[3].loss_chars == 0 and rows[None].loss_chars == 1 and rows[-1].loss_chars == len("</s>[INST] ok [/INST]")
