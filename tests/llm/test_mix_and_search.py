"""Mixing, exact copies and vector search beyond their SQL."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import exact_dedup, mixing, topk


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = mixing.mix(docs)
    by = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("n"), F.max("size").alias("largest")).collect()
    assert sum(r.target for r in by) == pytest.approx(1.5 * sum(r.n for r in by))
    assert all(abs(r.taken - r.target) <= r.largest / 2 + 1 and r.target <= 2 * r.n for r in by)
    assert out.where("taken > 2 * size").count() == 0
    key = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    assert key(out) == key(mixing.mix(docs.repartition(7)))
    assert mixing.repeated(docs).count() == out.agg(F.sum("copies")).first()[0]


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 1000), ("e", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights a 5, b 2, c 1, e 5, null 2; a and e stop at their caps, the others share what is left
    left = 1.5 * 3010 - 20
    assert got == {"a": 20.0, "e": 0.0, "b": pytest.approx(min(2000, left * 2 / 5)), "c": pytest.approx(left / 5), None: pytest.approx(left * 2 / 5)}


def test_every_document_is_taken_at_its_own_rate(spark):
    """Over many draws each document is taken as often as its expected copies say, which differ within a source.

    Two hundred sources of the same documents under other ids are as many independent draws.
    """
    docs = spark.createDataFrame([(1000 * s + i, "w " * (4 + 9 * (i % 4)), f"s{s:03d}") for s in range(200) for i in range(40)], "doc_id long, text string, source string")
    for share in (0.7, 1.3):
        rows = mixing.mix(docs, share=share, weights=(1,)).groupBy((F.col("doc_id") % 1000).alias("doc")).agg(F.avg("copies").alias("rate"), F.avg("expected").alias("expected"), F.min("copies").alias("low"), F.max("copies").alias("high")).collect()
        assert len({round(r.expected, 3) for r in rows}) == 4
        for r in rows:  # the rate's deviation is 0.035 at most
            assert r.rate == pytest.approx(r.expected, abs=0.12) and r.low >= int(r.expected) and r.high <= int(r.expected) + 1


def test_expected_copies_sum_to_the_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("expected") * F.col("size")).alias("words"), F.max("target").alias("target"), F.min("expected").alias("low"), F.max("expected").alias("high")).collect()
    assert all(r.words == pytest.approx(r.target) and 0 <= r.low <= r.high <= 2 for r in rows)
    assert any(r.high - r.low > 0.1 for r in rows)


def test_repeated_rows_are_decided_each_for_itself(spark):
    docs = spark.createDataFrame([(None, "a b c", "s", n) for n in range(40)] + [(7, "d e", "s", n) for n in range(40)] + [(7, "d e", None, 0)], "doc_id long, text string, source string, size long")
    out = mixing.repeated(docs, share=0.9)
    assert out.columns == docs.columns
    words = out.where("source is not null").agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    target = mixing.mix(docs, share=0.9).where("source is not null").agg(F.max("target")).first()[0]
    assert abs(words - target) <= 1.5


def test_large_group_spans_partitions(spark):
    n = 9000
    docs = spark.createDataFrame([(i, "same  text" if i % 3 else f"text {i // 2}" + " " * (i % 2)) for i in range(n)], "doc_id long, text string")
    rows = exact_dedup.exact_duplicates(docs, partitions=16).collect()
    assert len(rows) == n
    same = [r for r in rows if r.doc_id % 3]
    assert {(r.keep_id, r.group_size) for r in same} == {(1, len(same))} and sum(r.kept for r in same) == 1


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_groups_across_splitters(spark, partitions):
    """Long texts with one beginning, copies in all sizes and white space, repeated rows and null ids, over many partitions."""
    rng = random.Random(partitions)
    rows = [(rng.choice([i, i, i // 3, None]), "the same long beginning of every text " * 2 + f"{rng.randrange(40)}" + " " * rng.randrange(3)) for i in range(700)] + [(i, None if i % 2 else " ") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = exact_dedup.exact_duplicates(docs, partitions=partitions).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    want = {hashlib.sha256(k.encode()).hexdigest(): (len(g), None if min(g)[1] else min(g)[2]) for k, g in groups.items()}
    assert len(got) == len(rows) and all((r.group_size, r.keep_id) == want[r.text_sha256] for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(want) and all(r.doc_id == r.keep_id for r in kept)
    often = Counter((r.doc_id, r.text_key) for r in got)
    assert all(r.twin or often[r.doc_id, r.text_key] == 1 for r in got)


def test_the_same_one_of_equal_rows_stays(spark):
    rows = [(1, "a b", k, [k]) for k in range(9)] + [(None, "q", k, None) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, rank array<int>")
    stay = lambda df: sorted(str(tuple(r)) for r in exact_dedup.without_exact_duplicates(df).collect())
    assert len(stay(docs)) == 2 and stay(docs) == stay(docs.repartition(7)) == stay(docs.orderBy(F.desc("kept")))


def test_identical_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 2), (1, "ab", 3), (None, "q", 4), (None, "q", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, kept int")
    stay = exact_dedup.without_exact_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in stay if r.text) == [("1", "a b"), ("None", "q")] and [r.kept for r in stay if not r.text] == [6]


def brute(vectors, queries, k):
    out = set()
    for q, a in queries:
        scored = sorted((-int(sum(x * y for x, y in zip(a, b))), i) for i, b in vectors if i != q and len(b) == len(a))
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("n, dimension, spread", [(3000, 8, 1), (500, 3, 0.002), (40, 2, 1e5)])
def test_top_k_equals_brute_force(spark, n, dimension, spread, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 700)
    monkeypatch.setattr(topk, "SLICE", 2)
    rng = np.random.default_rng(n)
    data = rng.normal(0, spread, (n, dimension)).astype(np.float32)
    data[: n // 4] = data[0]  # a third of the corpus may be one vector
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows + [(n, [1.0])], "vec_id long, embedding array<float>")
    whole = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows]
    got = {tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0 and vec_id < " + str(n)), 10).collect()}
    assert got == brute(whole, [w for w in whole if w[0] % 100 == 0], 10)


def test_top_k_of_queries_from_elsewhere(spark):
    """Queries that are not rows of the corpus, or share an id with another vector, set no bound."""
    rng = np.random.default_rng(5)
    corpus = [(i, [int(x) for x in v]) for i, v in enumerate(rng.integers(-9, 9, (300, 4)))]
    asked = [(i, [int(x) for x in v]) for i, v in zip([*range(900, 930), 3, 4], rng.integers(50, 99, (32, 4)), strict=True)] + [corpus[7]]
    frame = lambda rows: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(frame(corpus), frame(asked), 10, scale=1).collect()]
    assert len(got) == 330 and set(got) == brute(corpus, asked, 10)


def test_top_k_beyond_double_precision(spark):
    rows = [(0, [1e12, 3.0]), (1, [1e12, 2.0]), (2, [1e12, 1.0]), (3, [-1e12, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0"), 10).orderBy("rank").collect()]
    assert [g[2] for g in got] == [1, 2, 3] and got[0][3] == 2**63 - 1


def test_ball_tree_prunes():
    rng = random.Random(1)
    centres = np.array([[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]) * 1000
    vectors = np.rint(np.concatenate([c + np.random.default_rng(2).normal(0, 5, (400, 8)) for c in centres]))
    seen = []
    best = topk.Best(np.array([-1]), vectors[:1], 5)
    exact = best.exact
    best.exact = lambda v, active: seen.append(len(v)) or exact(v, active)
    best.search(topk.build(np.arange(len(vectors)), vectors))
    assert sum(seen) < len(vectors) / 2


def test_many_blocks_and_slices(spark, monkeypatch):
    """Blocks, shards and slices of a few rows give what one of each gives, and the plan doesn't grow with the queries."""
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (900, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 3 = 0"), 4).collect()))
    for name, value in (("BLOCK", 37), ("SHARD", 50), ("SLICE", 2), ("LEAF", 8), ("SEEDS", 3)):
        monkeypatch.setattr(topk, name, value)
    got = topk.top_k(df, df.where("vec_id % 3 = 0"), 4)
    assert sorted(map(tuple, got.collect())) == want
    size = lambda frame: len(frame._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(got) - size(topk.top_k(df, df.where("vec_id = 0"), 4))) < 200
