"""Vector search: blocks and bounds against plain numbers, plans without a product of tables, recall of the stored cells."""

import numpy as np
import pytest

from corvane.operators import search, vectors
from corvane.plans import catalog

SF = "/root/testdata/sf0.1"


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>, part int")


def brute(asked, items, k, scoped=False):
    out = []
    for q, x, s in asked:
        if x is None or s is None and scoped or not any(x):
            continue
        own = []
        for i, y, p in items:
            if y is None or any(v is None for v in y) or not any(y) or i is None or i == q or scoped and p != s:
                continue
            a, b = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
            own.append((-round(float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), 6), i))
        out += [(q, i, -s_, rank) for rank, (s_, i) in enumerate(sorted(own)[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in df.select("query_id", "doc_id", "score", "rank").collect())


def same(got, want):
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert all(abs(g[2] - w[2]) <= 1.1e-6 for g, w in zip(got, want))


@pytest.mark.parametrize("scoped", [False, True])
def test_blocks_equal_plain_numbers(spark, monkeypatch, scoped):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (6, 8))
    items = [(int(i), [float(v) for v in np.round(centres[i % 6] + rng.normal(0, 0.2, 8), 3)], int(i % 3)) for i in range(400)]
    items += [(500, None, 1), (501, [0.0] * 8, 1), (502, [1.0] * 7 + [None], 0), (None, [1.0] * 8, 0), (503, [1.0] * 8, None)] + [(600 + i, items[5][1], 2) for i in range(150)]
    asked = [items[i] for i in range(0, 400, 9)] + [(900, [1.0] * 8, 0), (901, None, 0), (902, [0.0] * 8, 0), (903, [1.0] * 8, None)]
    for name, value in (("BLOCK", 32), ("ASKED", 10), ("SLICE", 2)):
        monkeypatch.setattr(vectors, name, value)
    got = rows(vectors.exact_top_k(frame(spark, asked, "query_id"), frame(spark, items, "doc_id"), 7, ("part",) if scoped else ()))
    same(got, brute(asked, items, 7, scoped))


def test_bounds_skip_far_blocks(monkeypatch):
    """A block whose ball is too far for all queries is not multiplied."""
    rng = np.random.default_rng(2)
    near, far = np.eye(4)[[0] * 50] + rng.normal(0, 0.01, (50, 4)), -np.eye(4)[[0] * 50] + rng.normal(0, 0.01, (50, 4))
    unit = lambda x: x / np.sqrt((x**2).sum(axis=1, keepdims=True))

    def block(ids, own):
        own = unit(own)
        centre = own.mean(axis=0)
        return {"block": 0, "slice": 0, "scope": "", "query_ids": np.array([-1]).tobytes(), "queries": unit(near[:1]).tobytes(), "ids": np.array(ids).tobytes(), "units": own.tobytes(), "centre": centre.tobytes(), "radius": float(np.sqrt(((own - centre) ** 2).sum(axis=1)).max())}

    seen = []
    real = np.round
    monkeypatch.setattr(vectors.np, "round", lambda x, n: seen.append(x.shape) or real(x, n))
    batch = vectors.pa.RecordBatch.from_pylist([block(range(50), near), block(range(50, 100), far)])
    out = list(vectors._searcher(5)(iter([batch])))
    assert len(seen) == 1 and out[0].num_rows == 5 and max(out[0].column(1).to_pylist()) < 50


def test_no_product_of_tables_in_any_plan(spark, monkeypatch):
    plans = []
    real = vectors.written
    monkeypatch.setattr(vectors, "written", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a))
    for name in ("vector_topk", "vector_scoped"):
        plans.append(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not any("Cartesian" in p or "NestedLoop" in p for p in plans)


def test_nothing(spark):
    none = frame(spark, [], "doc_id")
    some = frame(spark, [(1, [1.0, 2.0], 0)], "query_id")
    assert search.vector_top_k(some, none).isEmpty()
    assert search.vector_top_k(some.limit(0), frame(spark, [(1, [1.0, 2.0], 0)], "doc_id")).isEmpty()


def test_recall_and_files_of_the_stored_cells(spark, tmp_path):
    """Over every hundredth vector; a query opens the folders of its cells only."""
    items = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id as doc_id", "embedding")
    asked = items.where("doc_id % 100 = 0").selectExpr("doc_id as query_id", "embedding")
    path = f"file://{tmp_path}/cells"
    vectors.build_index(path, items)
    exact = {(r.query_id, r.doc_id) for r in vectors.exact_top_k(asked, items).collect()}
    near = {(r.query_id, r.doc_id) for r in vectors.search_index(spark, path, asked).collect()}
    assert len(exact) == 10 * asked.count() and len(exact & near) / len(exact) >= 0.9
    assert spark.read.parquet(f"{path}/cells").count() == 2 * items.count()
    _, opened = vectors.probe(spark, path, asked.limit(1), 0.1)
    every = spark.read.parquet(f"{path}/cells")
    files = lambda df: df.select(vectors.F.input_file_name()).distinct().count()
    print("recall", len(exact & near) / len(exact), "files", files(opened), files(every), "cells", spark.read.parquet(f"{path}/centres").count())
    assert files(opened) < files(every) / 2
    assert "PartitionFilters: [cell" in opened._jdf.queryExecution().executedPlan().toString()


def test_scoped_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    items = [(int(i), [float(v) for v in rng.normal(0, 1, 6)], int(i % 4)) for i in range(300)]
    asked = items[::20]
    path = f"file://{tmp_path}/cells"
    vectors.build_index(path, frame(spark, items, "doc_id"), ("part",))
    same(rows(vectors.search_index(spark, path, frame(spark, asked, "query_id"), 5, 1.0, ("part",))), brute(asked, items, 5, True))


def test_a_search_of_cells_keeps_the_best_of_a_block_only(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    items = [(int(i), [float(v) for v in rng.normal(0, 1, 6)], 0) for i in range(400)]
    path, met, real = f"file://{tmp_path}/cells", [], vectors._met
    monkeypatch.setattr(vectors, "_met", lambda *a: met.append(real(*a)) or met[-1])
    vectors.build_index(path, frame(spark, items, "doc_id").drop("part"))
    found = vectors.search_index(spark, path, frame(spark, items[::40], "query_id").drop("part"), 5, 1.0)
    assert found.count() == 5 * 10
    assert met[0].count() <= 5 * 10 * spark.read.parquet(f"{path}/centres").count()  # not a row for each pair that meets


def test_bucket_search_equals_joining_on_buckets(spark):
    """Few buckets, ties, copies, several blocks and queries with fewer than k candidates: the rows of a join on the buckets."""
    rng = np.random.default_rng(11)
    units = np.round(rng.normal(size=(120, 3)))
    units[::7] = units[0]
    units /= np.maximum(np.sqrt((units**2).sum(axis=1, keepdims=True)), 1e-9)
    held = [(i, units[i].tolist(), [float(rng.integers(0, 9)), float(rng.integers(0, 40))]) for i in range(120)]
    items = spark.createDataFrame(held, "doc_id long, unit array<double>, buckets array<double>")
    asked = items.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "query_id")
    want = []
    for q in held[::4]:
        near = sorted((-round(float(np.dot(q[1], d[1])), 6), d[0]) for d in held if d[0] != q[0] and any(x == y for x, y in zip(q[2], d[2])))
        want += [(q[0], d, -s) for s, d in near[:10]]
    block, vectors.BLOCK = vectors.BLOCK, 32
    try:
        got = search.top(vectors.bucket_top_k(asked, items, 2), 10).collect()
    finally:
        vectors.BLOCK = block
    assert sorted((r.query_id, r.doc_id, r.score) for r in got) == [(q, d, pytest.approx(s, abs=1e-9)) for q, d, s in sorted(want)]
