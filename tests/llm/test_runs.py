"""Periodic runs against a search over all periods, on random, periodic and hard texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(words):
    """Each period in turn: maximal stretches of equal words that far apart; of equal stretches the smallest period."""
    best = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(12, 2 * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, b - a, p) for (a, b), p in best.items()), key=lambda r: (r[0], r[2]))


def check(texts):
    for words, got in zip(texts, runs.find_runs([np.array(t, np.int64) for t in texts])):
        assert [tuple(r) for r in got.tolist()] == brute(words), words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=6))
def test_small_alphabets(texts):
    check(texts)


@pytest.mark.parametrize("seed", range(20))
def test_repeated_parts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(15):
        words = []
        while len(words) < rng.randint(0, 250):
            words += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, rng.choice([3, 9, 40])))] * rng.randint(1, 7)
            if rng.random() < 0.3:
                words += words[-rng.randint(1, 60) :]
        texts.append(words)
    check(texts)


def test_families():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    junction = [1] + [0, 1] * 20 + [0] + [0, 1] * 20 + [0, 1]
    check([fib[-1], junction, [0] * 500, [], [0], list(range(300)), [*range(40), *range(40)], [0, 1, 2, 3, 4, 5] * 2, [7] + [0, 1, 2, 3, 4, 5] * 2 + [8], [9, 9, 9] + [0, 1, 2, 3, 4, 5] * 2 + [8]])


def expected(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *head, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_on_driver_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [d for d in docs if len((d[1] or "").split()) < 1500]  # the brute-force version is quadratic
    want = {d[0]: expected(*d) for d in docs}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(docs) > 100 and sum(r[1] > 0 for r in want.values()) > 10
    assert {i: got[i] for i in want} == want


def test_hard_rows(spark):
    rows = [(None, "a " * 30), (None, None), (1, None), (1, ""), (2, " \t\n"), (3, "x\x0by " * 12), (3, "x\x0by " * 12), (4, "é ü " * 9), (5, "a\x85b a\xa0b " * 8), (-7, "w " * 12), (8, "w " * 11), (10**18, "u v w " * 2000)]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", runs.F.lit(1)), plant=True).collect()
    key = lambda r: tuple(map(repr, r))
    short = [expected(*r) for r in rows[:-1]]
    assert sorted((tuple(r) for r in got if r.doc_id != 10**18), key=key) == sorted(short, key=key)
    assert next(r for r in got if r.doc_id == 10**18).n_runs >= 1


def test_groups_of_texts_dont_change_results(spark, monkeypatch):
    texts = [np.array([i % 3 for i in range(40)]), np.array([5] * 20), np.array([], np.int64), np.arange(30)]
    together = [x.tolist() for x in runs.find_runs(texts)]
    assert together == [runs.find_runs([t])[0].tolist() for t in texts]
