"""Ranked search against a plain scoring of every document, with small trees, ties, repeats and nulls."""

import math
import random
import re

import pytest

from corvane.llm import ranked_search

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERMS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_docs, n_terms = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, t in own:
            m = 25 + 75 * len(t) * n_docs // n_terms
            s = 0
            for x in wanted:
                if tf := t.count(x):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", ranked_search.F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("rank", ranked_search.F.lit("x"))


@pytest.mark.parametrize("seed,leaf,shard", [(0, 2, 200), (1, 4, 1 << 21), (2, 1, 50), (3, 64, 500)])
def test_random_corpora(spark, monkeypatch, seed, leaf, shard):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "ñandú", "X1"]
    common = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, common, k=rng.randint(0, n)))
    docs = [(rng.choice([i, i, 5, None]), text(rng.choice([3, 20, 80]))) for i in range(300)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(150)] + [(2000, None), (2001, " . ")]
    items = [(rng.choice([i, 3, None]), text(15)) for i in range(25)] + [(50, None), (51, "nothing here"), (52, docs[10][1])]
    d, i = frames(spark, docs, items)
    found = ranked_search.search(d.repartition(3), i).collect()
    assert sorted(map(tuple, found), key=repr) == brute(docs, items)
    # the same with small trees, inside one process
    monkeypatch.setattr(ranked_search, "LEAF", leaf)
    block = ranked_search._block(ranked_search.item_terms(i, "item_id", "text").toArrow())
    vectors = ranked_search.restricted_vectors(d, block, "doc_id", "text").toArrow()
    n_terms = sum(vectors["n"].to_pylist())
    corpus = ranked_search.weights(vectors.num_rows, n_terms, ranked_search.document_counts(spark.createDataFrame(vectors), len(block.vocabulary)))
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", shard)
    held = type("Held", (), {})
    a, b = held(), held()
    a.value, b.value = block, corpus
    rows = [r for batch in ranked_search._searcher(a, b, 10)(iter(vectors.to_batches(max_chunksize=40))) for r in batch.to_pylist()]
    for item in set(block.ids):
        best = sorted(((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in rows if r["item_id"] == item))[:10]
        assert [(-s, None if null else doc) for s, null, doc in best] == [(x[3], x[2]) for x in sorted(brute(docs, items), key=lambda x: x[1]) if x[0] == item]


def test_blocks_of_items(spark, monkeypatch):
    docs = [(i, f"a b{i} c{i % 3}") for i in range(40)]
    items = [(i, f"b{i} c{i % 3} a a") for i in range(30)]
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 20)
    found = ranked_search.search(*frames(spark, docs, items), k=4).collect()
    assert sorted(map(tuple, found), key=repr) == brute(docs, items, 4)


def test_equal_scores_go_by_id_and_nothing_gives_nothing(spark):
    docs = [(i, "same words") for i in range(200, 0, -1)] + [(None, "same words")] + [(i, "other text") for i in range(300, 320)]
    found = ranked_search.search(*frames(spark, docs, [(1, "Same")])).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 11))
    assert ranked_search.search(*frames(spark, [], [(1, "a")])).collect() == []
    assert ranked_search.search(*frames(spark, docs, [])).collect() == []


def test_bounds_hold_for_every_node(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 12)))) for i in range(500)]
    d, i = frames(spark, docs, [(0, "a b c"), (1, "h h g")])
    block = ranked_search._block(ranked_search.item_terms(i, "item_id", "text").toArrow())
    vectors = ranked_search.restricted_vectors(d, block, "doc_id", "text").toArrow().combine_chunks().to_batches()[0]
    corpus = ranked_search.weights(500, sum(vectors["n"].to_pylist()), ranked_search.document_counts(spark.createDataFrame(ranked_search.pa.Table.from_batches([vectors])), len(block.vocabulary)))
    (t, ends), (f, _) = ranked_search._numbers(vectors["terms"]), ranked_search._numbers(vectors["tfs"])
    m = ranked_search.length_part(vectors["n"].to_numpy(), corpus)
    tree = ranked_search.Tree(vectors["doc_id"].to_numpy(), vectors["doc_id"].is_null().to_numpy(zero_copy_only=False), m, t, f, ends, corpus)
    best = ranked_search.Best(block, 10)
    everyone = ranked_search.np.arange(2)
    covered = []
    for first, last, children in tree.nodes:
        top, least = tree.largest(first, last)
        bound = best.sums(corpus.weight * ranked_search.gain(top, ranked_search.np.int64(least)), everyone)
        dense = ranked_search.np.zeros((last - first, tree.size), ranked_search.np.int64)
        for row in range(first, last):
            a, b = tree.ends[row], tree.ends[row + 1]
            dense[row - first, tree.terms[a:b]] = tree.scored[a:b]
        assert (best.sums(dense, everyone).max(axis=0) <= bound).all()
        covered += [] if children else range(first, last)
    assert sorted(covered) == list(range(500)) and len(tree.nodes) > 3
