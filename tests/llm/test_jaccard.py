import random
import re
from collections import Counter

import numpy as np
import pytest

from corvane.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def brute(rows, n, percent):
    """doc_id to (set size, component) by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    having = {}
    for a, own in enumerate(sets):
        for b, both in Counter(b for s in own for b in having.get(s, ())).items():
            if 100 * both >= percent * (len(own) + len(sets[b]) - both):
                parent[root(a)] = root(b)
        for s in own:
            having.setdefault(s, []).append(a)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[root(a)] = min(least.get(root(a), i), i)
    return {i: (len(sets[a]), least[root(a)]) for a, (i, _) in enumerate(rows)}


def corpus(seed):
    """Groups of near copies of all sizes and lengths, some around one common passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = [None, "", " \n", "one", "ONE", "é é é é é é", "w1 w2 w3"]
    for _ in range(80):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 7, 9, 12, 20, 40, 80, 150]))]
        base = passage + base if rng.random() < 0.4 else base
        for _ in range(rng.choice([1, 1, 2, 3, 10, 60])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at, kind = rng.randrange(len(own)), rng.random()
                if kind < 0.4:
                    own[at] = rng.choice(words)
                elif kind < 0.7:
                    own.insert(at, rng.choice(words))
                elif len(own) > 1:
                    own.pop(at)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (1, 60)])
def test_components_equal_brute_force(spark, words, percent):
    rows = corpus(words)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(spark.createDataFrame(rows, SCHEMA), words, percent).collect()}
    assert found == brute(rows, words, percent)


def test_one_of_each_component_stays(spark):
    rows = corpus(9)
    docs = spark.createDataFrame([(i, t, i) for i, t in rows] + [(None, "q r s t u v w", -1), (None, "q r s t u v w", -2), (7777, "Q r s t u v w", -3)], SCHEMA + ", kept int")
    stay = [(r.doc_id, r.kept) for r in jaccard.without_near_duplicates(docs).collect()]
    want = brute(rows, 5, 80)
    assert {i for i, k in stay if k >= 0} == {i for i, (n, c) in want.items() if n == 0 or c == i}
    assert [x for x in stay if x[1] < 0] == [(7777, -3)]


def test_later_links_join_components(spark):
    parts = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (30, 30), (31, 30)], "node long, component long")
    links = spark.createDataFrame([(2, 6), (6, 2), (6, 10), (9, 8), (31, 30)], "a long, b long")
    found = [(r.node, r.component) for r in jaccard._merged(parts, links).collect()]
    assert sorted(found) == [(1, 1), (2, 1), (5, 1), (6, 1), (8, 8), (9, 8), (10, 1), (30, 30), (31, 30)]


def test_heavy_lists_need_no_memory(spark):
    """A list longer than one batch, with the lists before and after it, goes through the streaming pass."""
    import pyarrow as pa

    key = np.repeat(np.arange(5), [1, 3, 200, 2, 1])
    node = np.arange(len(key))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 7]), pa.array(node[i : i + 7]), pa.array(np.ones(len(key[i : i + 7]), np.int8))], names=["key", "node", "credit"]) for i in range(0, len(key), 7)]
    rows = [tuple(r.values()) for b in jaccard._stars(iter(batches)) for r in b.to_pylist()]
    want = [(1, n, 1, 0) for n in (2, 3)] + [(4, n, 0, 1) for n in range(4, 204)] + [(204, 205, 1, 0)]
    assert sorted(rows) == sorted(want)


def test_every_band_reaches_its_partners():
    b = jaccard.bands(85)
    sizes = np.arange(1, 20000)
    assert (b.of(100 * sizes // 85) - b.of(sizes) <= 1).all()
    assert (b.segments + b.double - b.spare >= b.most_different(b.high))[:60].all()


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 800).astype(np.uint64)
    for cut in (1, 20, 90):
        other = np.concatenate([base[cut:], rng.integers(0, 2**63, cut).astype(np.uint64)])
        values, starts = np.concatenate([np.sort(base), np.sort(other)]), np.array([0, 800, 1600])
        coarse = jaccard.sketches(values, starts).view(np.uint64)
        fine = [np.array(x, np.int64).view(np.uint64) for x in jaccard.fine_sketches(values, starts, np.array([130, 130])).to_pylist()]
        assert int(np.bitwise_count(coarse[0] ^ coarse[1]).sum()) <= 2 * cut and int(np.bitwise_count(fine[0] ^ fine[1]).sum()) <= 2 * cut


def test_different_sets_with_one_fingerprint_stay_apart(spark, monkeypatch):
    """With first numbers of three bits nearly all sets share theirs; the second ones tell them apart, and links are the same."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 60))) for _ in range(60)]
    rows = list(enumerate(texts + texts[:20] + [t + " z" for t in texts[:40]] + [None, ""]))
    real = jaccard.fingerprints
    weak = lambda values, starts, salt=None: real(values, starts, salt) if salt else np.where(np.diff(starts) > 0, real(values, starts) & np.uint64(7) | np.uint64(8), np.uint64(0))
    monkeypatch.setattr(jaccard, "fingerprints", weak)
    values, starts = jaccard.shingles([t.encode() for t in texts], 4)
    assert len(np.unique(jaccard.named(values, starts, np.unique(weak(values, starts))))) == len({tuple(values[a:b]) for a, b in zip(starts, starts[1:])}) > 40
    docs = spark.createDataFrame(rows, SCHEMA)
    assert len(jaccard.Join(docs, 4, 85, "doc_id", "text").shared) == 8
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, 4, 85).collect()}
    assert got == brute(rows, 4, 85)
