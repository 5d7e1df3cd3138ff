"""Trigram search against comparing all pairs, and the candidates that the prefix filter leaves."""

import random

import pytest

from corvane.operators import search


def grams(text):
    text = (text or "").lower()
    return {text[i : i + 3] for i in range(max(len(text) - 2, 1))}


def names(spark, texts, column):
    return spark.createDataFrame(list(enumerate(texts)), f"{column} long, key string")


@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_equals_comparing_all_pairs(spark, least):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abC") for _ in range(rng.randrange(12))) for _ in range(120)] + [None, "", "ab", "AB", "aaaaaaaa", "x" * 3000] * 2
    asked = texts[::3] + ["nowhere"]
    got = {(r.query_id, r.doc_id): r.similarity for r in search.trigram_match(names(spark, asked, "query_id"), names(spark, texts, "doc_id"), least).collect()}
    want = {(i, j): round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 6) for i, a in enumerate(asked) for j, b in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v >= least}


def test_a_trigram_in_every_name_makes_no_candidates(spark):
    texts = ["the" + "".join(random.Random(n).choices("bcdfghjklmnpqrstvwxz", k=12)) for n in range(200)]
    keys = names(spark, texts, "id").select("key")
    counts = keys.selectExpr("explode(array_distinct(transform(sequence(1, length(key) - 2), i -> substr(key, i, 3)))) as gram").groupBy("gram").count().withColumnRenamed("count", "n")
    graded = search._graded(keys, counts)
    pairs = search.trigram_candidates(graded, graded, 0.5)
    assert pairs.count() < 2 * len(texts) and pairs.where("q = d").count() == len(texts)


def test_empty_tables_and_bounds(spark):
    some, none = names(spark, ["abc"], "query_id"), names(spark, [], "doc_id")
    assert search.trigram_match(some, none, 0.5).collect() == []
    with pytest.raises(ValueError):
        search.trigram_match(some, none, 0.0)
