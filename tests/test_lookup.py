"""Lists of (query_id, doc_id) where few keys have many rows each: whole, and dealt out evenly."""

from pyspark.sql import functions as F

from corvane.operators import search


def sides(spark):
    """200 queries and 4,000 names with two keys between them, a null key, an empty one and one that nobody asks for."""
    key = F.when(F.col("id") % 4 == 0, "red bolt").otherwise("red rod")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "blue")], "id long, key string")
    held = spark.range(4000).select("id", key.alias("key")).union(more)
    return held.where("id < 200").withColumnRenamed("id", "query_id").where("key is null or key <> 'blue'"), held.withColumnRenamed("id", "doc_id")


def largest_part(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_prefixes_of_few_keys(spark, monkeypatch):
    monkeypatch.setattr(search, "LOAD", 10_000)
    asked, names = sides(spark)
    got = search.lookup_prefix(asked.withColumn("key", F.substring("key", 1, 5)), names)
    assert largest_part(got) <= 100_000
    n_rod = 150 * 3000  # "red r"; the fifty others are "red b"
    assert got.count() == got.distinct().count() == n_rod + 50 * 1000
    assert got.where("query_id % 4 = 0 and doc_id % 4 <> 0 or query_id % 4 <> 0 and doc_id % 4 = 0").isEmpty()


def test_similar_names_of_few_keys(spark, monkeypatch):
    monkeypatch.setattr(search, "LOAD", 10_000)
    asked, names = sides(spark)
    got = search.trigram_match(asked, names, 0.5)
    assert largest_part(got) <= 100_000
    # null is the empty key here: two of each side meet
    assert got.count() == got.distinct().count() == 150 * 3000 + 50 * 1000 + 2 * 2
    assert got.where("similarity <> 1").isEmpty()


def test_equal_names_of_few_keys(spark, monkeypatch):
    monkeypatch.setattr(search, "LOAD", 10_000)
    asked, names = sides(spark)
    got = search.lookup_exact(asked.unionByName(asked.where("query_id = 7")), names)  # a repeated row counts twice
    assert largest_part(got) <= 100_000
    assert got.count() == 150 * 3000 + 50 * 1000 + 3000 + 1  # the empty key is its own
    assert got.where("doc_id in (-1, -3)").isEmpty()
