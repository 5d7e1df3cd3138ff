"""Retrieval over a table of questions against a corpus (R1-R16), always as joins of the whole question set."""

from __future__ import annotations

import math

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as tx
from corvane.operators.vectors import bucket_top_k, exact_top_k, unit
from corvane.session import free, written

# Mode weights of each question intent.
BITMAP = 1024  # words of 64 bits: what a text is filtered with before its terms are joined
LOAD, MOST_TASKS = 2_000_000, 10_000  # rows of output of a task that lists pairs, and tasks at most
MODES = {"decision": (0.5, 0.3, 0.2), "contributor": (0.2, 0.2, 0.6), "dependency": (0.2, 0.2, 0.6), "historical": (0.5, 0.3, 0.2), "subsystem": (0.3, 0.4, 0.3), "architecture": (0.3, 0.5, 0.2), "symbol": (0.7, 0.2, 0.1), "file": (0.7, 0.2, 0.1), "overview": (0.3, 0.6, 0.1), "mixed": (0.4, 0.4, 0.2)}


def top(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The ``k`` best items of each query with their rank, ties to the smaller item."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def expand(pairs: DataFrame, queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, doc_id, ...) of each pair of keys (q, d, ...): all queries with the key q beside all names with the key d, repeats kept.

    There may be few keys and many rows of each, so rows are what is dealt out: a key's names go into as many blocks as make about ``LOAD`` rows
    of output each, the queries that it meets go to each of them, and there are as many tasks as there are loads, whatever the number of keys.
    """
    asked = queries.where("key is not null").select("query_id", F.col("key").alias("q")).join(pairs, "q").drop("q")
    sizes = asked.groupBy("d").agg(F.count(F.lit(1)).alias("n_q")).join(names.groupBy(F.col("key").alias("d")).agg(F.count(F.lit(1)).alias("n_d")), "d")
    sizes = written(sizes.select("d", (F.col("n_q") * F.col("n_d")).alias("n"), F.greatest(F.lit(1), F.least("n_d", F.ceil(F.col("n_q") * F.col("n_d") / LOAD))).cast("long").alias("blocks")))
    tasks = min(MOST_TASKS, math.ceil((sizes.agg(F.sum("n")).first()[0] or 0) / LOAD)) or 1  # a number
    dealt = names.select("doc_id", F.col("key").alias("d")).join(sizes.select("d", "blocks"), "d").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).drop("blocks")
    lots = asked.join(sizes.select("d", "blocks"), "d").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    return lots.repartition(tasks, "d", "block").join(dealt.repartition(tasks, "d", "block").hint("shuffle_hash"), ["d", "block"]).drop("d", "block")


def lookup_exact(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the query's key is the item's."""
    pairs = queries.where("key is not null").select(F.col("key").alias("q"), F.col("key").alias("d")).distinct()
    return expand(pairs, queries, names).select("query_id", "doc_id")


def lookup_prefix(queries: DataFrame, names: DataFrame, head: int = 3) -> DataFrame:
    """(query_id, doc_id) where the item's key starts with the query's.

    Distinct keys of both sides meet on the query's first ``head`` characters, or on all of a shorter one, so it stays an equi-join, and
    a key that many rows have is compared once. An empty query starts every key and is refused, like a null one.
    """
    asked = queries.where(F.length("key") > 0).select(F.col("key").alias("q")).distinct().select("q", F.substring("q", 1, head).alias("head"))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(head)), lambda i: F.col("d").substr(F.lit(1), i)))
    held = names.select(F.col("key").alias("d")).distinct().select("d", F.explode(heads).alias("head"))
    pairs = written(held.join(asked, "head").where(F.startswith("d", "q")).select("q", "d"))
    return expand(pairs, queries, names).select("query_id", "doc_id")


def containing(docs: DataFrame, items: DataFrame, run: int = 3) -> DataFrame:
    """(query_id, doc_id) where the document's text holds the item's (query_id, question) as a substring.

    Inside an item all words but the first and the last are whole words of a text that holds it, so both meet on a run
    of ``run`` such words, the longest one of the item, in an inverted join; the hits are then looked at. Items of too few words
    for that are compared with each text. Null and empty items are in no document.
    """
    words = lambda c: F.split(c, "[\\x09-\\x0D ]+")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - run + 1), lambda i: F.array_join(F.slice(w, i, run), " "))
    asked = items.where(F.length("question") > 0).select("query_id", F.col("question").alias("item"), words("question").alias("w"))
    able = F.size("w") >= run + 2
    inner = asked.where(able).withColumn("w", F.slice("w", F.lit(2), F.size("w") - 2))
    longest = F.array_max(F.transform(runs(F.col("w")), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    keyed = written(inner.select("query_id", "item", F.xxhash64(longest).alias("key")))
    split = docs.select("doc_id", words("text").alias("w")).where(F.size("w") >= run)
    keys = F.array_distinct(F.transform(runs(F.col("w")), lambda r: F.xxhash64(r)))
    near = written(split.select("doc_id", F.explode(keys).alias("key")).join(keyed.select("query_id", "key"), "key").select("doc_id", "query_id").distinct())
    texts = docs.select("doc_id", "text")
    hits = texts.join(near, "doc_id").join(keyed.select("query_id", "item"), "query_id").where(F.contains("text", "item"))
    few = texts.join(asked.where(~able).select("query_id", "item"), F.contains("text", "item"))
    return hits.select("query_id", "doc_id").unionByName(few.select("query_id", "doc_id"))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a question, rounded to 6 digits.

    ``queries`` has query_id and question, ``docs`` doc_id and text. Every text is split once: its length and the terms that a
    bitmap of the questions' terms lets through are written, and only those are joined and shuffled.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("question")))).alias("term"))
    wanted = written(asked.select("term").distinct())
    place = lambda term: F.pmod(F.xxhash64(term), F.lit(64 * BITMAP))
    marks = wanted.select(place("term").alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).collect()  # BITMAP rows at most
    bitmap = F.lit([dict(map(tuple, marks)).get(i, 0) for i in range(BITMAP)]).cast("array<long>")
    maybe = lambda term: F.getbit(F.element_at(bitmap, F.floor(place(term) / 64).cast("int") + 1), F.pmod(place(term), F.lit(64)).cast("int")) == 1
    split = docs.select("doc_id", tx.tokens(F.col("text")).alias("terms")).select("doc_id", F.size("terms").alias("length"), F.posexplode_outer("terms").alias("pos", "term"))
    first = F.coalesce("pos", F.lit(0)) == 0  # a row of each document stays for its length
    split = written(split.where(first | maybe("term")))
    stats = split.where(first).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))  # one row
    tf = split.join(wanted, "term", "left_semi").groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = written(tf)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    posting = tf.join(df, "term").crossJoin(F.broadcast(stats)).select("doc_id", "term", weight.alias("weight"))
    return asked.join(posting, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))


def _graded(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, grams): the trigrams of each key from rare to frequent by ``counts`` (gram, n), those that it lacks first."""
    each = keys.select("key", F.explode(tx.trigrams(F.col("key"))).alias("gram"))
    rated = each.join(counts, "gram", "left").select("key", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    return rated.groupBy("key").agg(F.array_sort(F.collect_list("g"))["gram"].alias("grams"))


def _heads(graded: DataFrame, least: float) -> DataFrame:
    """(key, size, gram, place): the rarest trigrams of each key, of which a key as similar as ``least`` must share one."""
    size = F.size("grams")
    head = size - F.ceil(size * least) + 1
    return graded.select("key", size.alias("size"), F.posexplode(F.slice("grams", F.lit(1), head.cast("int"))).alias("place", "gram"))


def trigram_candidates(asked: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(q, d): pairs of graded keys that can share enough, each once.

    Both keys' rarest trigrams must meet (prefix filter), their numbers must fit the threshold (length filter), and what follows
    the shared one in the shorter rest must suffice for the overlap (position filter). A trigram that all keys hold is among
    the rarest only of keys that have hardly another, so it makes no postings for the rest.
    """
    q = _heads(asked, least).select(F.col("key").alias("q"), "gram", F.col("size").alias("n_q"), F.col("place").alias("at_q"))
    d = _heads(items, least).select(F.col("key").alias("d"), "gram", F.col("size").alias("n_d"), F.col("place").alias("at_d"))
    met = q.join(d, "gram").where((F.col("n_d") >= F.col("n_q") * least) & (F.col("n_q") >= F.col("n_d") * least))
    # the first shared trigram of a pair: those before it in either key are not shared, as both keep one order
    first = met.groupBy("q", "d", "n_q", "n_d").agg(F.min("at_q").alias("at_q"), F.min("at_d").alias("at_d"))
    rest = F.least(F.col("n_q") - F.col("at_q"), F.col("n_d") - F.col("at_d"))
    return first.where(rest >= F.ceil((F.col("n_q") + F.col("n_d")) * (least / (1 + least)))).select("q", "d")


def trigram_match(queries: DataFrame, names: DataFrame, least: float = 0.3) -> DataFrame:
    """(query_id, doc_id, similarity) of shared over all trigrams, ``least`` or more after rounding to six places.

    Equal keys are compared once: distinct keys get candidates by their rarest trigrams, candidates are verified on all
    trigrams, and ids join the matching keys. A null key is empty, and the empty key is its own trigram. ``least`` is above 0.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    key = F.lower(F.coalesce(F.col("key"), F.lit(""))).alias("key")
    wanted, held = queries.select("query_id", key), names.select("doc_id", key)
    texts = written(held.select("key").distinct())
    counts = written(texts.select(F.explode(tx.trigrams(F.col("key"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    items, asked = written(_graded(texts, counts)), written(_graded(wanted.select("key").distinct(), counts))
    # a little below ``least``: what rounds up to it must be found, and products of doubles must not lose a whole number
    pairs = trigram_candidates(asked, items, max(least - 1e-6, least / 2))
    sets = pairs.join(asked.select(F.col("key").alias("q"), F.col("grams").alias("a")), "q").join(items.select(F.col("key").alias("d"), F.col("grams").alias("b")), "d")
    both = F.size(F.array_intersect("a", "b"))
    ratio = F.round(both / (F.size("a") + F.size("b") - both), 6)
    near = written(sets.select("q", "d", ratio.alias("similarity")).where(F.col("similarity") >= least))
    free(texts, counts, items, asked)
    return expand(near, wanted, held).select("query_id", "doc_id", "similarity")


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, scope: tuple[str, ...] = ()) -> DataFrame:
    """Exact cosine top ``k``; ``queries`` (query_id, embedding) is a stated set, and may grow with the vectors.

    With ``scope`` columns, which both sides have, a query only meets vectors of its own repository, snapshot or the like (P15).
    """
    return exact_top_k(queries, vectors, k, scope)


def lsh_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, bucket: float = 0.9, tables: int = 24, seed: int = 7) -> DataFrame:
    """Approximate top ``k``: random projections of unit vectors, candidates from equal buckets, exact cosine after that.

    The projections are drawn from ``seed`` and don't depend on the data; every row is indexed.
    """
    held = lambda df, id_col: df.select(F.col(id_col), unit(F.col("embedding")).alias("unit")).where("unit is not null").withColumn("vector", array_to_vector("unit"))
    items, asked = held(vectors, "doc_id"), held(queries, "query_id")
    model = BucketedRandomProjectionLSH(inputCol="vector", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(items)
    buckets = lambda df: written(model.transform(df).withColumn("buckets", F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda i: F.get(vector_to_array(F.get("hashes", i)), F.lit(0)))).drop("vector", "hashes"))
    return top(bucket_top_k(buckets(asked), buckets(items), tables, k), k)


def proximity(hops: DataFrame) -> DataFrame:
    """1 / (1 + hops) of (query_id, doc_id, depth)."""
    return hops.groupBy("query_id", "doc_id").agg(F.round(1 / (1 + F.min("depth")), 6).alias("score"))


def fuse(modes: dict[str, DataFrame], weights: DataFrame | dict[str, float] | None = None, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked frames (query_id, doc_id, rank).

    ``weights`` are one number per mode, or a frame of ``route`` with each query's own ``w_<mode>`` (R9); 1 without.
    """
    parts = None
    for name, df in modes.items():
        if isinstance(weights, DataFrame):
            df, weight = df.join(weights.select("query_id", f"w_{name}"), "query_id"), F.col(f"w_{name}")
        else:
            weight = F.lit((weights or {}).get(name, 1.0))
        one = df.select("query_id", "doc_id", (weight / (constant + F.col("rank"))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 8).alias("score"))


def route(questions: DataFrame, col: str = "question") -> DataFrame:
    """Intent of each question with the weights of keyword, vector and graph retrieval."""
    table = F.create_map(*(x for k, w in MODES.items() for x in (F.lit(k), F.array(*map(F.lit, w)))))
    out = questions.withColumn("intent", tx.intent(F.col(col))).withColumn("_w", table[F.col("intent")])
    return out.withColumns({n: F.get("_w", F.lit(i)) for i, n in enumerate(("w_keyword", "w_vector", "w_graph"))}).drop("_w")


def valid_questions(questions: DataFrame, col: str = "question") -> DataFrame:
    """1 to 2000 characters."""
    return questions.where(F.length(col).between(1, 2000))


def resolve_entities(questions: DataFrame, names: DataFrame, words: int = 2) -> DataFrame:
    """(query_id, doc_id) where a run of ``words`` words of the question is an item's key."""
    tokens = tx.tokens(F.col("question"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens") - words + 1, F.lit(1))), lambda i: F.array_join(F.slice("tokens", i, words), " "))
    asked = questions.select("query_id", tokens.alias("tokens")).select("query_id", F.explode(F.array_distinct(runs)).alias("key"))
    return asked.join(names, "key").select("query_id", "doc_id").distinct()


def rerank(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates by score, then evidence confidence, then kind: artifacts, source, model output."""
    order = F.when(F.col("evidence_type") == "artifact", 0).when(F.col("evidence_type") == "source_span", 1).otherwise(2)
    joined = candidates.join(evidence, "doc_id", "left").withColumn("kind_order", order)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("confidence"), "kind_order", "doc_id"))
    return joined.withColumn("place", place)


def assemble(ranked: DataFrame, budget: int) -> DataFrame:
    """Of each query's ranked items (rank, tokens) the first whose tokens fit the budget, with the running sum."""
    run = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running", run).where(F.col("running") <= budget)


def overlap(claim: Column, evidence: Column) -> Column:
    """Part of a claim's distinct words that the evidence has."""
    words = F.array_distinct(tx.tokens(claim))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, tx.tokens(evidence))) / F.size(words)).otherwise(0.0)


def verify_citations(citations: DataFrame, evidence: DataFrame, least: float = 0.5) -> DataFrame:
    """Outcome of each citation (claim_id, doc_id, snapshot, claim): kept, downgraded or limitation.

    The evidence (doc_id, snapshot, text) must exist, in the same snapshot; too little shared wording downgrades.
    """
    have = evidence.select("doc_id", F.col("snapshot").alias("own_snapshot"), F.col("text").alias("own_text"))
    out = citations.join(have, "doc_id", "left")
    support = F.round(overlap(F.col("claim"), F.col("own_text")), 6)
    outcome = F.when(F.col("own_snapshot").isNull(), "limitation").when(F.col("own_snapshot") != F.col("snapshot"), "limitation").when(support < least, "downgraded").otherwise("kept")
    return out.select("claim_id", "doc_id", support.alias("support"), outcome.alias("outcome"))


def answers(questions: DataFrame, kept: DataFrame) -> DataFrame:
    """One record per question: its evidence, combined confidence, and whether it is insufficient."""
    c = F.col("confidence")
    agg = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("evidence"), F.round(1 - F.exp(F.sum(F.log(1 - F.least(c, F.lit(0.999))))) + 1e-9, 6).alias("confidence"))
    out = questions.join(agg, "query_id", "left")
    found = F.when(F.col("evidence").isNull(), 0).otherwise(F.size("evidence"))
    return out.select("query_id", "question", F.lit(None).cast("string").alias("answer"), found.cast("long").alias("n_evidence"), F.col("evidence.doc_id").alias("sources"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), (found == 0).alias("insufficient"))


def search_nodes(nodes: DataFrame, q: str | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Graph nodes of the given entity types whose name holds ``q`` in any case."""
    nodes = nodes.where(F.col("entity_type").isin(*kinds)) if kinds else nodes
    return nodes.where(F.contains(F.lower("name"), F.lit(q.lower()))) if q else nodes


def answer_records(questions: DataFrame, ranked: DataFrame, related: dict[str, DataFrame], least: float = 0.5, around: int = 2) -> DataFrame:
    """The record of each question with its thirteen fields; the prose answer is left null.

    ``questions`` comes from ``route``, ``ranked`` has the few best (query_id, doc_id, rank, confidence) of each. Pieces of at least ``least`` are its
    evidence. Without any the record is insufficient: it says so in ``limitations``, and names the nearest pieces as possible
    interpretations, marked as inference. ``related`` gives (doc_id, item) for fields such as related_files, looked up for the first
    ``around`` pieces. The suggested follow-up depends on the intent.
    """
    ranked = written(ranked.select("query_id", "doc_id", "rank", "confidence"))
    good = F.col("confidence") >= least
    in_order = lambda keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("rank", "doc_id")))), lambda x: x["doc_id"])
    sure = F.round(1 - F.exp(F.sum(F.when(good, F.log(1 - F.least("confidence", F.lit(0.999)))))) + 1e-9, 6)
    out = questions.join(ranked.groupBy("query_id").agg(in_order(good).alias("evidence"), in_order(~good).alias("nearest"), sure.alias("confidence")), "query_id", "left")
    for field in ("related_files", "related_decisions", "timeline_events", "graph_path"):
        if field in related:
            items = ranked.where(F.col("rank") <= around).join(related[field], "doc_id").groupBy("query_id").agg(F.sort_array(F.collect_set("item")).alias(field))
            out = out.join(items, "query_id", "left").withColumn(field, F.coalesce(field, F.array().cast("array<string>")))
        else:
            out = out.withColumn(field, F.array().cast("array<string>"))
    ids = f"array<{ranked.schema['doc_id'].dataType.simpleString()}>"
    out = out.withColumns({c: F.coalesce(c, F.array().cast(ids)) for c in ("evidence", "nearest")})
    none = F.size("evidence") == 0
    words = lambda when, values: F.when(when, values).otherwise(F.array().cast("array<string>"))
    guesses = F.transform("nearest", lambda d: F.concat(F.lit("Inference: document "), d.cast("string"), F.lit(" may be related")))
    return out.select(
        "query_id",
        F.lit(None).cast("string").alias("answer"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "intent",
        F.lit("adaptive_hybrid").alias("retrieval_strategy"),
        "evidence",
        F.col("evidence").alias("citations"),
        "graph_path",
        "related_files",
        "related_decisions",
        "timeline_events",
        words(none, F.array(F.lit("The available evidence does not confirm an answer."))).alias("limitations"),
        words(none, guesses).alias("possible_interpretations"),
        F.array(F.concat(F.lit("Which evidence of kind "), "intent", F.lit(" should be looked at next?"))).alias("suggested_follow_up"),
        none.alias("insufficient"),
    )
