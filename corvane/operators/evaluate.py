"""Evaluation metrics over ranked results, ratings and runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import shuffle_partitions, written

# Targets of the gate.
TARGETS = {"recall_at_10": (0.80, True), "citation_correctness": (0.90, True), "unsupported_claim_rate": (0.10, False), "decision_precision": (0.85, True), "median_latency_s": (15.0, False)}


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Per query with gold: precision, recall and hit at ``k``, reciprocal rank."""
    cut = ranked.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    judged = gold.join(cut, ["query_id", "doc_id"], "left")
    out = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("rank").alias("n_hits"), F.min("rank").alias("first"))
    return out.select("query_id", F.round(F.col("n_hits") / k, 6).alias("precision"), F.round(F.col("n_hits") / F.col("n_gold"), 6).alias("recall"), (F.col("n_hits") > 0).cast("int").alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def ndcg(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Binary gain over log2(rank + 1), over the ideal."""
    gain = gold.join(ranked.where(F.col("rank") <= k), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"), F.count(F.lit(1)).alias("n_gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return gain.select("query_id", F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def average_ranks(scores: DataFrame, item: str, score: str, out: str) -> DataFrame:
    """Ranks from the highest score, ties sharing their mean rank; rows without a score have none.

    Distinct scores are range-sorted; the rows of earlier ranges are added to those of earlier scores in the same range, so no task sees all scores.
    """
    counts = scores.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    part = written(counts.repartitionByRange(F.desc(score)).withColumn("_part", F.spark_partition_id()))
    sums = part.groupBy("_part").agg(F.sum("_n").alias("_in"))  # a row for each range
    before = sums.select("_part", (F.sum("_in").over(Window.orderBy("_part")) - F.col("_in")).alias("_before"))
    order = Window.partitionBy("_part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    upto = part.withColumn("_upto", F.sum("_n").over(order)).join(before, "_part")
    return scores.join(upto, score).select(item, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))


def rank_agreement(a: DataFrame, b: DataFrame, item: str, score: str, k: int = 10) -> DataFrame:
    """Spearman's rho of two rankings of the same items, and the part of the top ``k`` they share."""
    both = average_ranks(a, item, score, "rank_a").join(average_ranks(b, item, score, "rank_b"), item)
    top = lambda df: df.orderBy(F.desc(score), item).limit(k).select(item)
    shared = top(a).join(top(b), item).agg((F.count(F.lit(1)) / k).alias("top_k_overlap"))  # one row
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rank_a", "rank_b"), 6).alias("spearman")).crossJoin(shared)


def inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """Total weight of the pairs in which an earlier value is larger than a later one, by merging halves, n log n squared."""
    if not len(values):
        return 0
    rank, at, total = np.unique(values, return_inverse=True)[1], np.arange(len(values)), 0
    for level in range(int(len(values) - 1).bit_length()):
        right, block = (at >> level) & 1, at >> (level + 1)
        order = np.lexsort((right, rank, block))
        left = np.where(right == 0, weights, 0)[order]
        upto, ends = np.cumsum(left), np.searchsorted(block[order], block[order], side="right") - 1
        total += int(((upto[ends] - upto) * np.where(right, weights, 0)[order]).sum())
    return total


#: Ranges of each order at most, so that the table of pairs of ranges stays small.
RANGES = 200


def kendall_tau(pairs: DataFrame, item: str = "item", a: str = "a", b: str = "b", parts: int | None = None) -> DataFrame:
    """Tau-a over all pairs of a ranking's items, ties counting 0; null for fewer than two items. Rows with a null are left out.

    Agreeing less disagreeing pairs are all pairs less tied ones less twice the disagreeing ones. Those are the inversions of b in
    the order of (a, b): within a range of that order, within a range of b (between rows of different ranges of the order), and between
    ranges of both, which a table with a number for each pair of ranges gives. So nothing compares all pairs, and a task
    holds two numbers for each distinct (a, b) of its range.
    """
    spark = pairs.sparkSession
    parts = parts or min(shuffle_partitions(spark), RANGES)
    cells = written(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")))
    tied = lambda df: (df.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]) or 0
    of = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n"))
    n = cells.agg(F.sum("n")).first()[0] or 0
    by_a = written(cells.repartitionByRange(parts, "a", "b").withColumn("p", F.spark_partition_id()))
    by_b = written(by_a.groupBy("p", "b").agg(F.sum("n").alias("n")).repartitionByRange(parts, "b").withColumn("r", F.spark_partition_id()))
    count = lambda df: df.agg(F.sum("inverted")).first()[0] or 0
    own = lambda df, key, order: df.groupBy(key).applyInArrow(lambda t: _sorted_inversions(t, order), "inverted long")
    inverted = count(own(by_a, "p", ["a", "b"])) + count(own(by_b, "r", ["p", "b"]))
    grid = by_b.groupBy("p", "r").agg(F.sum("n").alias("n")).toArrow()  # a row for each pair of ranges
    size = max([parts, *(x + 1 for c in (0, 1) for x in grid.column(c).to_pylist())])
    table = np.zeros((size, size), object)
    for p, r, m in zip(*(grid.column(c).to_pylist() for c in range(3)), strict=True):
        table[p, r] = m
    later = np.cumsum(table[::-1], axis=0)[::-1]  # rows from range p of the order on
    smaller = np.cumsum(later, axis=1)
    inverted += sum(table[p, r] * smaller[p + 1, r - 1] for p in range(size - 1) for r in range(1, size))
    every = n * (n - 1) / 2
    tau = (every - tied(of("a")) - tied(of("b")) + tied(cells) - 2 * inverted) / every if every else None
    return spark.createDataFrame([(None if tau is None else float(tau),)], "tau double").select(F.round("tau", 6).alias("tau"))


def _sorted_inversions(table: pa.Table, order: list[str]) -> pa.Table:
    table = table.sort_by([(c, "ascending") for c in order])
    return pa.table({"inverted": pa.array([inversions(table.column("b").to_numpy(), table.column("n").to_numpy())], pa.int64())})


def set_quality(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of found rows against gold rows."""
    a, b = found.select(*keys).distinct().withColumn("f", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    both = a.join(b, keys, "full_outer").fillna(0, ["f", "g"])
    out = both.agg(F.sum("f").alias("n_found"), F.sum("g").alias("n_gold"), F.sum(F.col("f") * F.col("g")).alias("n_right"))
    p, r = F.try_divide("n_right", "n_found"), F.try_divide("n_right", "n_gold")
    return out.select("n_found", "n_gold", "n_right", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def citation_rates(checked: DataFrame) -> DataFrame:
    """E5: parts of citations that were kept, downgraded and refused."""
    rate = lambda o: F.round(F.avg((F.col("outcome") == o).cast("double")), 6)
    return checked.agg(F.count(F.lit(1)).alias("n"), rate("kept").alias("correct"), rate("downgraded").alias("unsupported"), rate("limitation").alias("invalid"))


def system_table(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric (system, metric, value) per system, one column a metric."""
    return results.groupBy("system").pivot("metric", metrics).agg(F.round(F.avg("value"), 6))


def ablation(table: DataFrame, baseline: str, metrics: list[str]) -> DataFrame:
    """Each system's difference to the baseline."""
    base = table.where(F.col("system") == baseline).select(*(F.col(m).alias(f"base_{m}") for m in metrics))  # one row
    return table.crossJoin(F.broadcast(base)).select("system", *(F.round(F.col(m) - F.col(f"base_{m}"), 6).alias(m) for m in metrics))


def fair(runs: DataFrame, held: list[str]) -> DataFrame:
    """Configuration fields that differ between runs."""
    counts = runs.agg(*(F.count_distinct(c).alias(c) for c in held))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_values")) for c in held))).alias("x")).select("x.*").where("n_values > 1")


def crossover(trials: DataFrame) -> DataFrame:
    """Mean and deviation of each participant's difference (b less a) over trials (participant, arm, value)."""
    mean = trials.groupBy("participant").pivot("arm", ["a", "b"]).agg(F.avg("value"))
    return mean.where("a is not null and b is not null").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_difference"), F.round(F.stddev_samp(F.col("b") - F.col("a")), 6).alias("deviation"))


def gate(values: DataFrame) -> DataFrame:
    """(metric, value, target, passed) against the targets; a metric without target is left out."""
    table = F.create_map(*(x for m, (v, up) in TARGETS.items() for x in (F.lit(m), F.struct(F.lit(v).alias("target"), F.lit(up).alias("up")))))
    out = values.withColumn("t", table[F.col("metric")]).where("t is not null")
    passed: Column = F.when(F.col("t.up"), F.col("value") >= F.col("t.target")).otherwise(F.col("value") <= F.col("t.target"))
    return out.select("metric", "value", F.col("t.target").alias("target"), passed.alias("passed"))


def profile(cases: DataFrame, *columns: str) -> DataFrame:
    """Cases by the given columns."""
    return cases.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_cases"))


def decision_quality(found: DataFrame, gold: DataFrame, fields: list[str]) -> DataFrame:
    """Precision and recall of confirmed decisions, status and field accuracy, and mean chain completeness, over decisions in both."""
    both = found.alias("f").join(gold.alias("g"), "decision_id")
    ours, theirs = F.col("f.status") == "confirmed", F.col("g.status") == "confirmed"
    right = F.count_if(ours & theirs)
    same = sum((F.col(f"f.{c}").eqNullSafe(F.col(f"g.{c}")).cast("int") for c in fields), F.lit(0)) / len(fields)
    return both.agg(
        F.round(F.try_divide(right, F.count_if(ours)), 6).alias("confirmed_precision"),
        F.round(F.try_divide(right, F.count_if(theirs)), 6).alias("confirmed_recall"),
        F.round(F.avg((F.col("f.status") == F.col("g.status")).cast("int")), 6).alias("status_accuracy"),
        F.round(F.avg(same), 6).alias("field_accuracy"),
        F.round(F.avg("f.chain"), 6).alias("chain_completeness"),
    )
