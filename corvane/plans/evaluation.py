"""Queries of evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import evaluate, infer
from corvane.plans import graphs, retrieval
from corvane.plans.registry import query
from corvane.session import written
from corvane.sources.fixtures import Tables

METRICS = f"{retrieval.BM25}, j as (select g.query_id, g.doc_id, kw.rank from v_gold g left join kw using (query_id, doc_id)), rm as (select query_id, round(count(rank) / 10, 6) as precision, round(count(rank) / count(*), 6) as recall, (count(rank) > 0)::int as hit, round(coalesce(1 / min(rank), 0), 6) as reciprocal_rank from j group by 1)"


@query("retrieval_metrics", f"with {METRICS} select * from rm", "v_queries", "v_gold")
def retrieval_metrics(t: Tables) -> DataFrame:
    return evaluate.retrieval_metrics(retrieval.keyword(t), t("v_gold"), 10)


@query("ndcg", f"with {METRICS}, n as (select query_id, coalesce(sum(1 / log2(rank + 1)), 0) as dcg, least(count(*), 10) as k from j group by 1) select query_id, round(dcg / list_sum(list_transform(range(1, k + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg from n", "v_queries", "v_gold")
def ndcg(t: Tables) -> DataFrame:
    return evaluate.ndcg(retrieval.keyword(t), t("v_gold"), 10)


@query(
    "targets_gate",
    f"with {METRICS}, {retrieval.CITED} select 'recall_at_10' as metric, round(avg(recall), 6) as value, 0.8::double as target, round(avg(recall), 6) >= 0.8 as passed from rm union all select 'citation_correctness', round(avg((outcome = 'kept')::int), 6), 0.9, round(avg((outcome = 'kept')::int), 6) >= 0.9 from ck union all select 'unsupported_claim_rate', round(avg((outcome = 'downgraded')::int), 6), 0.1, round(avg((outcome = 'downgraded')::int), 6) <= 0.1 from ck",
    "v_queries", "v_gold",
)
def targets_gate(t: Tables) -> DataFrame:
    recall = evaluate.retrieval_metrics(retrieval.keyword(t), t("v_gold"), 10).agg(F.lit("recall_at_10").alias("metric"), F.round(F.avg("recall"), 6).alias("value"))
    rates = written(evaluate.citation_rates(retrieval.checked(t)))  # one row, read twice
    return evaluate.gate(recall.unionByName(rates.select(F.lit("citation_correctness").alias("metric"), F.col("correct").alias("value"))).unionByName(rates.select(F.lit("unsupported_claim_rate").alias("metric"), F.col("unsupported").alias("value"))))


@query("citation_rates", f"with {retrieval.CITED} select count(*) as n, round(avg((outcome = 'kept')::int), 6) as correct, round(avg((outcome = 'downgraded')::int), 6) as unsupported, round(avg((outcome = 'limitation')::int), 6) as invalid from ck", "v_gold", "v_queries")
def citation_rates(t: Tables) -> DataFrame:
    return evaluate.citation_rates(retrieval.checked(t))


AR = "a.a as rank_a"


@query(
    "rank_agreement",
    f"""with {graphs.ACTIVITY}, a as (select contributor_id, count(*) over (order by authored desc) - (count(*) over (partition by authored) - 1) / 2 as rank_a, authored from act), b as (select contributor_id, count(*) over (order by reviews desc) - (count(*) over (partition by reviews) - 1) / 2 as rank_b from act),
ta as (select contributor_id from act order by authored desc, contributor_id limit 10), tb as (select contributor_id from act order by reviews desc, contributor_id limit 10)
select count(*) as n, round(corr(rank_a, rank_b), 6) as spearman, (select count(*) / 10 from ta join tb using (contributor_id)) as top_k_overlap from a join b using (contributor_id)""",
    *graphs.ACTIVE,
)
def rank_agreement(t: Tables) -> DataFrame:
    act = infer.contributor_activity(t("v_commits"), t("v_commit_files"), t("v_reviews"))
    side = lambda c: act.select("contributor_id", F.col(c).alias("score"))
    return evaluate.rank_agreement(side("authored"), side("reviews"), "contributor_id", "score")


@query("kendall_tau", "with r as (select p_partkey as item, p_size as a, p_retailprice as b from part) select round(sum(sign(x.a - y.a) * sign(x.b - y.b)) / count(*), 6) as tau from r x join r y on x.item < y.item")
def kendall_tau(t: Tables) -> DataFrame:
    return evaluate.kendall_tau(t("part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("a"), F.col("p_retailprice").alias("b")))


@query("edge_quality", "with f as (select src, dst from v_imports where src % 5 <> 0), g as (select src, dst from v_imports where dst % 7 <> 0), n as (select (select count(*) from f) as n_found, (select count(*) from g) as n_gold, (select count(*) from f join g using (src, dst)) as n_right) select n_found, n_gold, n_right, round(n_right / n_found, 6) as precision, round(n_right / n_gold, 6) as recall, round(2 * (n_right / n_found) * (n_right / n_gold) / (n_right / n_found + n_right / n_gold), 6) as f1 from n", "v_imports")
def edge_quality(t: Tables) -> DataFrame:
    e = t("v_imports")
    return evaluate.set_quality(e.where("src % 5 <> 0"), e.where("dst % 7 <> 0"), ["src", "dst"])


RESULTS = "rs as (select case user_id % 3 when 0 then 'keyword' when 1 then 'vector' else 'hybrid' end as system, case event_id % 2 when 0 then 'recall' else 'precision' end as metric, value from events)"


def _results(t: Tables) -> DataFrame:
    u, e = F.col("user_id") % 3, F.col("event_id") % 2
    return t("events").select(F.when(u == 0, "keyword").when(u == 1, "vector").otherwise("hybrid").alias("system"), F.when(e == 0, "recall").otherwise("precision").alias("metric"), "value")


TABLE = f"{RESULTS}, tb as (select system, round(avg(value) filter (metric = 'recall'), 6) as recall, round(avg(value) filter (metric = 'precision'), 6) as precision from rs group by 1)"


@query("system_table", f"with {TABLE} select * from tb")
def system_table(t: Tables) -> DataFrame:
    return evaluate.system_table(_results(t), ["recall", "precision"])


@query("ablation", f"with {TABLE} select system, round(recall - (select recall from tb where system = 'hybrid'), 6) as recall, round(precision - (select precision from tb where system = 'hybrid'), 6) as precision from tb")
def ablation(t: Tables) -> DataFrame:
    return evaluate.ablation(evaluate.system_table(_results(t), ["recall", "precision"]), "hybrid", ["recall", "precision"])


@query("fairness", "select * from (select 'status' as field, count(distinct status) as n_values from v_jobs union all select 'branch', 1) where n_values > 1", "v_jobs")
def fairness(t: Tables) -> DataFrame:
    return evaluate.fair(t("v_jobs").withColumn("branch", F.lit("main")), ["status", "branch"])


@query("crossover", "with m as (select user_id, avg(value) filter (event_id % 2 = 0) as a, avg(value) filter (event_id % 2 = 1) as b from events group by 1) select count(*) as n, round(avg(b - a), 6) as mean_difference, round(stddev_samp(b - a), 6) as deviation from m where a is not null and b is not null")
def crossover(t: Tables) -> DataFrame:
    return evaluate.crossover(t("events").select(F.col("user_id").alias("participant"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("arm"), "value"))


@query("case_profile", "select role, turn % 2 as difficulty, count(*) as n_cases from v_discussions group by all", "v_discussions")
def case_profile(t: Tables) -> DataFrame:
    return evaluate.profile(t("v_discussions").withColumn("difficulty", F.col("turn") % 2), "role", "difficulty")
