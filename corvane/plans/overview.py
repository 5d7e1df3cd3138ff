"""Queries of lookups, code links, evidence, architecture inputs, answer records and decision quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import evaluate, graph, infer, registry, search
from corvane.plans import graphs, retrieval
from corvane.plans.registry import query
from corvane.session import written
from corvane.sources.fixtures import Tables
from corvane.streaming import job_feed


@query("latest_snapshots", "select repository_id, id as snapshot_id, commit_sha, created_at from v_snapshots where status = 'ready' qualify row_number() over (partition by repository_id order by created_at desc, id desc) = 1", "v_snapshots")
def latest_snapshots(t: Tables) -> DataFrame:
    return registry.latest_snapshots(t("v_snapshots"))


@query(
    "lookup_ids",
    """select 'repository' as kind, q.id, r.id is not null as found from (select c_custkey * 2 as id from customer) q left join v_repositories r using (id)
union all select 'snapshot', q.id, s.id is not null from (select o_orderkey + 7 as id from orders) q left join v_snapshots s using (id) union all select 'job', q.id, j.id is not null from (select o_orderkey - 7 as id from orders) q left join v_jobs j using (id)""",
    "v_repositories", "v_snapshots", "v_jobs",
)
def lookup_ids(t: Tables) -> DataFrame:
    orders = F.col("o_orderkey")
    asked = {"repository": (t("customer").select((F.col("c_custkey") * 2).alias("id")), "v_repositories"), "snapshot": (t("orders").select((orders + 7).alias("id")), "v_snapshots"), "job": (t("orders").select((orders - 7).alias("id")), "v_jobs")}
    return graph.union(*(registry.lookup(ids, t(table), ["id"]).select(F.lit(kind).alias("kind"), "id", "found") for kind, (ids, table) in asked.items()))


@query("lookup_evidence", "select q.decision_id, q.evidence_id, e.decision_id is not null as found, e.evidence_type, e.confidence from (select l_orderkey as decision_id, l_linenumber + 1 as evidence_id from lineitem) q left join v_evidence e using (decision_id, evidence_id)", "v_evidence")
def lookup_evidence(t: Tables) -> DataFrame:
    asked = t("lineitem").select(F.col("l_orderkey").alias("decision_id"), (F.col("l_linenumber") + 1).alias("evidence_id"))
    return registry.lookup(asked, t("v_evidence"), ["decision_id", "evidence_id"]).select("decision_id", "evidence_id", "found", "evidence_type", "confidence")


@query("job_responses", "select id, repository_id, snapshot_id, status, progress, error_message, null::timestamp as started_at, null::timestamp as completed_at, created_at from v_jobs", "v_jobs")
def job_responses(t: Tables) -> DataFrame:
    out = registry.response(t("v_jobs"), "job")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "completed_at")})


# code

CODE = """fl as (select src, case src % 3 when 0 then 'pkg/m' || src || '.py' when 1 then 'pkg/m' || src || '.ts' else 'pkg/m' || src || '.rs' end as path, dst from v_imports)"""


def _code(t: Tables) -> DataFrame:
    """A source file for each importing file, with an import line for each import; a third of them is in a language that isn't read."""
    src, dst = F.col("src").cast("string"), F.col("dst").cast("string")
    path = F.concat(F.lit("pkg/m"), src, F.when(F.col("src") % 3 == 0, ".py").when(F.col("src") % 3 == 1, ".ts").otherwise(".rs"))
    line = F.when(F.col("src") % 3 == 0, F.concat(F.lit("import pkg.m"), dst)).otherwise(F.concat(F.lit("import x from 'pkg/m"), dst, F.lit("'")))
    define = F.when(F.col("src") % 3 == 0, F.concat(F.lit("def f"), src, F.lit("(x):\n  pass\nclass C"), src, F.lit(":"))).otherwise(F.concat(F.lit("export function f"), src, F.lit("() {}\nclass C"), src, F.lit(" {}")))
    return t("v_imports").groupBy(path.alias("path"), define.alias("define")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines")).select("path", F.concat_ws("\n", "lines", "define").alias("content"))


@query("languages_by_extension", f"with {CODE} select case src % 3 when 0 then 'Python' when 1 then 'TypeScript' end as language, count(distinct path) as n_files from fl group by 1", "v_imports")
def languages_by_extension(t: Tables) -> DataFrame:
    return _code(t).groupBy(tx.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


@query("import_links", f"with {CODE}, k as (select distinct path from fl) select distinct fl.path, case src % 3 when 0 then 'pkg.m' || dst else 'pkg/m' || dst end as module, case dst % 3 when 0 then 'pkg/m' || dst || '.py' when 1 then 'pkg/m' || dst || '.ts' end as target, (dst % 3 < 2) as resolved from fl join k t on t.path like 'pkg/m' || dst || '.%' where src % 3 < 2", "v_imports")
def import_links(t: Tables) -> DataFrame:
    files = written(_code(t))
    found, _ = tx.imports_of(files)
    links = tx.resolve_imports(found, files)
    there = files.select(F.regexp_extract("path", "m(\\d+)", 1).alias("n"))
    return links.join(there, F.regexp_extract("module", "m(\\d+)$", 1) == F.col("n"), "left_semi").select("path", "module", "target", "resolved")


@query("symbols", f"with {CODE} select distinct path, 'f' || src as symbol, 'function' as kind from fl where src % 3 < 2 union all select distinct path, 'C' || src, 'class' from fl where src % 3 < 2", "v_imports")
def symbols(t: Tables) -> DataFrame:
    return tx.symbols_of(_code(t))


@query("unreadable_files", f"with {CODE} select distinct path, 'unsupported_language' as reject_reason from fl where src % 3 = 2", "v_imports")
def unreadable_files(t: Tables) -> DataFrame:
    return tx.imports_of(_code(t))[1]


@query("node_rejects", "select 'chat:' || discussion_id as node_key, 'chat' as entity_type from (select distinct discussion_id from v_discussions)", "v_discussions")
def node_rejects(t: Tables) -> DataFrame:
    talks = t("v_discussions").select("discussion_id").distinct()
    table = graph.union(graphs._nodes(t), graph.nodes(talks, "chat", F.col("discussion_id"), F.col("discussion_id")))
    return graph.unknown_entities(table).select("node_key", "entity_type")


@query("entity_search", f"with {graphs.NODES} select node_key, entity_type, name from n where entity_type in ('file', 'subsystem') and contains(lower(name), 'brand#1')", "v_repositories", "v_files", "v_commits", "v_signals")
def entity_search(t: Tables) -> DataFrame:
    return search.search_nodes(graphs._nodes(t), "Brand#1", ("file", "subsystem")).select("node_key", "entity_type", "name")


@query("directory_subgraph", "select src, dst from v_imports where src in (select file_id from v_files where n_lines > 25) and dst in (select file_id from v_files where n_lines > 25)", "v_imports", "v_files")
def directory_subgraph(t: Tables) -> DataFrame:
    return graph.subgraph(t("v_files").withColumnRenamed("file_id", "node"), t("v_imports"), F.col("n_lines") > 25)[1].select("src", "dst")


# evidence

@query(
    "evidence_paths",
    """with i as (select n_nationkey as issue_id from nation), p as (select c_custkey as pr_id, c_nationkey as issue_id from customer), c as (select sha, author_id as pr_id from v_commits)
select issue_id, pr_id, sha, file_id, 'issue:' || issue_id || coalesce('>pull_request:' || pr_id, '') || coalesce('>commit:' || sha, '') || coalesce('>file:' || file_id, '') as path,
 round((1 + (pr_id is not null)::int + (sha is not null)::int + (file_id is not null)::int) / 4, 6) as completeness from i left join p using (issue_id) left join c using (pr_id) left join v_commit_files using (sha)""",
    "v_commits", "v_commit_files",
)
def evidence_paths(t: Tables) -> DataFrame:
    issues, requests = t("nation").select(F.col("n_nationkey").alias("issue_id")), t("customer").select(F.col("c_custkey").alias("pr_id"), F.col("c_nationkey").alias("issue_id"))
    out = infer.evidence_paths(issues, requests, t("v_commits").select("sha", F.col("author_id").alias("pr_id")), t("v_commit_files"))
    return out.withColumn("path", F.array_join("path", ">"))


@query(
    "attached_evidence",
    """with a as (select decision_id as sha, count(*) as n_evidence, round(case when max(confidence) >= 1 then 1.0 else 1 - exp(sum(case when confidence < 1 then ln(1 - confidence) end)) end + 1e-9, 6) as combined from v_evidence group by 1),
b as (select decision_id as sha, string_agg(evidence_id, ',' order by confidence desc, evidence_id) as best from (select * from v_evidence qualify row_number() over (partition by decision_id order by confidence desc, evidence_id) <= 3) group by 1)
select sha, coalesce(n_evidence, 0) as n_evidence, coalesce(combined, 0.0) as combined, coalesce(best, '') as best from v_commits left join a using (sha) left join b using (sha)""",
    "v_commits", "v_evidence",
)
def attached_evidence(t: Tables) -> DataFrame:
    out = infer.attach_evidence(t("v_commits").select("sha"), t("v_evidence").withColumnRenamed("decision_id", "sha"), ["sha"], 3)
    return out.select("sha", "n_evidence", "combined", F.array_join(F.transform("evidence.evidence_id", lambda e: e.cast("string")), ",").alias("best"))


@query("commit_file_links", "select distinct 'commit:' || sha as source_key, 'file:' || file_id as target_key, 'MODIFIES' as relationship_type from v_commit_files join v_commits using (sha) join v_files using (file_id)", "v_commit_files", "v_commits", "v_files")
def commit_file_links(t: Tables) -> DataFrame:
    return infer.link_commit_files(t("v_commit_files"), t("v_commits"), t("v_files"))


PROFILE = """select p.id as contributor_id, coalesce(n_commits, 0) as n_commits, coalesce(n_reviews, 0) as n_reviews, coalesce(directories, '') as directories from (select author_id as id from v_commits union select reviewer_id from v_reviews) p
left join (select author_id as id, count(distinct sha) as n_commits from v_commits group by 1) c using (id) left join (select reviewer_id as id, count(distinct sha) as n_reviews from v_reviews group by 1) r using (id)
left join (select id, string_agg(directory, ',' order by directory) as directories from (select distinct author_id as id, directory from v_commits join v_commit_files using (sha) join v_files using (file_id)) group by 1) d using (id)"""


@query("contributor_detail", PROFILE, "v_commits", "v_commit_files", "v_files", "v_reviews")
def contributor_detail(t: Tables) -> DataFrame:
    out = infer.contributor_detail(t("v_commits"), t("v_commit_files"), t("v_reviews"), graphs._members(t))
    return out.withColumnRenamed("subsystems", "directories").withColumn("directories", F.array_join("directories", ","))


@query(
    "decision_detail",
    f"with d as ({graphs.DECISION}), f as (select sha as decision_id, count(*) as n_files from v_commit_files group by 1), p as (select sha as decision_id, count(distinct reviewer_id) as n_people from v_reviews group by 1) select decision_id, status, combined, n_evidence, coalesce(n_files, 0) as n_files, coalesce(n_people, 0) as n_people from d left join f using (decision_id) left join p using (decision_id)",
    "v_evidence", "v_commit_files", "v_reviews",
)
def decision_detail(t: Tables) -> DataFrame:
    files, people = t("v_commit_files").withColumnRenamed("sha", "decision_id"), t("v_reviews").withColumnRenamed("sha", "decision_id")
    out = infer.detail(infer.decision_status(t("v_evidence")), "decision_id", {"files": (files, "decision_id", "file_id"), "people": (people, "decision_id", "reviewer_id")})
    return out.select("decision_id", "status", "combined", "n_evidence", "n_files", "n_people")


# subsystems and architecture

PAIRS = "cp as materialized (select a.file_id as file_a, b.file_id as file_b, count(*) as support from v_commit_files a join v_commit_files b on a.sha = b.sha and a.file_id < b.file_id group by 1, 2 having count(*) >= 2)"
STAY = lambda name, table, a, b, w: f"{name} as (select subsystem, round(sum(w) filter (inr) / sum(w), 6) as s from (select x.subsystem, {w} as w, x.subsystem = y.subsystem as inr from {table} join m x on x.file_id = {a} join m y on y.file_id = {b} union all select y.subsystem, {w}, false from {table} join m x on x.file_id = {a} join m y on y.file_id = {b} where x.subsystem <> y.subsystem) group by 1)"
CANDIDATES = f"""with {graphs.LABELS}, {graphs.MEMBERS}, {PAIRS}, cells as (select m.subsystem, c10.label, count(*) as n from m left join c10 on c10.node = m.file_id group by 1, 2),
z as (select subsystem, sum(n)::bigint as n_files from cells group by 1), lb as (select label, sum(n) as n_label from cells where label is not null group by 1),
lg as (select * from cells where label is not null qualify row_number() over (partition by subsystem order by n desc, label) = 1),
nm as (select subsystem, max(n) as n_named from (select directory as subsystem, split_part(p_name, ' ', 1) as word, count(*) as n from v_files join part on p_partkey = file_id group by 1, 2) group by 1),
{STAY('si', 'v_imports', 'src', 'dst', '1')}, {STAY('sc', 'cp', 'file_a', 'file_b', 'support')},
g as (select z.subsystem, lg.label, z.n_files, round(coalesce(lg.n / z.n_files, 0), 6) as directory_signal, round(coalesce(lg.n / lb.n_label, 0), 6) as community_signal, coalesce(si.s, 0) as import_signal, coalesce(sc.s, 0) as cochange_signal, round(coalesce(n_named / z.n_files, 0), 6) as naming_signal
 from z left join lg using (subsystem) left join lb on lb.label = lg.label left join nm using (subsystem) left join si using (subsystem) left join sc using (subsystem)),
h as (select *, (directory_signal >= 0.5)::int + (community_signal >= 0.5)::int + (import_signal >= 0.5)::int + (cochange_signal >= 0.5)::int + (naming_signal >= 0.5)::int as agreeing from g)
select *, case when agreeing >= 2 then 'confirmed' else 'candidate' end as status from h"""


@query("subsystem_candidates", CANDIDATES, "v_imports", "v_files", "v_commit_files")
def subsystem_candidates(t: Tables) -> DataFrame:
    names = t("part").select(F.col("p_partkey").alias("file_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"))
    return infer.subsystem_candidates(graph.communities(t("v_imports")), graphs._members(t), t("v_imports"), graph.co_change(t("v_commit_files")), names)


@query(
    "architecture_inputs",
    f"""with {graphs.MEMBERS}, {graphs.DEGREE}, s as ({graphs.STATUS}), im as (select src, dst from v_imports where src % 4 <> 0 and dst % 7 <> 0), k as (select file_id from v_files where n_lines > 2)
select 'subsystem' as kind, subsystem as item, n_files::double as value from s where status = 'confirmed'
union all select 'dependency', a.subsystem || ' > ' || b.subsystem, count(*)::double from v_imports join m a on a.file_id = src join m b on b.file_id = dst where a.subsystem <> b.subsystem group by a.subsystem, b.subsystem
union all (select 'central_file', node::varchar, in_degree::double from d order by in_degree desc, node limit 20)
union all select 'entry_point', src::varchar, count(*)::double from im where src not in (select dst from im) and src in (select file_id from k) group by src
union all select 'external', dst::varchar, count(*)::double from im where dst not in (select file_id from k) group by dst
union all select 'document', doc_id::varchar, n_chars::double from documents""",
    "v_imports", "v_files", "v_signals",
)
def architecture_inputs(t: Tables) -> DataFrame:
    central = graph.degree_centrality(t("v_imports")).select("node", F.col("in_degree").alias("value")).orderBy(F.desc("value"), "node").limit(20)
    dependencies = graph.subsystem_edges(t("v_imports"), graphs._members(t))
    static = t("v_imports").where("src % 4 <> 0 and dst % 7 <> 0")  # so that some files have no importer
    return infer.architecture_inputs(graphs._status(t), dependencies, central, static, t("v_files").where("n_lines > 2"), t("documents"))


@query(
    "section_tables",
    """with st as (select id as snapshot_id, section, case when status = 'ready' and id % k <> 0 then 'available' when status = 'failed' then 'unavailable' else 'pending' end as section_status from v_snapshots, (values ('files', 5), ('reviews', 7), ('decisions', 11)) x(section, k)),
n as (select sha as snapshot_id, 'files' as section, count(*) as n_items from v_commit_files where file_id % 2 = 0 group by 1 union all select sha, 'reviews', count(*) from v_reviews where reviewer_id % 2 = 0 group by 1 union all select decision_id, 'decisions', count(*) from v_evidence where confidence > 0.8 group by 1),
j as (select st.*, coalesce(n_items, 0) as n_items, sum((section_status <> 'available')::int) over (partition by st.snapshot_id) as missing from st left join n using (snapshot_id, section))
select snapshot_id, section, section_status, n_items, section_status = 'available' and n_items = 0 as is_empty, section_status = 'available' and missing > 0 as is_partial from j""",
    "v_snapshots", "v_commit_files", "v_reviews", "v_evidence",
)
def section_tables(t: Tables) -> DataFrame:
    sections = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.lit(k).alias("k")) for s, k in (("files", 5), ("reviews", 7), ("decisions", 11))))).alias("x")
    status = F.when((F.col("status") == "ready") & (F.col("snapshot_id") % F.col("k") != 0), "available").when(F.col("status") == "failed", "unavailable").otherwise("pending")
    asked = t("v_snapshots").select(F.col("id").alias("snapshot_id"), "status", sections).select("snapshot_id", "status", "x.section", "x.k").select("snapshot_id", "section", status.alias("section_status"))
    parts = {"files": (t("v_commit_files").where("file_id % 2 = 0"), "sha"), "reviews": (t("v_reviews").where("reviewer_id % 2 = 0"), "sha"), "decisions": (t("v_evidence").where("confidence > 0.8"), "decision_id")}
    counts = graph.union(*(df.groupBy(F.col(key).alias("snapshot_id")).agg(F.count(F.lit(1)).alias("n_items")).withColumn("section", F.lit(s)) for s, (df, key) in parts.items()))
    return infer.section_tables(counts, asked)


# answers

RECORDS = f"""with {retrieval.BM25}, cf as (select *, score / (score + 10) as confidence from kw where rank <= 5),
ev as (select query_id, string_agg(doc_id, ',' order by rank) as evidence, round(1 - exp(sum(ln(1 - least(confidence, 0.999)))) + 1e-9, 6) as confidence from cf where confidence >= 0.5 group by 1),
nr as (select query_id, string_agg('Inference: document ' || doc_id || ' may be related', ',' order by rank) as possible from cf where confidence < 0.5 group by 1),
rf as (select query_id, string_agg(x, ',' order by x) as related_files from (select distinct query_id, 'file:' || file_id as x from cf join v_commit_files on sha = doc_id where rank <= 2) group by 1),
rd as (select query_id, string_agg(x, ',' order by x) as related_decisions from (select distinct query_id, 'decision:' || decision_id as x from cf join v_evidence on decision_id = doc_id where rank <= 2) group by 1),
rq as (select *, {retrieval.INTENT.replace("text", "question")} as intent from v_queries)
select query_id, coalesce(confidence, 0.0) as confidence, intent, coalesce(evidence, '') as evidence, coalesce(related_files, '') as related_files, coalesce(related_decisions, '') as related_decisions,
 case when evidence is null then 'The available evidence does not confirm an answer.' else '' end as limitations, case when evidence is null then coalesce(possible, '') else '' end as possible_interpretations, evidence is null as insufficient
from rq left join ev using (query_id) left join nr using (query_id) left join rf using (query_id) left join rd using (query_id)"""


@query("answer_details", RECORDS, "v_queries", "v_commit_files", "v_evidence")
def answer_details(t: Tables) -> DataFrame:
    """The records of ``search.answer_records`` with their arrays as text; the constant and null fields left out."""
    found = retrieval.keyword(t).where("rank <= 5").withColumn("confidence", F.col("score") / (F.col("score") + 10))
    kinds = {"related_files": t("v_commit_files").select(F.col("sha").alias("doc_id"), F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("item")), "related_decisions": t("v_evidence").select(F.col("decision_id").alias("doc_id"), F.concat(F.lit("decision:"), F.col("decision_id").cast("string")).alias("item"))}
    out = search.answer_records(search.route(t("v_queries")), found, kinds, least=0.5, around=2)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("query_id", "confidence", "intent", *map(text, ("evidence", "related_files", "related_decisions", "limitations", "possible_interpretations")), "insufficient")


# decisions against gold

GOLD = f"d as ({graphs.DECISION}), gd as (select decision_id, case when combined >= 0.7 and n_evidence >= 2 then 'confirmed' when n_firm = 0 then 'insufficient_evidence' else 'candidate' end as gold_status, n_firm % 5 <> 0 as field_ok from d)"
QUALITY = f"{GOLD}, dq as (select round(sum((status = 'confirmed' and gold_status = 'confirmed')::int) / sum((status = 'confirmed')::int), 6) as confirmed_precision, round(sum((status = 'confirmed' and gold_status = 'confirmed')::int) / sum((gold_status = 'confirmed')::int), 6) as confirmed_recall, round(avg((status = gold_status)::int), 6) as status_accuracy, round(avg(field_ok::int), 6) as field_accuracy, round(avg(chain), 6) as chain_completeness from d join gd using (decision_id))"


def _quality(t: Tables) -> DataFrame:
    d = infer.decision_status(t("v_evidence"))
    status = F.when((F.col("combined") >= 0.7) & (F.col("n_evidence") >= 2), "confirmed").when(F.col("n_firm") == 0, "insufficient_evidence").otherwise("candidate")
    found = d.select("decision_id", "status", "chain", (F.col("n_firm") % 5).alias("action"))
    gold = d.select("decision_id", status.alias("status"), F.when(F.col("n_firm") % 5 == 0, -1).otherwise(F.col("n_firm") % 5).alias("action"))
    return evaluate.decision_quality(found, gold, ["action"])


@query("decision_quality", f"with {QUALITY} select * from dq", "v_evidence")
def decision_quality(t: Tables) -> DataFrame:
    return _quality(t)


@query(
    "all_targets",
    f"with {GOLD}, {QUALITY.split(', ', 1)[1].split('field_ok from d), ', 1)[1]}, lt as (select quantile_cont(cost, 0.5) / 10 as v from v_stage_events), x as (select 'decision_precision' as metric, (select confirmed_precision from dq) as value, 0.85::double as target, true as up union all select 'median_latency_s', (select round(v, 6) from lt), 15.0, false) select metric, value, target, case when up then value >= target else value <= target end as passed from x",
    "v_evidence", "v_stage_events",
)
def all_targets(t: Tables) -> DataFrame:
    precision = _quality(t).select(F.lit("decision_precision").alias("metric"), F.col("confirmed_precision").alias("value"))
    latency = t("v_stage_events").agg(F.lit("median_latency_s").alias("metric"), F.round(F.percentile("cost", F.lit(0.5)) / 10, 6).alias("value"))
    return evaluate.gate(precision.unionByName(latency))


# streams

@query("stage_retry", "select user_id as job_id, (event_id % 14)::int as stage, arg_max(event_type, event_id) as status, max(event_id) as version from events group by 1, 2")
def stage_retry(t: Tables) -> DataFrame:
    events = job_feed.read_updates(t.spark, f"{t.sf_dir}/events.parquet")
    stages = events.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 14).cast("int").alias("stage"), F.col("event_type").alias("status"), F.col("event_id").alias("version"))
    return job_feed.upserted(stages, ["job_id", "stage"], "version")


@query("stream_distinct", "select distinct user_id, event_type from events")
def stream_distinct(t: Tables) -> DataFrame:
    events = job_feed.read_updates(t.spark, f"{t.sf_dir}/events.parquet")
    once = job_feed.distinct_within(events.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "36500 days")
    return job_feed.run_available(once.select("user_id", "event_type"), "append").select("user_id", "event_type")
