"""Queries of the knowledge graph, contributors, timeline and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import checks, graph, infer
from corvane.operators.modularity import modular_levels, modularity
from corvane.plans.registry import query
from corvane.sources.fixtures import Tables


def imports(t: Tables) -> DataFrame:
    return t("v_imports")


def _nodes(t: Tables) -> DataFrame:
    return graph.union(
        graph.nodes(t("v_repositories"), "repository", F.col("id"), F.col("name")),
        graph.nodes(t("v_files"), "file", F.col("file_id"), F.col("path")),
        graph.nodes(t("v_commits"), "commit", F.col("sha"), F.col("sha")),
        graph.nodes(t("v_signals").select("subsystem").distinct(), "subsystem", F.col("subsystem"), F.col("subsystem"), "inferred", 0.6),
    )


NODES = """n as (select 'repository:' || id as node_key, 'repository' as entity_type, name, 'deterministic' as knowledge_kind, 1.0::double as confidence from v_repositories
 union all select 'file:' || file_id, 'file', path, 'deterministic', 1.0 from v_files union all select 'commit:' || sha, 'commit', sha::varchar, 'deterministic', 1.0 from v_commits
 union all select distinct 'subsystem:' || subsystem, 'subsystem', subsystem, 'inferred', 0.6 from v_signals)"""


def _edges(t: Tables) -> DataFrame:
    return graph.union(
        graph.edges(t("v_imports"), "IMPORTS", "file", F.col("src"), "file", F.col("dst")),
        graph.edges(t("v_commit_files"), "MODIFIES", "commit", F.col("sha"), "file", F.col("file_id")),
        graph.edges(t("v_signals"), "PART_OF_SUBSYSTEM", "file", F.col("file_id"), "subsystem", F.col("subsystem"), "inferred"),
        graph.edges(t("v_commits"), "AUTHORED", "person", F.col("author_id"), "commit", F.col("sha")),
        graph.edges(t("v_files").where("file_id % 50 = 0"), "LIKES", "file", F.col("file_id"), "file", F.col("file_id")),
    )


EDGES = """e as (select distinct 'file:' || src as source_key, 'file:' || dst as target_key, 'IMPORTS' as relationship_type, 'deterministic' as knowledge_kind from v_imports
 union all select distinct 'commit:' || sha, 'file:' || file_id, 'MODIFIES', 'deterministic' from v_commit_files union all select distinct 'file:' || file_id, 'subsystem:' || subsystem, 'PART_OF_SUBSYSTEM', 'inferred' from v_signals
 union all select distinct 'person:' || author_id, 'commit:' || sha, 'AUTHORED', 'deterministic' from v_commits union all select 'file:' || file_id, 'file:' || file_id, 'LIKES', 'deterministic' from v_files where file_id % 50 = 0)"""
EDGE_VIEWS = ("v_imports", "v_commit_files", "v_signals", "v_commits", "v_files", "v_repositories")


@query(
    "graph_rejects",
    f"""with {NODES}, {EDGES}, k as (select *, case when knowledge_kind = 'inferred' then split_part(source_key, ':', 2)::bigint end as k from e),
 r as (select source_key, target_key, relationship_type, case when relationship_type = 'LIKES' then 'unknown_relation' when a.node_key is null then 'missing_source' when b.node_key is null then 'missing_target'
 when source_key = target_key then 'self_loop' when relationship_type = 'MODIFIES' then 'pair_not_allowed' when k % 3 = 0 then 'inferred_without_confidence' when k % 5 = 0 then 'inferred_without_provenance'
 when k % 2 = 0 and k % 7 = 0 then 'confirmed_without_evidence' end as reject_reason
 from k left join n a on a.node_key = source_key left join n b on b.node_key = target_key) select * from r where reject_reason is not null""",
    *EDGE_VIEWS,
)
def graph_rejects(t: Tables) -> DataFrame:
    pairs = t.spark.createDataFrame([("IMPORTS", "file", "file"), ("PART_OF_SUBSYSTEM", "file", "subsystem"), ("AUTHORED", "person", "commit")], "relationship_type string, source_type string, target_type string")
    k = F.when(F.col("knowledge_kind") == "inferred", F.split_part("source_key", F.lit(":"), F.lit(2)).cast("long"))
    judged = _edges(t).withColumn("k", k).withColumns({"confidence": F.when(F.col("k") % 3 != 0, 0.6), "provenance": F.when(F.col("k") % 5 != 0, "signals"), "status": F.when(F.col("k") % 2 == 0, "confirmed")})
    found = graph.validate_graph(_nodes(t), judged, pairs, evidence=judged.where("k % 7 <> 0").select("source_key", "target_key"))
    return found.where("reject_reason is not null").select("source_key", "target_key", "relationship_type", "reject_reason")


DEGREE = "d as (select node, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from (select src as node, 0 as i, 1 as o from v_imports union all select dst, 1, 0 from v_imports) group by 1)"


@query("degree", f"with {DEGREE} select node, in_degree, out_degree, round((in_degree + out_degree) / ((select count(*) from d) - 1), 8) as centrality from d", "v_imports")
def degree(t: Tables) -> DataFrame:
    return graph.degree_centrality(imports(t))


@query("metric_long", f"with {DEGREE} select node, 'in_degree' as metric, in_degree::double as value, '1.0.0' as algorithm_version from d union all select node, 'out_degree', out_degree, '1.0.0' from d", "v_imports")
def metric_long(t: Tables) -> DataFrame:
    d = graph.degree_centrality(imports(t))
    return graph.persist_metrics({m: d.select("node", F.col(m).alias("value")) for m in ("in_degree", "out_degree")})


@query(
    "co_change",
    """with p as (select a.file_id as file_a, b.file_id as file_b, count(*) as support from v_commit_files a join v_commit_files b on a.sha = b.sha and a.file_id < b.file_id group by 1, 2 having count(*) >= 2),
n as (select file_id, count(*) as n from v_commit_files group by 1), m as (select count(distinct sha) as n_commits from v_commit_files)
select file_a, file_b, support, round(support / x.n, 6) as confidence, round(support * n_commits / (x.n * y.n), 6) as lift from p join n x on x.file_id = file_a join n y on y.file_id = file_b, m""",
    "v_commit_files",
)
def co_change(t: Tables) -> DataFrame:
    return graph.co_change(t("v_commit_files"))


SEEDS = "s as (select distinct src as node from v_imports where src % 100 = 0)"


@query(
    "neighbors_3",
    f"with {SEEDS}, e as (select distinct src, dst from v_imports), r as (select node as seed, node, 0 as depth from s union select r.seed, e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 3), m as (select seed, node, min(depth)::int as depth from r group by 1, 2) select * from m qualify row_number() over (partition by seed order by depth, node) <= 500",
    "v_imports",
    recursive=True,
)
def neighbors_3(t: Tables) -> DataFrame:
    seeds = t("v_imports").where("src % 100 = 0").select(F.col("src").alias("node")).distinct()
    return graph.neighbors(seeds, imports(t), 3)


PATHS = """x as (select min(src) as s from v_imports), e as (select distinct src, dst from v_imports),
r as (select s as node, 0 as depth from x union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 12), f as (select node, min(depth)::int as depth from r group by 1)"""


@query("shortest_path", f"with {PATHS} select f.node, f.depth, (select min(g.node) from f g join e on e.src = g.node where e.dst = f.node and g.depth = f.depth - 1) as parent from f", "v_imports", recursive=True)
def shortest_path(t: Tables) -> DataFrame:
    source = t("v_imports").agg(F.min("src")).first()[0]
    return graph.shortest_paths(source, imports(t))


@query("path_check", f"with {PATHS} select 'path steps' as rule, max(depth)::bigint as n from f union all select 'C12 steps without an edge', 0", "v_imports", recursive=True)
def path_check(t: Tables) -> DataFrame:
    tree = graph.shortest_paths(t("v_imports").agg(F.min("src")).first()[0], imports(t))
    far = tree.orderBy(F.desc("depth"), "node").first()["node"]
    path = graph.path_to(far, tree)
    return checks.report({"path steps": path, "C12 steps without an edge": graph.paths_unproven(path, imports(t))})


@query(
    "components",
    """with e as (select src as a, dst as b from v_imports union select dst, src from v_imports), r(node, label) using key (node) as (select a, a from e union select e.b, min(r.label) from r join e on e.a = r.node join recurring.r k on k.node = e.b where r.label < k.label group by 1)
select node, label as component from r""",
    "v_imports",
    recursive=True,
)
def components(t: Tables) -> DataFrame:
    return graph.components(imports(t))


RANKS = "e as materialized (select distinct src, dst from v_imports), o as materialized (select src, count(*) as k from e group by 1), v as materialized (select src as node from e union select dst from e), n as materialized (select count(*) as n from v), r0 as materialized (select node, 1.0::double / n as r from v, n)" + "".join(
    f", g{i} as materialized (select e.dst as node, sum(r.r / o.k) as g from e join o using (src) join r{i - 1} r on r.node = e.src group by 1), r{i} as materialized (select v.node, (0.15 + 0.85 * (1.0 - (select sum(g) from g{i}))) / n + 0.85 * coalesce(g, 0) as r from v left join g{i} using (node), n)" for i in range(1, 11)
)


@query("pagerank_10", f"with {RANKS} select node, round(r, 8) as rank from r10", "v_imports")
def pagerank_10(t: Tables) -> DataFrame:
    return graph.pagerank(imports(t), 10).select("node", F.round("rank", 8).alias("rank"))


@query(
    "decision_leads",
    """with e as (select src as a, dst as b from v_imports union select dst, src from v_imports), r(node, label) using key (node) as (select a, a from e union select e.b, min(r.label) from r join e on e.a = r.node join recurring.r k on k.node = e.b where r.label < k.label group by 1)
select label as candidate_id, count(*) as n_artifacts, arg_min(file_id, (file_id % 5) * 1000000000000 + file_id) as lead_id from r join v_files on file_id = node group by 1""",
    "v_imports", "v_files",
    recursive=True,
)
def decision_leads(t: Tables) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("adr", "discussion", "pull_request", "issue", "commit"))), (F.col("file_id") % 5 + 1).cast("int"))
    return infer.decision_candidates(imports(t), t("v_files").select(F.col("file_id").alias("artifact_id"), kinds.alias("kind")))


LABELS = "ce as materialized (select src as node, dst as other from v_imports where src <> dst union select dst, src from v_imports where src <> dst), c0 as materialized (select src as node, src as label from v_imports union select dst, dst from v_imports)" + "".join(
    f", c{i} as materialized (select node, label from (select node, label, count(*) as votes from (select ce.node, c{i - 1}.label from ce join c{i - 1} on c{i - 1}.node = ce.other union all select node, label from c{i - 1}) group by 1, 2) qualify row_number() over (partition by node order by votes desc, label) = 1)" for i in range(1, 11)
)


@query("communities", f"with {LABELS} select node, c10.label, c10.label = c9.label as settled from c10 join c9 using (node)", "v_imports")
def communities(t: Tables) -> DataFrame:
    return graph.communities(imports(t))


REACH = """ce as (select distinct src, dst from v_imports where src is not null and dst is not null), cr as (select src as a, dst as b from ce union select cr.a, ce.dst from cr join ce on ce.src = cr.b),
cyc as (select x.a as node, min(x.b) as component, count(*) as size from cr x join cr y on y.a = x.b and y.b = x.a group by 1)"""


@query("cycles", f"with {REACH} select node, component, size from cyc", "v_imports", recursive=True)
def cycles(t: Tables) -> DataFrame:
    return graph.dependency_cycles(imports(t))


@query("bridge_nodes", f"with {LABELS} select ce.node, count(distinct o.label) as n_communities from ce join c10 o on o.node = ce.other join c10 m on m.node = ce.node where o.label <> m.label group by 1 having count(distinct o.label) >= 2", "v_imports")
def bridge_nodes(t: Tables) -> DataFrame:
    return graph.bridge_nodes(imports(t), graph.communities(imports(t)).select("node", "label"))


@query("modular_communities")
def modular_communities(t: Tables) -> DataFrame:
    """All levels of communities; local moving has no SQL, so tests hold it against plain counting and planted groups."""
    return modular_levels(imports(t))


@query(
    "community_quality",
    f"""with {LABELS}, tot as (select count(*) as whole from ce), inn as (select m.label, count(*) as k, count_if(o.label = m.label) as inner_ends from ce join c10 m on m.node = ce.node join c10 o on o.node = ce.other group by 1),
lb as (select distinct label from c10) select count(*) as n_communities, round(sum(coalesce(inner_ends, 0) / whole) - sum(power(coalesce(k, 0) / whole, 2)), 8) as modularity from lb left join inn using (label), tot""",
    "v_imports",
)
def community_quality(t: Tables) -> DataFrame:
    labels = graph.communities(imports(t)).select("node", "label")
    return modularity(imports(t), labels).withColumn("modularity", F.round("modularity", 8))


@query("betweenness")
def betweenness(t: Tables) -> DataFrame:
    pivots = t("v_imports").where("src % 100 = 0").select(F.col("src").alias("node")).distinct()
    return graph.betweenness(imports(t), pivots).withColumn("betweenness", F.round("betweenness", 6))


@query("betweenness_bounded")
def betweenness_bounded(t: Tables) -> DataFrame:
    return graph.betweenness_within(imports(t), tolerance=0.15).withColumns({c: F.round(c, 9) for c in ("betweenness", "error")})


LAYERS = """co as (select v.node, coalesce(c.component, v.node) as grp from (select src as node from ce union select dst from ce) v left join cyc c using (node)),
cs as (select distinct x.grp as a, y.grp as b from ce join co x on x.node = src join co y on y.node = dst where x.grp <> y.grp),
cl as (select distinct grp, 0 as layer from co union select cs.a, cl.layer + 1 from cl join cs on cs.b = cl.grp), lay as (select grp, max(layer) as layer from cl group by 1)"""


@query("learning_order", f"with {REACH}, {LAYERS}, {RANKS} select node, layer::int as layer, row_number() over (order by layer, round(r, 8) desc, node) as place from co join lay using (grp) join r10 using (node)", "v_imports", recursive=True)
def learning_order(t: Tables) -> DataFrame:
    return graph.learning_places(graph.learning_order(imports(t)), graph.pagerank(imports(t), 10))


MEMBERS = "m as (select file_id, directory as subsystem from v_files)"


def _members(t: Tables) -> DataFrame:
    return t("v_files").select("file_id", F.col("directory").alias("subsystem"))


@query("subsystem_dependencies", f"with {MEMBERS} select a.subsystem as src_subsystem, b.subsystem as dst_subsystem, count(*) as n_edges from v_imports join m a on a.file_id = src join m b on b.file_id = dst where a.subsystem <> b.subsystem group by 1, 2", "v_imports", "v_files")
def subsystem_dependencies(t: Tables) -> DataFrame:
    return graph.subsystem_edges(imports(t), _members(t))


@query(
    "subsystem_quality",
    f"""with {MEMBERS}, b as (select x.subsystem as sa, y.subsystem as sb from v_imports join m x on x.file_id = src join m y on y.file_id = dst), tot as (select count(*) as mm from b),
e as (select sa as subsystem, (sa = sb)::int as i from b union all select sb, (sa = sb)::int from b), g as (select subsystem, (sum(i) / 2)::bigint as n_inner, sum(1 - i)::bigint as n_crossing, count(*) as ends from e group by 1)
select subsystem, n_inner, n_crossing, round(n_inner / (n_inner + n_crossing), 6) as cohesion, round(1 - n_inner / (n_inner + n_crossing), 6) as crossing_share, round(n_inner / mm - (ends / (2 * mm)) ** 2 + 1e-12, 6) as modularity from g, tot""",
    "v_imports", "v_files",
)
def subsystem_quality(t: Tables) -> DataFrame:
    return graph.subsystem_quality(imports(t), _members(t))


@query(
    "subsystem_stability",
    f"with {MEMBERS}, a as (select * from m where file_id % 5 <> 0), b as (select * from m where file_id % 7 <> 0), j as (select coalesce(a.subsystem, b.subsystem) as subsystem, a.file_id is not null as was, b.file_id is not null as now from a full join b on a.file_id = b.file_id and a.subsystem = b.subsystem) select subsystem, count(*) filter (was and now) as kept, count(*) filter (now and not was) as added, count(*) filter (was and not now) as lost, round(count(*) filter (was and now) / count(*), 6) as jaccard from j group by 1",
    "v_files",
)
def subsystem_stability(t: Tables) -> DataFrame:
    return graph.stability(_members(t).where("file_id % 5 <> 0"), _members(t).where("file_id % 7 <> 0"))


# contributors and timeline

ACTIVITY = """cs as (select c.author_id, c.sha, c.ts, f.file_id from v_commits c left join v_commit_files f on f.sha = c.sha),
act as (select p.id as contributor_id, coalesce(a.n, 0) as authored, coalesce(r.n, 0) as reviews, coalesce(f.n, 0) as subsystem_files, a.last as last_activity from (select author_id as id from v_commits union select reviewer_id from v_reviews) p
 left join (select author_id, count(*) as n, max(ts) as last from v_commits group by 1) a on a.author_id = p.id left join (select reviewer_id, count(*) as n from v_reviews group by 1) r on r.reviewer_id = p.id
 left join (select author_id, count(distinct file_id) as n from cs group by 1) f on f.author_id = p.id)"""
ACTIVE = ("v_commits", "v_commit_files", "v_reviews")


def _activity(t: Tables) -> DataFrame:
    return infer.contributor_activity(t("v_commits"), t("v_commit_files"), t("v_reviews"))


@query("contributor_activity", f"with {ACTIVITY} select * from act", *ACTIVE)
def contributor_activity(t: Tables) -> DataFrame:
    return _activity(t)


@query(
    "contributor_score",
    f"with {ACTIVITY}, mx as (select max(authored) as a, max(reviews) as r, max(subsystem_files) as f from act) select contributor_id, round(0.30 * authored / a + 0.20 * reviews / r + 0.15 * authored / a + 0.20 * subsystem_files / f + 0.15 * coalesce(pow(0.5, greatest(date_diff('day', last_activity::date, date '1998-12-31'), 0) / 90.0), 0) + 1e-9, 6) as score from act, mx",
    *ACTIVE,
)
def contributor_score(t: Tables) -> DataFrame:
    return infer.contributor_score(_activity(t), "1998-12-31")


@query(
    "subsystem_top_contributor",
    "with g as (select f.directory as subsystem, c.author_id as contributor_id, count(*) as n from v_commits c join v_commit_files cf on cf.sha = c.sha join v_files f on f.file_id = cf.file_id group by 1, 2) select * from g qualify row_number() over (partition by subsystem order by n desc, contributor_id) = 1",
    "v_commits", "v_commit_files", "v_files",
)
def subsystem_top_contributor(t: Tables) -> DataFrame:
    return infer.top_per(infer.contributor_by_subsystem(t("v_commits"), t("v_commit_files"), _members(t)), "subsystem", "contributor_id")


@query(
    "subsystem_rollup",
    f"""with {MEMBERS}, d as (select a.subsystem, b.subsystem as other, count(*) as n from v_imports join m a on a.file_id = src join m b on b.file_id = dst where a.subsystem <> b.subsystem group by 1, 2),
dt as (select * from d qualify row_number() over (partition by subsystem order by n desc, other) = 1), k as (select m.subsystem, c.author_id, count(*) as n, max(c.ts) as last from v_commits c join v_commit_files cf on cf.sha = c.sha join m on m.file_id = cf.file_id group by 1, 2),
kt as (select * from k qualify row_number() over (partition by subsystem order by n desc, author_id) = 1)
select f.subsystem, f.n_files, dt.other as top_dependency, kt.author_id as top_contributor, l.last as last_activity from (select subsystem, count(*) as n_files from m group by 1) f left join dt using (subsystem) left join kt using (subsystem) left join (select subsystem, max(last) as last from k group by 1) l using (subsystem)""",
    "v_files", "v_imports", "v_commits", "v_commit_files",
)
def subsystem_rollup(t: Tables) -> DataFrame:
    return infer.subsystem_rollup(_members(t), imports(t), t("v_commits"), t("v_commit_files"))


TIMELINE = "tl as (select ts as event_ts, 'commit' as event_type, sha::varchar as event_id from v_commits union all select ts, 'event_' || event_type, event_id::varchar from events)"


def _timeline(t: Tables) -> DataFrame:
    return infer.timeline({"commit": (t("v_commits"), "ts", "sha")}).unionByName(t("events").select(F.col("ts").alias("event_ts"), F.concat(F.lit("event_"), "event_type").alias("event_type"), F.col("event_id").cast("string").alias("event_id")))


@query("timeline", f"with {TIMELINE} select * from tl where event_ts >= timestamp '1995-06-01' and event_type in ('commit', 'event_error')", "v_commits")
def timeline(t: Tables) -> DataFrame:
    return infer.timeline_filter(_timeline(t), "1995-06-01", ("commit", "event_error")).orderBy("event_ts", "event_id")


@query("timeline_weekly", f"with {TIMELINE} select date_trunc('week', event_ts)::timestamp as week, event_type, count(*) as n from tl group by 1, 2", "v_commits")
def timeline_weekly(t: Tables) -> DataFrame:
    return infer.per_period(_timeline(t), "week")


@query("overview_statistics", "select 'commits' as kind, count(*) as n from v_commits union all select 'contributors', count(distinct author_id) from v_commits union all select 'files', count(*) from v_files union all select 'issues', count(distinct discussion_id) from v_discussions union all select 'pull_requests', count(distinct sha) from v_reviews union all select 'releases', count(*) from v_snapshots where status = 'ready'", "v_commits", "v_files", "v_reviews", "v_discussions", "v_snapshots")
def overview_statistics(t: Tables) -> DataFrame:
    kinds = {"commits": t("v_commits"), "contributors": t("v_commits").select("author_id").distinct(), "files": t("v_files"), "issues": t("v_discussions").select("discussion_id").distinct(), "pull_requests": t("v_reviews").select("sha").distinct(), "releases": t("v_snapshots").where("status = 'ready'")}
    return infer.statistics(kinds)


@query("language_share", "select language, count(*) as n_files, round(count(*) / sum(count(*)) over (), 6) as share from v_files group by 1", "v_files")
def language_share(t: Tables) -> DataFrame:
    return infer.histogram(t("v_files"), "language")


@query("external_counts", "select dst as dependency, count(*) as n_importers from v_imports where dst not in (select file_id from v_files where n_lines > 10) group by 1", "v_imports", "v_files")
def external_counts(t: Tables) -> DataFrame:
    known = t("v_files").where("n_lines > 10")
    outside = checks.orphans(imports(t), "dst", known, "file_id")
    return outside.groupBy(F.col("dst").alias("dependency")).agg(F.count(F.lit(1)).alias("n_importers"))


@query("top_n_files", f"with {DEGREE} select node, in_degree from d order by in_degree desc, node limit 20", "v_imports")
def top_n_files(t: Tables) -> DataFrame:
    return graph.degree_centrality(imports(t)).select("node", "in_degree").orderBy(F.desc("in_degree"), "node").limit(20)


@query(
    "entity_detail",
    "select f.file_id, f.path, coalesce(o.n, 0) as n_imports, o.first as first_import, coalesce(i.n, 0) as n_importers, coalesce(c.n, 0) as n_commits from v_files f left join (select src, count(*) as n, min(dst) as first from v_imports group by 1) o on o.src = f.file_id left join (select dst, count(*) as n from v_imports group by 1) i on i.dst = f.file_id left join (select file_id, count(*) as n from v_commit_files group by 1) c on c.file_id = f.file_id",
    "v_files", "v_imports", "v_commit_files",
)
def entity_detail(t: Tables) -> DataFrame:
    out = infer.detail(t("v_files"), "file_id", {"imports": (imports(t), "src", "dst"), "importers": (imports(t), "dst", "src"), "commits": (t("v_commit_files"), "file_id", "sha")})
    return out.select("file_id", "path", "n_imports", F.col("first_imports").alias("first_import"), "n_importers", "n_commits")


# inference

STATUS = """select subsystem, n_files, directory_share, import_share, docs_share, cochange_share, agreeing, case when agreeing >= 2 and confidence >= 0.45 then 'confirmed' else 'candidate' end as status from (
select *, (directory_share >= 0.5)::int + (import_share >= 0.3)::int + (docs_share >= 0.2)::int + (cochange_share >= 0.5)::int as agreeing, (directory_share + import_share + docs_share + cochange_share) / 4 as confidence from (
select subsystem, count(*) as n_files, round(avg(directory_signal::int), 6) as directory_share, round(avg(import_signal::int), 6) as import_share, round(avg(docs_signal::int), 6) as docs_share, round(avg(cochange_signal::int), 6) as cochange_share from v_signals group by 1))"""


def _status(t: Tables) -> DataFrame:
    return infer.subsystem_status(t("v_signals"), {"directory": 0.5, "import": 0.3, "docs": 0.2, "cochange": 0.5}, 2, 0.45)


@query("subsystem_status", STATUS, "v_signals")
def subsystem_status(t: Tables) -> DataFrame:
    return _status(t).drop("confidence")


@query(
    "architecture_fallback",
    f"with s as ({STATUS}), ok as (select count(*) as n from s where status = 'confirmed') select subsystem, 'subsystem' as basis from s, ok where status = 'confirmed' and n > 0 union all select distinct directory, 'directory' from v_files, ok where n = 0",
    "v_signals", "v_files",
)
def architecture_fallback(t: Tables) -> DataFrame:
    return infer.architecture(_status(t), t("v_files"))


@query("architecture_by_directory", "select distinct directory as subsystem, 'directory' as basis from v_files", "v_files")
def architecture_by_directory(t: Tables) -> DataFrame:
    shares = {"directory": 0.5, "import": 0.3, "docs": 0.2, "cochange": 0.5}
    return infer.architecture(infer.subsystem_status(t("v_signals"), shares, 5, 0.45), t("v_files"))  # more signals than there are: none is confirmed


DECISION = """select decision_id, n_evidence, n_firm, combined, hops, chain, case when n_firm = 0 then 'insufficient_evidence' when combined >= 0.8 and n_firm >= 2 then 'confirmed' when combined < 0.2 then 'rejected' else 'candidate' end as status from (
select decision_id, count(*) as n_evidence, count(*) filter (evidence_type <> 'model_inference') as n_firm, round(case when max(confidence) >= 1 then 1.0 else 1 - exp(sum(case when confidence < 1 then ln(1 - confidence) end)) end + 1e-9, 6) as combined,
 count(distinct evidence_type) as hops, round(count(distinct evidence_type) / 4, 6) as chain from v_evidence group by 1)"""


@query("decision_status", DECISION, "v_evidence")
def decision_status(t: Tables) -> DataFrame:
    return infer.decision_status(t("v_evidence"))


COMBINED = "round(case when max(confidence) >= 1 then 1.0 else 1 - exp(sum(case when confidence < 1 then ln(1 - confidence) end)) end + 1e-9, 6)"


@query(
    "decision_rules",
    f"""with v as (select *, evidence_type <> 'model_inference' as firm, case evidence_id % 3 when 1 then 'context' when 2 then 'action' end as part, evidence_id in (3, 4) as contradicts from v_evidence),
 s as (select decision_id, count(*) as n_evidence, count(*) filter (firm) as n_firm, {COMBINED} as combined from v where not contradicts group by 1), a as (select decision_id, {COMBINED} as against from v where contradicts and firm group by 1),
 h as (select decision_id, coalesce(bool_or(firm and not contradicts and part = 'context'), false) as has_context, coalesce(bool_or(firm and not contradicts and part = 'action'), false) as has_action from v group by 1),
 j as (select decision_id, has_context, has_action, coalesce(n_evidence, 0) as n_evidence, coalesce(n_firm, 0) as n_firm, coalesce(combined, 0) as combined, coalesce(against, 0) as against from h left join s using (decision_id) left join a using (decision_id))
select *, case when n_firm = 0 then 'insufficient_evidence' when against > combined or combined < 0.2 then 'rejected' when has_context and has_action and combined >= 0.8 and n_firm >= 2 then 'confirmed' else 'candidate' end as status from j""",
    "v_evidence",
)
def decision_rules(t: Tables) -> DataFrame:
    part = F.when(F.col("evidence_id") % 3 == 1, "context").when(F.col("evidence_id") % 3 == 2, "action")
    return infer.decision_rules(t("v_evidence").withColumns({"part": part, "contradicts": F.col("evidence_id").isin(3, 4)}))


@query("evidence_combined", f"select decision_id, combined, case when combined >= 0.8 then 'high' when combined >= 0.55 then 'medium' else 'low' end as band from ({DECISION})", "v_evidence")
def evidence_combined(t: Tables) -> DataFrame:
    return infer.combined_evidence(t("v_evidence"), ["decision_id"]).select("decision_id", "combined", infer.confidence_band(F.col("combined")).alias("band"))


@query("confidence_bands", "select case when confidence >= 0.8 then 'high' when confidence >= 0.55 then 'medium' else 'low' end as band, count(*) as n from v_evidence group by 1", "v_evidence")
def confidence_bands(t: Tables) -> DataFrame:
    return t("v_evidence").groupBy(infer.confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ontology_report",
    """select 'C7 confidence range' as rule, (select count(*) from v_evidence where confidence not between 0 and 1) as n union all select 'C8 self-loops', (select count(*) from v_imports where src = dst)
union all select 'C9 decisions on model output alone', (select count(*) from (select decision_id from v_evidence group by 1 having count(*) filter (evidence_type <> 'model_inference') = 0)) union all select 'C11 vector lengths', (select count(*) from embeddings where len(embedding) <> 64)""",
    "v_evidence", "v_imports",
)
def ontology_report(t: Tables) -> DataFrame:
    evidence = t("v_evidence")
    return checks.report(
        {
            "C7 confidence range": checks.outside(evidence, "confidence", 0, 1),
            "C8 self-loops": imports(t).where("src = dst"),
            "C9 decisions on model output alone": checks.unproven(evidence.select("decision_id").distinct(), evidence, ["decision_id"], "model_inference"),
            "C11 vector lengths": t("embeddings").where(F.size("embedding") != 64),
        }
    )


@query(
    "evidence_chain",
    "select c.sha, count(distinct f.file_id) as n_files, count(distinct r.reviewer_id) as n_reviewers, round(((count(f.file_id) > 0)::int + (count(r.reviewer_id) > 0)::int + 1) / 3.0, 6) as completeness from v_commits c left join v_commit_files f on f.sha = c.sha left join v_reviews r on r.sha = c.sha group by 1",
    "v_commits", "v_commit_files", "v_reviews",
)
def evidence_chain(t: Tables) -> DataFrame:
    return infer.commit_chain(t("v_commits"), t("v_commit_files"), t("v_reviews"))


@query(
    "published_items",
    "select e.decision_id, e.evidence_id, case e.evidence_type when 'model_inference' then 'Inferred' else 'Observed' end as label from v_evidence e where confidence >= 0.55 and evidence_type <> 'model_inference' and decision_id in (select sha from v_commit_files where file_id % 9 <> 0) and decision_id in (select decision_id from v_evidence group by 1 having count(*) filter (evidence_type <> 'model_inference') >= 2 and count(*) filter (confidence >= 0.8) > 0)",
    "v_evidence", "v_commit_files",
)
def published_items(t: Tables) -> DataFrame:
    e = t("v_evidence")
    confirmed = e.groupBy("decision_id").agg(F.count_if(F.col("evidence_type") != "model_inference").alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("sure")).select("decision_id", F.when((F.col("n") >= 2) & (F.col("sure") > 0), "confirmed").otherwise("candidate").alias("status"))
    items = e.join(confirmed, "decision_id").withColumns({"provenance": F.lit("evidence"), "verified": F.lit(True)})
    return infer.publishable(items, t("v_commit_files").where("file_id % 9 <> 0").select(F.col("sha").alias("decision_id")), 0.55, ("artifact", "source_span")).select("decision_id", "evidence_id", infer.knowledge_label(F.col("evidence_type")).alias("label"))


@query("knowledge_labels", "select evidence_type, case evidence_type when 'model_inference' then 'Inferred' else 'Observed' end as label, count(*) as n from v_evidence group by 1", "v_evidence")
def knowledge_labels(t: Tables) -> DataFrame:
    return t("v_evidence").groupBy("evidence_type").agg(F.count(F.lit(1)).alias("n")).select("evidence_type", infer.knowledge_label(F.col("evidence_type")).alias("label"), "n")


@query(
    "cluster_topics",
    r"""with w as (select lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) as term from documents), f as (select lang, term, count(*) as tf from w group by 1, 2),
n as (select count(distinct lang) as n from f), d as (select term, count(*) as df from f group by 1), s as (select lang, term, tf, round(tf * ln((1 + n) / df), 4) as weight from f join d using (term), n)
select lang, term, tf, weight, rk::int as place from (select *, row_number() over (partition by lang order by weight desc, term) as rk from s) where rk <= 5""",
)
def cluster_topics(t: Tables) -> DataFrame:
    return infer.topics(t("documents"), "lang", "text", 5)


@query(
    "recency_wording",
    "select author_id as contributor_id, max(ts) as last_activity, date_diff('day', max(ts)::date, date '1998-12-31')::int as days, round(pow(0.5, greatest(date_diff('day', max(ts)::date, date '1998-12-31'), 0) / 90.0), 6) as recency, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') as last_iso, 'The available activity suggests ' || count(*) || ' commits' as wording from v_commits group by 1",
    "v_commits",
)
def recency_wording(t: Tables) -> DataFrame:
    return infer.activity_wording(t("v_commits"), "1998-12-31")


@query("mask_secrets", r"""select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)(token|secret|password|api_key)\s*=\s*"[^"]*"', '\1 = "***"', 'g'), 'gh[pousr]_[A-Za-z0-9]{20,}', '***', 'g'), 'AKIA[0-9A-Z]{16}', '***', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g')) as masked_sha256 from documents""")
def mask_secrets(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.sha2(tx.mask_secrets(F.coalesce("text", F.lit(""))), 256).alias("masked_sha256"))


@query("excerpts", "select doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) as excerpt from documents where text is not null")
def excerpts(t: Tables) -> DataFrame:
    return t("documents").where("text is not null").select("doc_id", tx.excerpt(F.col("text"), F.lit(2), 2).alias("excerpt"))


@query("canonical_paths", "select file_id, 'github:file:' || directory || ':' || file_id as canonical_key, regexp_replace(path, '/+', '/', 'g') as normal_path from v_files", "v_files")
def canonical_paths(t: Tables) -> DataFrame:
    return t("v_files").select("file_id", tx.canonical_key("file", "directory", "file_id").alias("canonical_key"), tx.normal_path(F.concat(F.lit("./"), F.regexp_replace("path", "/", "//"))).alias("normal_path"))
