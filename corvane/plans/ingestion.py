"""Queries of the registry, ingestion jobs, loading and constraint checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import checks, jobs, registry
from corvane.plans.registry import query
from corvane.session import shared_dir
from corvane.sources import keyed, load
from corvane.sources.fixtures import Tables
from corvane.streaming import job_feed

NORMAL = r"""
parsed as (select request_id, raw_url, lower(regexp_extract(raw_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)) as host,
  list_filter(string_split(regexp_replace(regexp_extract(raw_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2), ';[^/]*$', ''), '/'), lambda s: s <> '') as seg from v_submissions),
named as (select *, regexp_replace(coalesce(seg[2], ''), '[.]git$', '') as nm from parsed),
judged as (select *, case when host not in ('github.com', 'www.github.com') then 'unsupported_host' when len(seg) <> 2 then 'not_a_repository_path' when nm = '' then 'empty_name' end as reject_reason from named),
asked as (select request_id, raw_url, reject_reason, case when reject_reason is null then seg[1] end as owner, case when reject_reason is null then nm end as name,
  case when reject_reason is null then 'https://github.com/' || seg[1] || '/' || nm end as normalized_url from judged)
"""


@query("normalize_urls", "with " + NORMAL + " select request_id, normalized_url, owner, name from asked where reject_reason is null", "v_submissions")
def normalize_urls(t: Tables) -> DataFrame:
    return registry.normalize_repo_url(t("v_submissions")).where("reject_reason is null").select("request_id", "normalized_url", "owner", "name")


@query("url_rejects", "with " + NORMAL + " select request_id, raw_url, reject_reason from asked where reject_reason is not null", "v_submissions")
def url_rejects(t: Tables) -> DataFrame:
    return registry.normalize_repo_url(t("v_submissions")).where("reject_reason is not null").select("request_id", "raw_url", "reject_reason")


REGISTERED = (
    "with "
    + NORMAL
    + """, known as (select 'https://github.com/' || owner || '/' || name as u from asked where reject_reason is null and request_id % 5 = 0),
ranked as (select *, row_number() over (partition by normalized_url order by request_id) = 1 as is_first, normalized_url in (select u from known) as is_known from asked where reject_reason is null)
"""
)


def _batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    known = registry.normalize_repo_url(t("v_submissions").where("request_id % 5 = 0")).where("reject_reason is null").select(F.col("normalized_url").alias("github_url"))
    return registry.register(t("v_submissions"), known)


@query("register_batch", REGISTERED + "select request_id, normalized_url, owner, name from ranked where is_first and not is_known", "v_submissions")
def register_batch(t: Tables) -> DataFrame:
    return _batch(t)[0].select("request_id", "normalized_url", "owner", "name")


@query("register_duplicates", REGISTERED + "select request_id, reject_reason from asked where reject_reason is not null union all select request_id, 'duplicate' from ranked where is_known or not is_first", "v_submissions")
def register_duplicates(t: Tables) -> DataFrame:
    return _batch(t)[1].select("request_id", "reject_reason")


@query("registered_ids", "select id, github_url, (row_number() over (order by github_url, id))::bigint + 1000 as new_id from v_repositories", "v_repositories")
def registered_ids(t: Tables) -> DataFrame:
    return registry.with_ids(t("v_repositories").select("id", "github_url"), ["github_url", "id"], 1000, "new_id")


@query("list_newest", "select id, repository_id, created_at, status from v_snapshots order by created_at desc, id desc", "v_snapshots")
def list_newest(t: Tables) -> DataFrame:
    return registry.newest_first(t("v_snapshots").select("id", "repository_id", "created_at", "status"))


@query("page_2", "select id, github_url, owner, name, (select count(*) from v_repositories) as total, (select count(*) from v_repositories) > 40 as has_next from v_repositories order by github_url, id limit 20 offset 20", "v_repositories")
def page_2(t: Tables) -> DataFrame:
    return registry.page(t("v_repositories"), [F.col("github_url"), F.col("id")], 2, 20)


PARSED = r"""
pay as (select repository_id, status_code, case when json_extract_string(repo_raw, '$.id') is not null and json_extract_string(repo_raw, '$.name') is not null and json_extract_string(repo_raw, '$.full_name') is not null
   and json_extract_string(repo_raw, '$.default_branch') is not null and json_extract_string(repo_raw, '$.private') is not null then json_extract_string(repo_raw, '$.default_branch') end as default_branch,
  json_extract_string(repo_raw, '$.private') = 'true' as is_private, json_extract_string(commit_raw, '$.sha') as sha from v_payloads)
"""


def _payloads(t: Tables) -> DataFrame:
    parsed = load.parse_commit_payload(load.parse_repo_payload(t("v_payloads"), "repo_raw"), "commit_raw")
    return parsed.select("repository_id", "status_code", F.col("repo.default_branch").alias("default_branch"), F.col("repo.private").alias("is_private"), F.col("commit.sha").alias("sha"))


@query("payload_parse", "with " + PARSED + " select repository_id, default_branch is not null as repo_valid, default_branch, case when default_branch is not null then is_private end as is_private, sha is not null as commit_valid, sha from pay", "v_payloads")
def payload_parse(t: Tables) -> DataFrame:
    return _payloads(t).select("repository_id", F.col("default_branch").isNotNull().alias("repo_valid"), "default_branch", "is_private", F.col("sha").isNotNull().alias("commit_valid"), "sha")


PLANNED = (
    "with req as (select id as repository_id from v_repositories union all select -1),"
    + PARSED
    + """, planned as (select req.repository_id, r.github_url, pay.default_branch, pay.sha as commit_sha,
 case when r.id is null then 'repository_not_found' when status_code is null or status_code <> 200 then 'provider_' || case status_code when 404 then 'not_found' when 403 then 'forbidden_or_rate_limited' else 'failed' end
  when default_branch is null then 'invalid_repository_payload' when is_private then 'private_repository' when sha is null then 'invalid_commit_payload' end as reject_reason
 from req left join v_repositories r on r.id = req.repository_id left join pay on pay.repository_id = req.repository_id)
"""
)


def _planned(t: Tables) -> DataFrame:
    ids = t("v_repositories").select(F.col("id").alias("repository_id"))
    return registry.plan_ingestion(ids.unionByName(t.spark.range(1).select((F.col("id") - 1).alias("repository_id"))), t("v_repositories"), _payloads(t))


@query("plan_ingestion", PLANNED + "select * from planned", "v_repositories", "v_payloads")
def plan_ingestion(t: Tables) -> DataFrame:
    return _planned(t)


SNAPSHOTS = """
with req as (select repository_id, commit_sha, default_branch, id from v_snapshots where id % 2 = 0 or repository_id % 3 = 0),
have as (select repository_id, commit_sha from v_snapshots where id % 5 = 0), reg as (select id from v_repositories where id % 31 <> 0),
new as (select req.*, row_number() over (partition by repository_id, commit_sha order by id) as rn from req),
made as (select * from new where rn = 1 and (repository_id, commit_sha) not in (select (repository_id, commit_sha) from have) and repository_id in (select id from reg))
"""


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = t("v_snapshots")
    requests = v.where("id % 2 = 0 or repository_id % 3 = 0").select("repository_id", "commit_sha", "default_branch", "id")
    return registry.create_snapshots(requests, v.where("id % 5 = 0"), t("v_repositories").where("id % 31 <> 0"), ["id"])


@query("new_snapshots", SNAPSHOTS + "select id, repository_id, commit_sha, default_branch, 'pending' as status from made", "v_snapshots", "v_repositories")
def new_snapshots(t: Tables) -> DataFrame:
    return _snapshots(t)[0].select("id", "repository_id", "commit_sha", "default_branch", "status")


@query("pending_jobs", SNAPSHOTS + "select repository_id, 'pending' as status, 0 as progress, count(*) as n_jobs from made group by all", "v_snapshots", "v_repositories")
def pending_jobs(t: Tables) -> DataFrame:
    return _snapshots(t)[1].groupBy("repository_id", "status", "progress").agg(F.count_distinct("snapshot_id").alias("n_jobs"))


@query("snapshot_rejects", SNAPSHOTS + "select id, 'snapshot_exists' as reject_reason from req where id not in (select id from made)", "v_snapshots", "v_repositories")
def snapshot_rejects(t: Tables) -> DataFrame:
    return _snapshots(t)[2].select("id", "reject_reason")


@query(
    "repository_detail",
    """select r.id, r.github_url, coalesce(s.n, 0) as n_snapshots, s.lo as first_snapshot, s.shas, coalesce(j.n, 0) as n_jobs, j.hi as last_job
from v_repositories r left join (select repository_id, count(*) as n, min(id) as lo, string_agg(commit_sha, ',' order by id) as shas from v_snapshots group by 1) s on s.repository_id = r.id
left join (select repository_id, count(*) as n, max(id) as hi from v_jobs group by 1) j on j.repository_id = r.id""",
    "v_repositories", "v_snapshots", "v_jobs",
)
def repository_detail(t: Tables) -> DataFrame:
    out = registry.repository_detail(t("v_repositories"), t("v_snapshots"), t("v_jobs"))
    shas = F.array_join(F.col("snapshots.commit_sha"), ",")
    return out.select("id", "github_url", F.size("snapshots").cast("long").alias("n_snapshots"), F.get("snapshots", F.lit(0))["id"].alias("first_snapshot"), F.when(F.size("snapshots") > 0, shas).alias("shas"), F.size("jobs").cast("long").alias("n_jobs"), F.when(F.size("jobs") > 0, F.get("jobs", F.size("jobs") - 1)["id"]).alias("last_job"))


@query(
    "cascade_delete_counts",
    """with gone as (select id from v_repositories where id % 10 = 0 union all select -5)
select 'repositories' as tbl, count(*) as n from v_repositories where id not in (select id from gone)
union all select 'snapshots', count(*) from v_snapshots where repository_id not in (select id from gone)
union all select 'jobs', count(*) from v_jobs where repository_id not in (select id from gone) and snapshot_id not in (select id from v_snapshots where repository_id in (select id from gone))
union all select 'not_found', 1""",
    "v_repositories", "v_snapshots", "v_jobs",
)
def cascade_delete_counts(t: Tables) -> DataFrame:
    ids = t("v_repositories").where("id % 10 = 0").select("id").unionByName(t.spark.range(1).select((F.col("id") - 5).alias("id")))
    parts = registry.cascade_delete(ids, t("v_repositories"), t("v_snapshots"), t("v_jobs"))
    names = ("repositories", "snapshots", "jobs", "not_found")
    counts = [df.agg(F.lit(n).alias("tbl"), F.count(F.lit(1)).alias("n")) for n, df in zip(names, parts, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("fk_orphans", "select id, snapshot_id from v_jobs where snapshot_id not in (select id from v_snapshots)", "v_jobs", "v_snapshots")
def fk_orphans(t: Tables) -> DataFrame:
    return checks.orphans(t("v_jobs"), "snapshot_id", t("v_snapshots"), "id").select("id", "snapshot_id")


@query("unique_violations", "select repository_id, commit_sha, count(*) as n from v_snapshots group by all having count(*) > 1", "v_snapshots")
def unique_violations(t: Tables) -> DataFrame:
    return checks.repeats(t("v_snapshots"), ["repository_id", "commit_sha"])


@query(
    "constraint_report",
    """select 'C1 unique url' as rule, (select count(*) from (select github_url from v_repositories group by 1 having count(*) > 1)) as n
union all select 'C2 unique snapshot', (select count(*) from (select 1 from v_snapshots group by repository_id, commit_sha having count(*) > 1))
union all select 'C3 progress range', (select count(*) from v_jobs where progress not between 0 and 100)
union all select 'C4 lengths', (select count(*) from v_snapshots where length(commit_sha) > 40 or length(default_branch) > 255)
union all select 'C5 status domain', (select count(*) from v_jobs where status not in ('pending', 'queued', 'running', 'completed', 'failed'))
union all select 'C6 job without snapshot', (select count(*) from v_jobs where snapshot_id not in (select id from v_snapshots))
union all select 'C6 job of another repository', (select count(*) from v_jobs j join v_snapshots s on s.id = j.snapshot_id where s.repository_id <> j.repository_id)""",
    "v_repositories", "v_snapshots", "v_jobs",
)
def constraint_report(t: Tables) -> DataFrame:
    repos, snaps, work = t("v_repositories"), t("v_snapshots"), t("v_jobs")
    mixed = work.join(snaps.select(F.col("id").alias("snapshot_id"), F.col("repository_id").alias("own")), "snapshot_id").where("own <> repository_id")
    return checks.report(
        {
            "C1 unique url": checks.repeats(repos, ["github_url"]),
            "C2 unique snapshot": checks.repeats(snaps, ["repository_id", "commit_sha"]),
            "C3 progress range": checks.outside(work, "progress", 0, 100),
            "C4 lengths": checks.too_long(snaps, {"commit_sha": 40, "default_branch": 255}),
            "C5 status domain": checks.unknown(work, "status", ("pending", "queued", "running", "completed", "failed")),
            "C6 job without snapshot": checks.orphans(work, "snapshot_id", snaps, "id"),
            "C6 job of another repository": mixed,
        }
    )


@query(
    "job_lookup_scoped",
    """with req as (select id as job_id, case when id % 4 = 0 then repository_id + 1 else repository_id end as repository_id from v_jobs)
select req.job_id, req.repository_id, j.id is not null as found, j.status, j.progress from req left join v_jobs j on j.id = req.job_id and j.repository_id = req.repository_id""",
    "v_jobs",
)
def job_lookup_scoped(t: Tables) -> DataFrame:
    requests = t("v_jobs").select(F.col("id").alias("job_id"), F.when(F.col("id") % 4 == 0, F.col("repository_id") + 1).otherwise(F.col("repository_id")).alias("repository_id"))
    table = t("v_jobs").select(F.col("id").alias("job_id"), "repository_id", "status", "progress")
    return registry.lookup(requests, table, ["job_id", "repository_id"]).select("job_id", "repository_id", "found", "status", "progress")


@query("lookup_requests", "select q.github_url, r.id is not null as found, r.id, r.owner from (select github_url from v_repositories where id % 7 = 0 union all select 'https://github.com/none/none') q left join v_repositories r on r.github_url = q.github_url", "v_repositories")
def lookup_requests(t: Tables) -> DataFrame:
    asked = t("v_repositories").where("id % 7 = 0").select("github_url").unionByName(t.spark.range(1).select(F.lit("https://github.com/none/none").alias("github_url")))
    return registry.lookup(asked, t("v_repositories"), ["github_url"]).select("github_url", "found", "id", "owner")


@query("job_status_counts", "select status, count(*) as n from v_jobs group by 1", "v_jobs")
def job_status_counts(t: Tables) -> DataFrame:
    return t("v_jobs").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("provider_errors", "select case status_code when 404 then 'not_found' when 403 then 'forbidden_or_rate_limited' else 'failed' end as error, count(*) as n from v_payloads where status_code <> 200 group by 1", "v_payloads")
def provider_errors(t: Tables) -> DataFrame:
    errors = t("v_payloads").select(registry.provider_error(F.col("status_code")).alias("error")).where("error is not null")
    return errors.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("active_job_guard", "select repository_id, id, n_active, place = 1 as stays from (select *, count(*) over (partition by repository_id) as n_active, row_number() over (partition by repository_id order by created_at, id) as place from v_jobs where status in ('pending', 'queued', 'running')) where n_active > 1", "v_jobs")
def active_job_guard(t: Tables) -> DataFrame:
    return jobs.active_job_guard(t("v_jobs"))


# the state machine

FOLD = """
jb as (select distinct job_id, job_id % 23 <> 0 as has_snapshot from v_job_updates where job_id % 29 <> 0),
u as (select v.*, row_number() over (partition by job_id order by seq) as rn from v_job_updates v),
s as (select job_id, has_snapshot, 0::bigint as rn, 'pending' as status, 0 as progress, null::varchar as error_message, null::timestamp as started_at, null::timestamp as completed_at, null::bigint as seq, null::varchar as reason from jb
 union all select s.job_id, s.has_snapshot, u.rn, case when r is null then u.status else s.status end, case when r is null then u.progress else s.progress end, case when r is null then u.error_message else s.error_message end,
  case when r is null and u.status = 'running' and s.started_at is null then u.ts else s.started_at end, case when r is null and u.status in ('completed', 'failed') then u.ts else s.completed_at end, u.seq, r
 from (select s.*, u2.rn as nrn, case when s.status || '>' || u2.status not in ('pending>queued', 'pending>running', 'pending>failed', 'queued>running', 'queued>failed', 'running>running', 'running>completed', 'running>failed') then 'transition'
   when u2.progress < s.progress then 'progress_decreased' when u2.status = 'completed' and u2.progress <> 100 then 'completed_below_100' when u2.status = 'failed' and u2.error_message is null then 'failed_without_error'
   when not s.has_snapshot then 'snapshot_missing' when u2.progress not between 0 and 100 then 'progress_out_of_range' end as r
  from s join u u2 on u2.job_id = s.job_id and u2.rn = s.rn + 1) s join u on u.job_id = s.job_id and u.rn = s.nrn)
"""


def _jobs(t: Tables) -> DataFrame:
    return t("v_job_updates").where("job_id % 29 <> 0").select("job_id").distinct().withColumns({"status": F.lit("pending"), "progress": F.lit(0), "has_snapshot": F.col("job_id") % 23 != 0})


def _fold(t: Tables) -> tuple[DataFrame, DataFrame]:
    return jobs.fold_job_updates(t("v_job_updates"), _jobs(t))


LAST = "select job_id, has_snapshot, arg_max(struct_pack(s := status, p := progress, e := error_message, a := started_at, b := completed_at), rn) as f from s group by all"


@query("job_fold_final", "with " + FOLD + f" select job_id, f.s as status, f.p as progress, f.e as error_message, f.a as started_at, f.b as completed_at from ({LAST})", "v_job_updates", recursive=True)
def job_fold_final(t: Tables) -> DataFrame:
    return _fold(t)[0].drop("has_snapshot", "snapshot_status")


@query("job_fold_rejects", "with " + FOLD + " select job_id, seq, reason as reject_reason from s where reason is not null union all select job_id, seq, 'job_missing' from v_job_updates where job_id % 29 = 0", "v_job_updates", recursive=True)
def job_fold_rejects(t: Tables) -> DataFrame:
    return _fold(t)[1].where("reject_reason is not null")


@query("snapshot_status", "with " + FOLD + f" select job_id, case when has_snapshot then case f.s when 'completed' then 'ready' when 'failed' then 'failed' else 'pending' end end as snapshot_status from ({LAST})", "v_job_updates", recursive=True)
def snapshot_status(t: Tables) -> DataFrame:
    return _fold(t)[0].select("job_id", "snapshot_status")


@query("job_template_updates", "select id as job_id, case when status = 'failed' then 'failed' else 'completed' end as status, case when status = 'failed' then 10 else 100 end as progress, error_message, created_at as started_at, created_at as completed_at from v_jobs", "v_jobs")
def job_template_updates(t: Tables) -> DataFrame:
    base = t("v_jobs").select(F.col("id").alias("job_id"), F.col("created_at").alias("ts"), F.col("error_message").alias("error"))
    start = base.select("job_id", F.lit("pending").alias("status"), F.lit(0).alias("progress"), F.lit(True).alias("has_snapshot"))
    return jobs.fold_job_updates(jobs.run_template(base), start)[0].drop("has_snapshot", "snapshot_status")


@query("propagated_status", "select s.id, coalesce(case j.st when 'completed' then 'ready' when 'failed' then 'failed' when 'running' then 'pending' end, s.status) as status from v_snapshots s left join (select snapshot_id, arg_max(status, id) as st from v_jobs group by 1) j on j.snapshot_id = s.id", "v_snapshots", "v_jobs")
def propagated_status(t: Tables) -> DataFrame:
    return jobs.propagate_status(t("v_jobs"), t("v_snapshots")).select("id", "status")


def _streamed(t: Tables) -> DataFrame:
    events = job_feed.read_updates(t.spark, f"{t.sf_dir}/events.parquet")
    kind, n = F.col("event_type"), F.col("event_id")
    status = F.when(kind == "signup", "queued").when(kind.isin("view", "click"), "running").when(kind == "purchase", "completed").otherwise("failed")
    progress = F.when((kind == "purchase") & (n % 2 == 0), 100).otherwise(F.floor(F.col("value") / 5).cast("int"))
    updates = events.select(F.col("user_id").alias("job_id"), n.alias("seq"), "ts", status.alias("status"), progress.alias("progress"), F.when((kind == "error") & (n % 3 != 0), "e").alias("error_message"))
    return job_feed.run_available(job_feed.fold_stream(updates, _jobs(t)))


@query("stream_job_fold", "with " + FOLD + f" select job_id, f.s as status, f.p as progress, f.e as error_message, f.a as started_at, f.b as completed_at from ({LAST})", "v_job_updates", recursive=True)
def stream_job_fold(t: Tables) -> DataFrame:
    last = _streamed(t).where("is_state").groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "error_message", "started_at", "completed_at"), "n_seen").alias("f"))
    return last.select("job_id", "f.status", "f.progress", "f.error_message", F.col("f.started_at").cast("timestamp_ntz").alias("started_at"), F.col("f.completed_at").cast("timestamp_ntz").alias("completed_at"))


@query("stream_job_rejects", "with " + FOLD + " select job_id, seq, reason as reject_reason from s where reason is not null union all select job_id, seq, 'job_missing' from v_job_updates where job_id % 29 = 0", "v_job_updates", recursive=True)
def stream_job_rejects(t: Tables) -> DataFrame:
    return _streamed(t).where("not is_state and reject_reason is not null").select("job_id", "seq", "reject_reason")


STAGED = """
a as (select *, lag(status) over (partition by job_id, stage order by ts, status, cost) as prev from v_stage_events),
g as (select job_id, stage, arg_max(status, struct_pack(t := ts, s := status, c := cost)) as status, count(*) as n_events, (coalesce(sum((prev = 'failed')::int), 0) + 1)::bigint as attempts, min(ts) as started_at, max(ts) as last_at, round(sum(cost), 4) as cost from a group by 1, 2)
"""


@query("stage_progress", "with " + STAGED + " select * from g", "v_stage_events")
def stage_progress(t: Tables) -> DataFrame:
    return jobs.stage_progress(t("v_stage_events"))


def _fed_stages(t: Tables) -> DataFrame:
    """Stages of the streamed events, whose columns are those of v_stage_events."""
    events = job_feed.read_updates(t.spark, f"{t.sf_dir}/events.parquet")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running")
    rows = events.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 14).cast("int").alias("stage"), "ts", status.alias("status"), F.col("value").alias("cost"))
    return job_feed.latest(job_feed.stage_feed(rows), ["job_id", "stage"], "n_events")


@query("stream_stage_progress", "with " + STAGED + " select * from g", "v_stage_events")
def stream_stage_progress(t: Tables) -> DataFrame:
    return _fed_stages(t)


JOBBED = "b as (select job_id, count(*) filter (status = 'completed') as n_completed, count(*) filter (status = 'failed') as n_failed, count(*) as n_stages, max(stage) as current_stage from g group by 1), o as (select *, (n_completed * 100 // 14)::bigint as percent, case when n_completed = 14 then 'complete' when n_completed + n_failed = 14 and n_completed = 0 then 'failed' when n_failed > 0 and n_completed > 0 then 'partial' else 'running' end as outcome from b)"
STATES = "case when outcome = 'complete' then 'ready' when outcome in ('failed', 'partial') then outcome else ([" + ", ".join(f"'{s}'" for s in jobs.STATE_OF_STAGE) + "])[current_stage + 1] end"


@query("job_progress", f"with {STAGED}, {JOBBED} select *, {STATES} as repository_state from o", "v_stage_events")
def job_progress(t: Tables) -> DataFrame:
    return jobs.job_progress(jobs.stage_progress(t("v_stage_events")))


@query("stream_job_progress", f"with {STAGED}, {JOBBED} select *, {STATES} as repository_state from o", "v_stage_events")
def stream_job_progress(t: Tables) -> DataFrame:
    return jobs.job_progress(_fed_stages(t))


@query("stream_weekly", "select date_trunc('week', ts)::timestamp as week, event_type, count(*) as n from events group by 1, 2")
def stream_weekly(t: Tables) -> DataFrame:
    events = job_feed.read_updates(t.spark, f"{t.sf_dir}/events.parquet")
    return job_feed.latest(job_feed.weekly(events.select(F.col("ts").alias("event_ts"), "event_type")), ["week", "event_type"], "n")


@query("stage_report", "select stage, count(*) as n_events, round(avg((status = 'failed')::int::double), 6) as failure_rate, round(quantile_cont(cost, 0.5), 6) as median_cost, round(sum(cost), 4) as total_cost from v_stage_events group by 1", "v_stage_events")
def stage_report(t: Tables) -> DataFrame:
    return jobs.stage_report(t("v_stage_events"))


@query("section_status", f"with {STAGED} select job_id, sec.section, coalesce(case when g.status = 'completed' then 'available' when g.status = 'failed' then 'unavailable' else 'pending' end, 'pending') as section_status from (select distinct job_id from g) j cross join (values ('overview', 6), ('architecture', 8), ('decisions', 10), ('contributors', 12)) sec(section, stage) left join g using (job_id, stage)", "v_stage_events")
def section_status(t: Tables) -> DataFrame:
    return checks.section_status(jobs.stage_progress(t("v_stage_events")), {"overview": 6, "architecture": 8, "decisions": 10, "contributors": 12})


# loading

@query("upsert_latest", "select o_orderkey as id, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as status from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def upsert_latest(t: Tables) -> DataFrame:
    orders = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    target, updates = orders.where("id % 2 = 0"), orders.where("id % 3 = 0").withColumn("status", F.lit("X"))
    return load.upsert(target.withColumn("version", F.lit(0)), updates.withColumn("version", F.lit(1)), ["id"], "version").drop("version")


@query(
    "stored_upsert",
    """with u as (select l_orderkey as id, max(l_returnflag) as status, count(*)::bigint as version from lineitem group by 1)
select coalesce(o_orderkey, id) as id, coalesce(u.status, o_orderstatus) as status, coalesce(u.version, 0)::bigint as version from orders full join u on id = o_orderkey""",
)
def stored_upsert(t: Tables) -> DataFrame:
    """Orders stored by buckets of their key, then the state of their lines put in, twice: the second time writes nothing."""
    path = f"{shared_dir(t.spark)}/corvane-keyed-{uuid.uuid4().hex}"
    zero = F.lit(0).cast("long").alias("version")
    keyed.upsert(t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), zero), path, ["id"], "version", buckets=8)
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_returnflag").alias("status"), F.count(F.lit(1)).alias("version"))
    for _ in range(2):
        keyed.upsert(lines, path, ["id"], "version")
    return keyed.read(t.spark, path)


@query("versioned_rows", "select id, status, 'registry' as origin, '1.0.0' as ontology_version from v_jobs", "v_jobs")
def versioned_rows(t: Tables) -> DataFrame:
    return load.with_versions(t("v_jobs").select("id", "status"), {"origin": "registry", "ontology_version": "1.0.0"})


@query(
    "chunk_hash",
    r"""with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
c as (select doc_id, unnest(range(0, (len(ls) + 3) // 4)) as chunk, ls from l)
select doc_id, chunk::bigint as chunk, (chunk * 4 + 1)::bigint as start_line, least(chunk * 4 + 4, len(ls))::bigint as end_line, sha256(array_to_string(ls[chunk * 4 + 1:chunk * 4 + 4], chr(10))) as content_hash from c""",
)
def chunk_hash(t: Tables) -> DataFrame:
    return tx.chunks(t("documents"), "doc_id", "text", 4).select("doc_id", "chunk", "start_line", "end_line", "content_hash")


@query("embedding_reuse", "with h as (select doc_id, sha256(coalesce(text, '')) as content_hash from documents), have as (select distinct content_hash from h where doc_id % 3 = 0) select doc_id, content_hash in (select content_hash from have) as reused from h")
def embedding_reuse(t: Tables) -> DataFrame:
    hashed = t("documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash")).withColumns({"model": F.lit("m1"), "chunk_version": F.lit(1)})
    have = hashed.where("doc_id % 3 = 0").drop("doc_id")
    reuse, fresh = load.reuse_embeddings(hashed, have)
    return reuse.select("doc_id", F.lit(True).alias("reused")).unionByName(fresh.select("doc_id", F.lit(False).alias("reused")))


# sources and sinks, written to the shared folder and read back

@query("registry_stored", "select id, repository_id, snapshot_id, status, progress, error_message, created_at::date as created_on from v_jobs", "v_jobs")
def registry_stored(t: Tables) -> DataFrame:
    path = f"{shared_dir(t.spark)}/corvane-registry-{uuid.uuid4().hex}"
    jobs = registry.response(t("v_jobs"), "job")
    for half in (jobs.where("id % 2 = 0"), jobs.where("id % 2 <> 0")):
        load.append_registry(half, path, "ingestion_jobs")
    return load.read_registry(t.spark, path, "ingestion_jobs").select("id", "repository_id", "snapshot_id", "status", "progress", "error_message", F.col("created_at").cast("date").alias("created_on"))


@query("artifacts_read", "select discussion_id * 1000 + turn as number, role as title, text as body from v_discussions", "v_discussions")
def artifacts_read(t: Tables) -> DataFrame:
    path = f"{shared_dir(t.spark)}/corvane-artifacts-{uuid.uuid4().hex}"
    t("v_discussions").select((F.col("discussion_id") * 1000 + F.col("turn")).alias("number"), F.col("role").alias("title"), F.col("text").alias("body"), F.lit("unknown").alias("other")).write.json(f"{path}/discussions")
    return load.read_artifacts(t.spark, path, "discussions").select("number", "title", "body")


@query(
    "sections_published",
    """with r as (select c_nationkey::bigint as snapshot_id, c_mktsegment as section_type, c_custkey as item from customer), again as (select * from r where snapshot_id % 2 = 0 and item % 3 > 0)
select *, 2 as version from again union all select r.*, 1 from r where not exists (select 1 from again a where a.snapshot_id = r.snapshot_id and a.section_type = r.section_type)""",
)
def sections_published(t: Tables) -> DataFrame:
    path = f"{shared_dir(t.spark)}/corvane-sections-{uuid.uuid4().hex}"
    rows = t("customer").select(F.col("c_nationkey").cast("long").alias("snapshot_id"), F.col("c_mktsegment").alias("section_type"), F.col("c_custkey").alias("item"))
    load.publish_section(rows.withColumn("version", F.lit(1)), path)
    for _ in range(2):  # a repeated publication changes nothing
        load.publish_section(rows.where("snapshot_id % 2 = 0 and item % 3 > 0").withColumn("version", F.lit(2)), path)
    return t.spark.read.schema("item long, version int, snapshot_id long, section_type string").parquet(path).select("snapshot_id", "section_type", "item", "version")


@query("rejects_stored", REGISTERED + "select request_id, reject_reason from asked where reject_reason is not null union all select request_id, 'duplicate' from ranked where is_known or not is_first", "v_submissions")
def rejects_stored(t: Tables) -> DataFrame:
    path = f"{shared_dir(t.spark)}/corvane-rejects-{uuid.uuid4().hex}"
    accepted, rejected = _batch(t)
    load.write_rejects(rejected.select("request_id", "reject_reason"), path)
    load.write_rejects(accepted.select("request_id", "reject_reason"), path)  # none of them is written
    return t.spark.read.schema("request_id long, reject_reason string").parquet(path)
