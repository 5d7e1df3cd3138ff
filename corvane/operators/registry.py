"""Repository registry as set operations: batches of requests in, accepted and rejected rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import written

# Columns of the responses, hosts that count as the provider, and the parts of a URL.
RESPONSES = {"repository": ("id", "github_url", "owner", "name", "created_at"), "snapshot": ("id", "repository_id", "commit_sha", "default_branch", "status", "created_at"), "job": ("id", "repository_id", "snapshot_id", "status", "progress", "error_message", "started_at", "completed_at", "created_at")}
HOSTS = ("github.com", "www.github.com")
URL = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def normalize_repo_url(df: DataFrame, col: str = "raw_url", hosts: tuple[str, ...] = HOSTS) -> DataFrame:
    """Adds normalized_url, owner, name and reject_reason (P1-P3): host first, then two path segments, then a name.

    Host case, user info, port, query, fragment, empty segments and one ``.git`` don't matter; case of owner and name does.
    A null URL is rejected for its host.
    """
    url = F.coalesce(F.col(col), F.lit(""))
    host = F.lower(F.regexp_extract(url, URL, 1))
    path = F.regexp_replace(F.regexp_extract(url, URL, 2), ";[^/]*$", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    name = F.regexp_replace(F.get(segments, F.lit(1)), "[.]git$", "")
    reason = F.when(~host.isin(*hosts), "unsupported_host").when(F.size(segments) != 2, "not_a_repository_path").when(name == "", "empty_name")
    out = df.withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    out = out.withColumns({"owner": F.when(good, F.get(segments, F.lit(0))), "name": F.when(good, name)})
    return out.withColumn("normalized_url", F.when(good, F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "name")))


def first_writer(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Adds is_first (W1): whether the row comes first among those with its keys."""
    return df.withColumn("is_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def with_ids(df: DataFrame, order: list[str], start: int = 0, id_col: str = "id") -> DataFrame:
    """Consecutive ids from ``start`` + 1 in a total order (W2), by a range sort and one offset per partition."""
    held = "_part", "_place"
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumns({held[0]: F.spark_partition_id(), held[1]: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = rows.groupBy(held[0]).count()  # a row per partition
    offset = counts.select(held[0], (F.sum("count").over(Window.orderBy(held[0])) - F.col("count")).alias("_offset"))
    return rows.join(offset, held[0]).withColumn(id_col, F.lit(start) + F.col("_offset") + F.col(held[1]) + 1).drop(*held, "_offset")


def register(requests: DataFrame, registry: DataFrame, url_col: str = "raw_url", order_col: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a batch (J1): bad URLs, URLs known to the registry, and repeats in the batch are rejected."""
    asked = normalize_repo_url(requests, url_col)
    bad = asked.where("reject_reason is not null")
    ranked = first_writer(asked.where("reject_reason is null"), ["normalized_url"], [order_col])
    known = ranked.join(registry.select(F.col("github_url").alias("normalized_url")), "normalized_url", "left_semi")
    new = ranked.join(registry.select(F.col("github_url").alias("normalized_url")), "normalized_url", "left_anti")
    twice = known.unionByName(new.where("not is_first")).withColumn("reject_reason", F.lit("duplicate"))
    columns = asked.columns
    return new.where("is_first").select(columns), bad.select(columns).unionByName(twice.select(columns))


def newest_first(df: DataFrame, time_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """T1, with the id as tie-break."""
    return df.orderBy(F.desc(time_col), F.desc(id_col))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page with ``total`` and ``has_next`` (T2, A14); numbers count from 1, sizes from 1 to 100."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size from 1 to 100")
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_next", F.col("total") > number * size)


def plan_ingestion(requests: DataFrame, registry: DataFrame, payloads: DataFrame) -> DataFrame:
    """Repository, default branch and head commit of each request, or the first stage that failed.

    ``payloads`` holds parsed provider answers: repository_id, status_code, default_branch, is_private, sha.
    """
    have = registry.select(F.col("id").alias("repository_id"), "github_url", F.lit(True).alias("known"))
    out = requests.join(have, "repository_id", "left").join(payloads, "repository_id", "left")
    reason = (
        F.when(F.col("known").isNull(), "repository_not_found")
        .when(F.col("status_code").isNull() | (F.col("status_code") != 200), F.concat(F.lit("provider_"), provider_error(F.col("status_code"))))
        .when(F.col("default_branch").isNull(), "invalid_repository_payload")
        .when(F.coalesce("is_private", F.lit(False)), "private_repository")
        .when(F.col("sha").isNull(), "invalid_commit_payload")
    )
    return out.select("repository_id", "github_url", "default_branch", F.col("sha").alias("commit_sha"), reason.alias("reject_reason"))


def provider_error(status: Column) -> Column:
    """Class of a provider's answer (P19): null for success."""
    return F.when(status.between(200, 299), F.lit(None).cast("string")).when(status == 404, "not_found").when(status == 403, "forbidden_or_rate_limited").otherwise("failed")


def create_snapshots(requests: DataFrame, snapshots: DataFrame, registry: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new snapshots, their pending jobs, rejected) for requests (repository_id, commit_sha, default_branch).

    A pair that exists, a repeat in the batch and a missing parent are all reported as ``snapshot_exists``.
    """
    key = ["repository_id", "commit_sha"]
    ranked = first_writer(requests, key, order)
    parents = registry.select(F.col("id").alias("repository_id"))
    able = ranked.where("is_first").join(snapshots.select(*key), key, "left_anti").join(parents, "repository_id", "left_semi")
    new = written(able.drop("is_first").withColumns({"status": F.lit("pending"), "snapshot_id": F.xxhash64(*key)}))
    jobs = new.select("repository_id", "snapshot_id", F.lit("pending").alias("status"), F.lit(0).alias("progress"))
    rejected = requests.join(new.select(*order), order, "left_anti").withColumn("reject_reason", F.lit("snapshot_exists"))
    return new, jobs, rejected


def repository_detail(registry: DataFrame, snapshots: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per repository with sorted arrays of its snapshots and jobs (J5, A2); each child is nested before the join."""

    def nested(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
        return df.groupBy(F.col("repository_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    snaps = nested(snapshots, "snapshots", ["id", "commit_sha", "status", "created_at"])
    work = nested(jobs, "jobs", ["id", "snapshot_id", "status", "progress"])
    out = registry.join(snaps, "id", "left").join(work, "id", "left")
    empty = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    return out.withColumns({"snapshots": empty(snaps, "snapshots"), "jobs": empty(work, "jobs")})


def cascade_delete(ids: DataFrame, registry: DataFrame, snapshots: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(registry, snapshots, jobs, not found) after repositories ``ids`` went with all that hangs on them."""
    gone = ids.select("id").distinct()
    by_repository = gone.select(F.col("id").alias("repository_id"))
    lost = snapshots.join(by_repository, "repository_id", "left_semi").select(F.col("id").alias("snapshot_id"))
    return (
        registry.join(gone, "id", "left_anti"),
        snapshots.join(by_repository, "repository_id", "left_anti"),
        jobs.join(by_repository, "repository_id", "left_anti").join(lost, "snapshot_id", "left_anti"),
        gone.join(registry, "id", "left_anti"),
    )


def lookup(requests: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Each request with its row of ``table``, or nulls, and ``found``.

    With repository and job id as keys a job of another repository is as absent as a missing one.
    """
    return requests.join(table.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def latest_snapshots(snapshots: DataFrame, status: str | None = "ready") -> DataFrame:
    """(repository_id, snapshot_id, commit_sha, created_at) of each repository's newest snapshot, whose result can be used again.

    Only snapshots with ``status`` count, all if it is null; of equal times the larger id is newer. One partial aggregation, no sort.
    """
    able = snapshots if status is None else snapshots.where(F.col("status") == status)
    newest = able.groupBy("repository_id").agg(F.max(F.struct("created_at", "id", "commit_sha")).alias("s"))
    return newest.select("repository_id", F.col("s.id").alias("snapshot_id"), "s.commit_sha", "s.created_at")


def response(df: DataFrame, kind: str) -> DataFrame:
    """The columns that a response about a repository, snapshot or job has; absent ones are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in RESPONSES[kind]))
