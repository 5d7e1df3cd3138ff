"""Sources and sinks: landed payloads and artifacts in, registry tables, sections and rejects out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_L, _S, _TS = T.LongType(), T.StringType(), T.TimestampType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


REGISTRY = {
    "repositories": _schema(("id", _L, False), ("github_url", _S, False), ("owner", _S, False), ("name", _S, False), ("created_at", _TS, False)),
    "repository_snapshots": _schema(("id", _L, False), ("repository_id", _L, False), ("commit_sha", _S, False), ("default_branch", _S, False), ("status", _S, False), ("created_at", _TS, False)),
    "ingestion_jobs": _schema(("id", _L, False), ("repository_id", _L, False), ("snapshot_id", _L, False), ("status", _S, False), ("progress", T.IntegerType(), False), ("error_message", _S, True), ("started_at", _TS, True), ("completed_at", _TS, True), ("created_at", _TS, False)),
}
ARTIFACTS = {
    "issues": "number long, title string, body string, author string, created_at timestamp, closed_at timestamp",
    "pull_requests": "number long, title string, body string, author string, merge_sha string, created_at timestamp, merged_at timestamp",
    "pull_request_reviews": "id long, pr_number long, author string, state string, body string, submitted_at timestamp",
    "commits": "sha string, message string, author string, committed_at timestamp",
    "commit_parents": "sha string, parent_sha string",
    "releases": "id long, tag string, notes string, published_at timestamp",
    "discussions": "number long, title string, body string, author string, created_at timestamp",
    "labels": "id long, name string",
    "people": "id long, login string, name string",
}


def read_registry(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the three core tables."""
    return spark.read.schema(REGISTRY[table]).parquet(f"{path}/{table}")


def read_registry_jdbc(spark: SparkSession, url: str, table: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """The same over JDBC, split by ranges of the id."""
    return spark.read.jdbc(url, table, column="id", lowerBound=low, upperBound=high, numPartitions=partitions, properties=options)


def read_source_tree(spark: SparkSession, path: str) -> DataFrame:
    """path, size and content of each file below ``path`` as text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("content").cast("string").alias("content"))


def read_artifacts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed JSON lines of one kind."""
    return spark.read.schema(ARTIFACTS[kind]).json(f"{path}/{kind}")


def parse_repo_payload(df: DataFrame, raw: str, out: str = "repo") -> DataFrame:
    """Adds the provider's repository answer as a struct, null unless all five fields are there (S2); numbers may be strings."""
    found = F.from_json(raw, "id string, name string, full_name string, default_branch string, private string")
    whole = found["id"].try_cast("long")
    flag = F.lower(found["private"]).try_cast("boolean")
    full = whole.isNotNull() & found["name"].isNotNull() & found["full_name"].isNotNull() & found["default_branch"].isNotNull() & flag.isNotNull()
    parsed = F.struct(whole.alias("id"), found["name"].alias("name"), found["full_name"].alias("full_name"), found["default_branch"].alias("default_branch"), flag.alias("private"))
    return df.withColumn(out, F.when(full, parsed))


def parse_commit_payload(df: DataFrame, raw: str, out: str = "commit") -> DataFrame:
    """Adds the provider's commit answer, null without a sha (S3)."""
    found = F.from_json(raw, "sha string")
    return df.withColumn(out, F.when(found["sha"].isNotNull(), found))


def append_registry(df: DataFrame, path: str, table: str) -> None:
    """Add accepted rows (S4); one writer per table keeps keys unique."""
    columns = [F.col(f.name).cast(f.dataType) for f in REGISTRY[table]]
    df.select(columns).write.mode("append").parquet(f"{path}/{table}")


def row_digest(schema: T.StructType) -> Column:
    """A number of a row's columns, maps aside."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in schema if "map<" not in f.dataType.simpleString()))


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, that of the highest version; of equal versions that of the largest digest, whatever the order of the rows."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc(row_digest(rows.schema))))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All rows of both, one per key, as ``newest`` has it (S7); repeating an upsert adds nothing. ``keyed`` does the same to a stored table."""
    return newest(target.unionByName(updates, allowMissingColumns=True), keys, version)


def publish_section(df: DataFrame, path: str) -> None:
    """Replace the partitions (snapshot_id, section_type) that ``df`` holds, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id", "section_type").parquet(path)


def write_rejects(df: DataFrame, path: str) -> None:
    """Refused requests with their reason."""
    df.where("reject_reason is not null").write.mode("append").parquet(path)


def with_versions(df: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Stamp versions of parser, ontology, algorithm, chunks or model on every row."""
    return df.withColumns({k: F.lit(v) for k, v in versions.items()})


def reuse_embeddings(chunks: DataFrame, embeddings: DataFrame, keys: tuple[str, ...] = ("content_hash", "model", "chunk_version")) -> tuple[DataFrame, DataFrame]:
    """(chunks with an embedding of the same content, model and chunk version; chunks to embed)."""
    have = embeddings.select(*keys).distinct()
    return chunks.join(have, list(keys), "left_semi"), chunks.join(have, list(keys), "left_anti")
