"""The full transition grid, the order of the rules, and the stream against the batch."""

import datetime as dt
import itertools
import os

import pytest
from pyspark.sql import functions as F

from corvane.operators import jobs
from corvane.streaming import job_feed

STATES = ("pending", "queued", "running", "completed", "failed")
ALLOWED = {("pending", "queued"), ("pending", "running"), ("pending", "failed"), ("queued", "running"), ("queued", "failed"), ("running", "running"), ("running", "completed"), ("running", "failed")}
UPDATE = "job_id long, seq long, ts timestamp_ntz, status string, progress int, error_message string"
AT = dt.datetime(2024, 1, 1)


def test_transition_grid(spark):
    grid = list(enumerate(itertools.product(STATES, STATES)))
    start = spark.createDataFrame([(i, a, 50, True) for i, (a, _) in grid], "job_id long, status string, progress int, has_snapshot boolean")
    updates = spark.createDataFrame([(i, 1, AT, b, 100 if b == "completed" else 60, "e") for i, (_, b) in grid], UPDATE)
    _, seen = jobs.fold_job_updates(updates, start)
    reasons = {r.job_id: r.reject_reason for r in seen.collect()}
    for i, pair in grid:
        assert (reasons[i] is None) == (pair in ALLOWED), (pair, reasons[i])


@pytest.mark.parametrize(
    "status, progress, error, snapshot, reason",
    [
        ("running", 70, None, True, "progress_decreased"),
        ("running", 80, None, True, None),
        ("completed", 90, None, True, "completed_below_100"),
        ("failed", 90, None, True, "failed_without_error"),
        ("failed", 90, "", True, None),
        ("failed", 90, "x", False, "snapshot_missing"),
        ("running", 101, None, True, "progress_out_of_range"),
        ("running", 101, None, False, "snapshot_missing"),
    ],
)
def test_rules_in_order(spark, status, progress, error, snapshot, reason):
    start = spark.createDataFrame([(1, "running", 80, snapshot)], "job_id long, status string, progress int, has_snapshot boolean")
    final, seen = jobs.fold_job_updates(spark.createDataFrame([(1, 1, AT, status, progress, error)], UPDATE), start)
    assert seen.first().reject_reason == reason
    assert final.first().status == (status if reason is None else "running")


def test_unknown_jobs_and_jobs_without_updates(spark):
    start = spark.createDataFrame([(1, "pending", 0, True)], "job_id long, status string, progress int, has_snapshot boolean")
    final, seen = jobs.fold_job_updates(spark.createDataFrame([(2, 1, AT, "running", 10, None)], UPDATE), start)
    assert [(r.job_id, r.reject_reason) for r in seen.collect()] == [(2, "job_missing")]
    assert final.first().status == "pending"


def test_times_and_terminal_state(spark):
    t = [AT + dt.timedelta(minutes=i) for i in range(5)]
    rows = [(1, 1, t[0], "running", 10, None), (1, 2, t[1], "running", 20, None), (1, 3, t[2], "failed", 20, "x"), (1, 4, t[3], "running", 30, None), (2, 1, t[4], "failed", 0, "y")]
    start = spark.createDataFrame([(1, "pending", 0, True), (2, "pending", 0, True)], "job_id long, status string, progress int, has_snapshot boolean")
    final = {r.job_id: r for r in jobs.fold_job_updates(spark.createDataFrame(rows, UPDATE), start)[0].collect()}
    assert (final[1].started_at, final[1].completed_at, final[1].status, final[1].snapshot_status) == (t[0], t[2], "failed", "failed")
    assert final[2].started_at is None and final[2].completed_at == t[4]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(j, s, AT + dt.timedelta(seconds=s), ("running", "queued", "failed", "completed")[(j * s) % 4], 100 if (j * s) % 4 == 3 else (s * 7) % 100, "e" if s % 2 else None) for j in range(12) for s in range(1, 9)]
    updates = spark.createDataFrame(rows, UPDATE)
    updates.write.parquet(str(tmp_path / "feed"))
    start = updates.select("job_id").distinct().withColumns({"status": F.lit("pending"), "progress": F.lit(0), "has_snapshot": F.lit(True)})
    batch = {(r.job_id, r.status, r.progress, r.error_message) for r in jobs.fold_job_updates(updates, start)[0].collect()}
    seen = job_feed.run_available(job_feed.fold_stream(job_feed.read_updates(spark, str(tmp_path / "feed"))))
    assert {(r.job_id, r.status, r.progress, r.error_message) for r in seen.where("is_state").collect()} == batch


def test_stream_refuses_like_the_batch(spark, tmp_path):
    """Reasons of all refused updates, among them those of unknown jobs and of jobs without a snapshot; over several micro-batches."""
    rows = [(j, s, AT + dt.timedelta(seconds=s), ("running", "queued", "failed", "completed")[(j + s) % 4], 100 if (j + s) % 4 == 3 else (s * 37) % 130 - 5, "e" if s % 2 else None) for s in range(1, 13) for j in range(12)]
    updates = spark.createDataFrame(rows, UPDATE)
    start = spark.createDataFrame([(j, "pending", 0, j % 5 != 0) for j in range(10)], "job_id long, status string, progress int, has_snapshot boolean")
    final, outcomes = jobs.fold_job_updates(updates, start)
    for part in range(3):
        updates.where(f"seq > {4 * part} and seq <= {4 * part + 4}").coalesce(1).write.parquet(str(tmp_path / "one" / str(part)))
        (tmp_path / "feed").mkdir(exist_ok=True)
        source = next((tmp_path / "one" / str(part)).glob("*.parquet"))
        target = tmp_path / "feed" / f"{part}.parquet"
        target.write_bytes(source.read_bytes())
        os.utime(target, (1_000_000 + part, 1_000_000 + part))
    seen = job_feed.run_available(job_feed.fold_stream(job_feed.read_updates(spark, str(tmp_path / "feed"), 1), start))
    assert seen.select("_batch").distinct().count() == 3
    key = lambda df: sorted(((r.job_id, r.seq, str(r.reject_reason)) for r in df.collect()))
    assert key(seen.where("not is_state").select("job_id", "seq", "reject_reason")) == key(outcomes)
    last = {r.job_id: (r.status, r.progress, r.snapshot_status) for r in seen.where("is_state").orderBy("n_seen").collect()}
    assert last == {r.job_id: (r.status, r.progress, r.snapshot_status) for r in final.collect()}


def test_one_job_may_have_most_updates(spark):
    n = 30000
    updates = spark.range(n).select((F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id"))).cast("long").alias("job_id"), F.col("id").alias("seq"), F.lit(AT).cast("timestamp_ntz").alias("ts"), F.lit("running").alias("status"), F.least(F.floor(F.col("id") / 500), F.lit(99)).cast("int").alias("progress"), F.lit(None).cast("string").alias("error_message"))
    start = updates.select("job_id").distinct().withColumns({"status": F.lit("pending"), "progress": F.lit(0), "has_snapshot": F.lit(True)})
    final, outcomes = jobs.fold_job_updates(updates, start)
    assert outcomes.where("reject_reason is null").count() == n and final.where("job_id = 1").first().progress == 59


def test_retried_batches_add_nothing(spark, tmp_path):
    """A failed stage runs again, the stages before it stay, and a batch that is retried changes nothing."""
    frame = lambda rows: spark.createDataFrame(rows, "job_id long, stage int, status string, version long")
    base, keys = str(tmp_path / "t"), ["job_id", "stage"]
    job_feed.upsert_batch(frame([(1, 0, "completed", 1), (1, 1, "failed", 2)]), 0, base, keys, "version")
    for _ in range(2):
        out = job_feed.upsert_batch(frame([(1, 1, "completed", 3)]), 1, base, keys, "version")
        assert sorted(map(tuple, out.collect())) == [(1, 0, "completed", 1), (1, 1, "completed", 3)]


def test_repeated_artifacts_come_once(spark, tmp_path):
    """The provider sends an artifact again, in the same file and in a later one."""
    for part, ids in enumerate(([1, 2, 2], [2, 3], [1])):
        spark.createDataFrame([(i, AT + dt.timedelta(minutes=part)) for i in ids], "provider_id long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "feed" / f"p{part}.parquet"))
    stream = spark.readStream.schema("provider_id long, ts timestamp_ntz").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    out = job_feed.run_available(job_feed.distinct_within(stream, ["provider_id"], "ts", "1 hour"), "append")
    assert sorted(r.provider_id for r in out.collect()) == [1, 2, 3]
