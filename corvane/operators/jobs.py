"""The job state machine over update tables (X1, X2, J4) and the stage feed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import written

# Allowed transitions, snapshot status of each job status, pipeline stages and the repository states that they stand for.
ALLOWED = ("pending>queued", "pending>running", "pending>failed", "queued>running", "queued>failed", "running>running", "running>completed", "running>failed")
SNAPSHOT_STATUS = {"pending": "pending", "queued": "pending", "running": "pending", "completed": "ready", "failed": "failed"}
STAGES = 14
STATE_OF_STAGE = ("validating", "queued", "ingesting", "ingesting", "ingesting", "ingesting", "analyzing", "analyzing", "analyzing", "analyzing", "generating", "generating", "generating", "generating")


def snapshot_status(status: Column) -> Column:
    """F1."""
    return F.create_map(*(F.lit(x) for pair in SNAPSHOT_STATUS.items() for x in pair))[status]


def reject_reason(state: list, has_snapshot: bool | None, status: str | None, progress: int | None, error: str | None) -> str | None:
    """Why an update is refused in a state (status, progress, ...), null if it is accepted; the first rule that fails counts."""
    if f"{state[0]}>{status}" not in ALLOWED:
        return "transition"
    if progress is not None and state[1] is not None and progress < state[1]:
        return "progress_decreased"
    if status == "completed" and progress is not None and progress != 100:
        return "completed_below_100"
    if status == "failed" and error is None:
        return "failed_without_error"
    if not has_snapshot:
        return "snapshot_missing"
    return "progress_out_of_range" if progress is not None and not 0 <= progress <= 100 else None


def apply_update(state: list, has_snapshot: bool | None, at: object, status: str | None, progress: int | None, error: str | None) -> str | None:
    """Change ``state`` (status, progress, error, started, completed) by an update, or say why not."""
    reason = reject_reason(state, has_snapshot, status, progress, error)
    if reason is None:
        state[:3] = status, progress, error
        if status == "running" and state[3] is None:
            state[3] = at
        if status in ("completed", "failed"):
            state[4] = at
    return reason


def _folder(names: list[str]):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, known, state, has_snapshot = None, False, [], None

        def final() -> tuple:
            return (job, None, None, True, *state, has_snapshot)

        for batch in batches:
            time = batch.schema.field("ts").type
            columns = [batch.column(c).cast(pa.int64()) if c == "ts" else batch.column(c) for c in ("job_id", "is_update", "seq", "ts", "status", "progress", "error_message", "has_snapshot")]
            out = []
            for job_id, is_update, seq, at, status, progress, error, snapshot in zip(*(c.to_pylist() for c in columns), strict=True):
                if job_id != job:
                    if known:
                        out.append(final())
                    job, known = job_id, False
                if not is_update:
                    known, state, has_snapshot = True, [status, progress, None, None, None], snapshot
                else:
                    reason = apply_update(state, has_snapshot, at, status, progress, error) if known else "job_missing"
                    out.append((job, seq, reason, False, None, None, None, None, None, None))
            if out:
                yield _rows(out, names, columns, time)
        if known:
            yield _rows([final()], names, columns, time)

    return fold


def _rows(out: list[tuple], names: list[str], columns: list[pa.Array], time: pa.DataType) -> pa.RecordBatch:
    kinds = [columns[0].type, columns[2].type, pa.string(), pa.bool_(), pa.string(), columns[5].type, pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    values = [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)]
    values[7:9] = [v.cast(time) for v in values[7:9]]
    return pa.RecordBatch.from_arrays(values, names=names)


def fold_job_updates(updates: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final jobs, outcomes of all updates) after folding the updates (job_id, seq, ts, status, progress, error_message).

    ``jobs`` has job_id, status, progress and has_snapshot, a row per job. Updates are judged in ``seq`` order, each against the state
    that the accepted ones before it left; a refused one changes nothing. Final jobs keep their start state if nothing was
    accepted. Outcomes have job_id, seq and reject_reason (null: accepted; ``job_missing`` without a job). Jobs and updates are
    shuffled once, together, and sorted by job; the fold holds one job's state at a time, so a job may have any number of updates.
    """
    start = jobs.select("job_id", F.lit(False).alias("is_update"), F.lit(None).cast(updates.schema["seq"].dataType).alias("seq"), F.lit(None).cast(updates.schema["ts"].dataType).alias("ts"), "status", F.col("progress").cast(updates.schema["progress"].dataType).alias("progress"), F.lit(None).cast("string").alias("error_message"), "has_snapshot")
    feed = updates.select("job_id", F.lit(True).alias("is_update"), "seq", "ts", "status", "progress", "error_message", F.lit(None).cast("boolean").alias("has_snapshot"))
    rows = start.unionByName(feed).where("job_id is not null").repartition("job_id").sortWithinPartitions("job_id", "is_update", "seq", "ts", "status", "progress", "error_message")
    kind = lambda c: updates.schema[c].dataType.simpleString()
    schema = {"job_id": kind("job_id"), "seq": kind("seq"), "reject_reason": "string", "is_final": "boolean", "status": "string", "progress": kind("progress"), "error_message": "string", "started_at": kind("ts"), "completed_at": kind("ts"), "has_snapshot": "boolean"}
    folded = written(rows.mapInArrow(_folder(list(schema)), ", ".join(f"{c} {k}" for c, k in schema.items())))
    final = folded.where("is_final").select("job_id", "status", "progress", "error_message", "started_at", "completed_at", "has_snapshot")
    final = final.withColumn("snapshot_status", F.when(F.col("has_snapshot"), snapshot_status(F.col("status"))))
    nobody = updates.where("job_id is null").select("job_id", "seq", F.lit("job_missing").alias("reject_reason"))
    return final, folded.where("not is_final").select("job_id", "seq", "reject_reason").unionByName(nobody)


def run_template(jobs: DataFrame) -> DataFrame:
    """The updates that one run of each job emits (X2): running at 10, then completed at 100, or failed at 10 with the error.

    ``jobs`` has job_id, ts and error (null: the run succeeds).
    """
    failed = F.col("error").isNotNull()
    first = F.struct(F.lit(1).cast("long").alias("seq"), "ts", F.lit("running").alias("status"), F.lit(10).alias("progress"), F.lit(None).cast("string").alias("error_message"))
    last = F.struct(F.lit(2).cast("long").alias("seq"), "ts", F.when(failed, "failed").otherwise("completed").alias("status"), F.when(failed, 10).otherwise(100).alias("progress"), F.col("error").alias("error_message"))
    return jobs.select("job_id", F.inline(F.array(first, last)))


def propagate_status(jobs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots with the status that their job implies (J4); the latest job counts, snapshots without one keep theirs."""
    last = jobs.groupBy("snapshot_id").agg(F.max_by("status", "id").alias("job_status"))
    out = snapshots.join(last.withColumnRenamed("snapshot_id", "id"), "id", "left")
    return out.withColumn("status", F.coalesce(snapshot_status(F.col("job_status")), "status")).drop("job_status")


def stage_progress(events: DataFrame) -> DataFrame:
    """Per job and stage: last status, events, starts after a failure (attempts), first and last time, cost."""
    by = Window.partitionBy("job_id", "stage").orderBy("ts", "status", "cost")
    seen = events.withColumn("retry", (F.lag("status").over(by) == "failed").cast("int"))
    order = F.struct("ts", "status", "cost")
    return seen.groupBy("job_id", "stage").agg(F.max_by("status", order).alias("status"), F.count(F.lit(1)).alias("n_events"), (F.coalesce(F.sum("retry"), F.lit(0)) + 1).alias("attempts"), F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.round(F.sum("cost"), 4).alias("cost"))


def job_progress(stages: DataFrame) -> DataFrame:
    """Per job: percentage, current stage, outcome (complete, failed, partial, running) and repository state."""
    done, broken = F.col("status") == "completed", F.col("status") == "failed"
    out = stages.groupBy("job_id").agg(F.count_if(done).alias("n_completed"), F.count_if(broken).alias("n_failed"), F.count(F.lit(1)).alias("n_stages"), F.max("stage").alias("current_stage"))
    finished = F.col("n_completed") + F.col("n_failed") == STAGES
    outcome = F.when(F.col("n_completed") == STAGES, "complete").when(finished & (F.col("n_completed") == 0), "failed").when((F.col("n_failed") > 0) & (F.col("n_completed") > 0), "partial").otherwise("running")
    out = out.withColumns({"percent": F.floor(F.col("n_completed") * 100 / STAGES), "outcome": outcome})
    state = F.when(F.col("outcome") == "complete", "ready").when(F.col("outcome").isin("failed", "partial"), F.col("outcome")).otherwise(F.get(F.array(*map(F.lit, STATE_OF_STAGE)), F.col("current_stage")))
    return out.withColumn("repository_state", state)


def stage_report(events: DataFrame) -> DataFrame:
    """Per stage: events, failure rate, median and total cost."""
    return events.groupBy("stage").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg((F.col("status") == "failed").cast("double")), 6).alias("failure_rate"), F.round(F.percentile("cost", F.lit(0.5)), 6).alias("median_cost"), F.round(F.sum("cost"), 4).alias("total_cost"))


def active_job_guard(jobs: DataFrame) -> DataFrame:
    """Active jobs (pending, queued, running) of repositories that have several, with the one that stays."""
    active = jobs.where(F.col("status").isin("pending", "queued", "running"))
    own = Window.partitionBy("repository_id")
    ranked = active.withColumns({"n_active": F.count(F.lit(1)).over(own), "place": F.row_number().over(own.orderBy("created_at", "id"))})
    return ranked.where("n_active > 1").select("repository_id", "id", "n_active", (F.col("place") == 1).alias("stays"))
