"""Job updates as a stream: the same state machine, one small state per job (X1, S9), stage retries (X7) and artifact dedup."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.jobs import SNAPSHOT_STATUS, apply_update
from corvane.session import shared_dir
from corvane.sources import keyed

_OUT = "job_id long, seq long, reject_reason string, is_state boolean, n_seen long, n_accepted long, status string, progress int, error_message string, started_at timestamp, completed_at timestamp, snapshot_status string"
_STATE = "n_seen long, n_accepted long, status string, progress int, error_message string, started_at timestamp, completed_at timestamp"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _plain(values: pd.Series) -> list:
    return values.astype(object).where(values.notna(), None).tolist()


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The outcomes of a job's updates of one micro-batch, and then its state; a job that isn't known has outcomes only."""
    rows = pd.concat(list(frames)).sort_values("seq")
    known, has_snapshot = bool(rows["known"].iloc[0]), bool(rows["has_snapshot"].iloc[0])
    seen, accepted, *now = state.get if state.exists else (0, 0, rows["start_status"].iloc[0], rows["start_progress"].iloc[0], None, None, None)
    now[1] = None if pd.isna(now[1]) else int(now[1])
    out = []
    for seq, at, status, progress, error in zip(*(_plain(rows[c]) for c in ("seq", "ts", "status", "progress", "error_message")), strict=True):
        reason = apply_update(now, has_snapshot, at, status, None if progress is None else int(progress), error) if known else "job_missing"
        accepted += reason is None
        out.append((key[0], seq, reason, False, *[None] * 8))
    if known:
        seen += len(out)
        state.update((seen, accepted, *now))
        out.append((key[0], None, None, True, seen, accepted, *now, SNAPSHOT_STATUS.get(now[0]) if has_snapshot else None))
    yield pd.DataFrame(out, columns=_NAMES)


def fold_stream(updates: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """A streaming frame of (job_id, seq, ts, status, progress, error_message) to the outcomes of its updates and the states of their jobs.

    Rows with ``is_state`` are states, the others have the seq and the reject_reason of an update (null: accepted). ``jobs`` (job_id,
    status, progress, has_snapshot) is a table that each micro-batch reads; without it every job starts as (pending, 0) with its
    snapshot in place. Within a micro-batch a job's updates are sorted by ``seq``; between batches the source keeps their
    order. A job's updates of one micro-batch are in memory together, so the source's files per batch bound them.
    """
    start = {"start_status": F.lit("pending"), "start_progress": F.lit(0), "has_snapshot": F.lit(True), "known": F.lit(True)}
    if jobs is None:
        rows = updates.withColumns(start)
    else:
        table = jobs.select("job_id", F.col("status").alias("start_status"), F.col("progress").alias("start_progress"), "has_snapshot", F.lit(True).alias("known"))
        rows = updates.join(table, "job_id", "left").withColumns({"known": F.coalesce("known", F.lit(False)), "has_snapshot": F.coalesce("has_snapshot", F.lit(False))})
    typed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return typed.groupBy("job_id").applyInPandasWithState(_fold, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def _run(stream: DataFrame, mode: str, base: str, sink) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def run_available(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Run a stream over what is there, and return all rows that it emitted; a batch that is run again replaces its rows."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/corvane-stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/part={number}")

    _run(stream, mode, base, sink)
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out")


def upsert_batch(batch: DataFrame, number: int, base: str, keys: list[str], version: str) -> DataFrame:
    """The table below ``base`` with the rows of batch ``number`` put in.

    Only buckets with a row that wins are rewritten. A retried batch finds its own rows there and changes nothing, and rows of
    other keys (the stages before a failed one) stay.
    """
    spark = batch.sparkSession
    keyed.upsert(batch, f"{base}/table", keys, version)
    return keyed.read(spark, f"{base}/table") if keyed.manifest(spark, f"{base}/table")[1] else batch.limit(0)


def upserted(stream: DataFrame, keys: list[str], version: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a table with one row per key, that of the highest version."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/corvane-stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        upsert_batch(batch, number, base, keys, version)

    _run(stream, mode, base, sink)
    return keyed.read(spark, f"{base}/table") if keyed.manifest(spark, f"{base}/table")[1] else spark.createDataFrame([], stream.schema)


def stage_feed(events: DataFrame) -> DataFrame:
    """The rows of ``jobs.stage_progress`` as a stream in update mode (X4): a row of each job and stage that a micro-batch touches.

    Every column is a sum, a count or an extreme, so updates may come in any order over any batches. Attempts are starts after a
    failure: all failures but the one that is the latest event. State is a row for each job and stage, as the result is.
    """
    order = F.struct("ts", "status", "cost")
    last = F.max_by("status", order)
    retries = F.count_if(F.col("status") == "failed") - F.coalesce((last == "failed").cast("int"), F.lit(0))
    return events.groupBy("job_id", "stage").agg(last.alias("status"), F.count(F.lit(1)).alias("n_events"), (retries + 1).alias("attempts"), F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.round(F.sum("cost"), 4).alias("cost"))


def weekly(events: DataFrame, delay: str | None = None) -> DataFrame:
    """The rows of ``infer.per_period`` by week as a stream (A10): event-time windows from Monday, in the clock of ``event_ts``.

    With ``delay``, once a micro-batch has seen an event ``delay`` past a window's end, the next one drops the window's state, and
    from the one after that on rows of the window are left out; without, rows count however late they are, and state is a row for each week and type.
    """
    zone = F.current_timezone()
    rows = events.withColumn("at", F.from_utc_timestamp(F.col("event_ts").cast("timestamp"), zone))
    rows = rows.withWatermark("at", delay) if delay else rows
    counts = rows.groupBy(F.window("at", "7 days", startTime="4 days").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_utc_timestamp(F.col("w.start"), zone).cast("timestamp_ntz").alias("week"), "event_type", "n")


def latest(stream: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Run an aggregation in update mode over what is there; of each key the row of the highest ``version``, which only grows.

    Rows go into a table by key, so a batch that is run again changes nothing and a batch rewrites only buckets that it touches.
    """
    return upserted(stream, keys, version, "update")


def distinct_within(stream: DataFrame, keys: list[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """Provider events once each (X8): repeats of a key within the watermark are dropped."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file systems hold one file at ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()


def read_updates(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over landed Parquet files of events (S9), ``files_per_batch`` at most in a micro-batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return source.option("pathGlobFilter", name).parquet(folder) if is_file(spark, path) else source.parquet(path)
