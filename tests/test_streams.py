"""Streams of progress and of weekly counts over files in any order, against the batch operators."""

import datetime as dt
import random

from corvane.operators import infer, jobs
from corvane.streaming import job_feed

START = dt.datetime(2024, 1, 1)
STAGES = "job_id long, stage int, ts timestamp_ntz, status string, cost double"
EVENTS = "event_ts timestamp_ntz, event_type string"


def landed(spark, folder, batches, schema):
    """A stream that takes one batch after another."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{n}.parquet")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_stages_in_any_order_over_batches(spark, tmp_path):
    rng = random.Random(8)
    events = [(rng.randrange(3), rng.randrange(3), START + dt.timedelta(minutes=rng.randrange(60)), rng.choice(["running", "failed", "completed", None]), float(rng.randrange(8))) for _ in range(150)]
    stream = landed(spark, str(tmp_path / "feed"), [events[:60], events[60:61], events[61:]], STAGES)
    got = job_feed.latest(job_feed.stage_feed(stream), ["job_id", "stage"], "n_events")
    want = jobs.stage_progress(spark.createDataFrame(events, STAGES))
    assert rows(got) == rows(want)
    assert rows(jobs.job_progress(got)) == rows(jobs.job_progress(want))


def test_weeks_begin_on_monday_and_late_rows_count_without_a_delay(spark, tmp_path):
    day = lambda n: START + dt.timedelta(days=n, seconds=-1 if n % 7 == 0 else 5)
    batches = [[(day(n), "a") for n in range(0, 30)], [(day(n), "b") for n in range(60, 90)], [(day(1), "a"), (day(85), "b")]]
    stream = landed(spark, str(tmp_path / "feed"), batches, EVENTS)
    got = job_feed.latest(job_feed.weekly(stream), ["week", "event_type"], "n")
    want = infer.per_period(spark.createDataFrame([r for b in batches for r in b], EVENTS), "week")
    assert rows(got) == rows(want)
    assert all(r.week.weekday() == 0 for r in got.collect())


def test_a_delay_closes_windows(spark, tmp_path):
    day = lambda n: START + dt.timedelta(days=n, hours=1)
    batches = [[(day(1), "a")], [(day(80), "a")], [(day(79), "a")], [(day(2), "a"), (day(78), "a")]]
    stream = landed(spark, str(tmp_path / "feed"), batches, EVENTS)
    got = {r.week: r.n for r in job_feed.latest(job_feed.weekly(stream, "14 days"), ["week", "event_type"], "n").collect()}
    assert got == {START: 1, START + dt.timedelta(days=77): 3}
