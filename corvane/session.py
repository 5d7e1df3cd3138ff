"""Session helpers: shared scratch tables that survive the loss of an executor."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share, ``spark.checkpoint.dir``; in local mode, where one machine is all nodes, one is made if none is named."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, but leaves a columnar, compressed, splittable copy whose size the
    planner knows, so a small one is broadcast and a large one is not. ``instead_of`` is a written table that nothing
    reads once this one is there; its files are removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    if instead_of is not None:
        free(instead_of)
    return out


def free(*tables: DataFrame) -> None:
    """Remove the files of written tables; frames that are none, or that are derived from one, are left alone."""
    for df in tables:
        path = getattr(df, "_corvane_path", None)
        if path:
            place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            df._corvane_path = None


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bounds the rows of an Arrow batch for jobs that run inside, where rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts may be long: from now on Arrow batches of this session have ``rows`` rows at most, unless it set a number itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
