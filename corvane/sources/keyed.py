"""Stored tables with one row per key, brought up to date bucket by bucket.

Rows lie in ``data/<folder>/__bucket=<n>`` by a hash of their key. ``manifest/version=<n>`` says which folder holds each bucket and
what the columns are; the newest one that is there is the table. An upsert writes the buckets that change into a new folder and
then the next manifest, a single file that Spark's committer puts in place at once. So a reader sees the table before or after,
never half of it; a write that is killed leaves the table as it was; and a write that is repeated finds its rows and changes nothing.
One writer at a time. Readers of an older manifest go on reading its files until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import free, written
from corvane.sources import load

_MANIFEST = "bucket int, folder string, buckets int, columns string"


def manifest(spark: SparkSession, path: str) -> tuple[int, list[Row]]:
    """(version, a row per bucket that has a folder) of the newest manifest; (0, []) where there is no table yet."""
    try:
        every = spark.read.schema(f"{_MANIFEST}, version int").option("basePath", f"{path}/manifest").parquet(f"{path}/manifest")
    except AnalysisException:
        return 0, []
    last = every.agg(F.max("version")).first()[0]
    return (last, sorted(every.where(F.col("version") == last).collect())) if last is not None else (0, [])


def _rows(spark: SparkSession, path: str, schema: T.StructType, parts: list[Row]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/{p.folder}/__bucket={p.bucket}" for p in parts))


def _optional(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _wider(stored: T.StructType, new: T.StructType) -> T.StructType:
    """The stored columns, then those that only the updates have."""
    return T.StructType([*stored, *(f for f in new if f.name not in stored.names)])


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def read(spark: SparkSession, path: str, wanted: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """The table as it is now; with ``wanted`` only its rows of these ``keys``, from the files of their buckets."""
    _, parts = manifest(spark, path)
    if not parts:
        raise ValueError(f"no table at {path}")
    schema = T.StructType.fromJson(json.loads(parts[0].columns))
    if wanted is None:
        return _rows(spark, path, schema, parts)
    asked = _typed(wanted, T.StructType([schema[k] for k in keys])).distinct()
    hit = {r[0] for r in asked.select(_bucket(keys, parts[0].buckets)).distinct().collect()}
    found = _rows(spark, path, schema, [p for p in parts if p.bucket in hit]).alias("t")
    return found.join(asked.alias("a"), _same(keys, "t", "a"), "left_semi")


def _same(keys: list[str], a: str, b: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return on


def upsert(updates: DataFrame, path: str, keys: list[str], version: str, buckets: int = 64, slices: int = 4) -> list[int]:
    """Put ``updates`` into the table at ``path``; returns the buckets that were rewritten.

    Of rows with one key that of the highest ``version`` stays, of equal versions that of the largest digest, as in
    ``load.upsert``. Updates that lose against the stored row, or are it, touch nothing; a bucket without a winning update keeps
    its files. Null keys equal each other. New columns are null in old rows, missing ones null in new rows, and updates take the stored
    types. The first call makes the table with ``buckets`` buckets, whose number then stays; each is written as ``slices`` files at most.
    An empty first call makes no table. Columns must not be called ``__bucket``, ``__digest``, ``__was``, ``__old`` or ``__held``. Only bucket numbers reach the driver.
    """
    spark = updates.sparkSession
    number, parts = manifest(spark, path)
    if parts:
        stored = T.StructType.fromJson(json.loads(parts[0].columns))
        buckets = parts[0].buckets
    else:
        stored = _optional(updates.schema)
    schema = _wider(stored, _optional(updates.schema))
    best = written(load.newest(_typed(updates, schema), keys, version).withColumns({"__digest": load.row_digest(schema), "__bucket": _bucket(keys, buckets)}))
    asked = {r[0] for r in best.select("__bucket").distinct().collect()}
    old = _rows(spark, path, schema, [p for p in parts if p.bucket in asked])
    held = old.select(*keys, F.col(version).alias("__was"), load.row_digest(schema).alias("__old"), F.lit(True).alias("__held")).alias("o")
    now, was = F.col(f"u.`{version}`"), F.col("__was")
    later = F.coalesce(now > was, now.isNotNull() & was.isNull()) | (now.eqNullSafe(was) & (F.col("__digest") > F.col("__old")))
    fresh = written(best.alias("u").join(held, _same(keys, "u", "o"), "left").where(F.col("__held").isNull() | later).select("u.*"))
    touched = sorted(r[0] for r in fresh.select("__bucket").distinct().collect())
    if touched:
        changed = set(touched)
        kept = _rows(spark, path, schema, [p for p in parts if p.bucket in changed]).alias("t").join(fresh.alias("f"), _same(keys, "t", "f"), "left_anti")
        rows = kept.withColumn("__bucket", _bucket(keys, buckets)).unionByName(fresh.drop("__digest"))
        folder = uuid.uuid4().hex
        slice_of = F.pmod(F.xxhash64(F.lit("slice"), *keys), F.lit(slices))
        rows.repartition("__bucket", slice_of).write.partitionBy("__bucket").parquet(f"{path}/data/{folder}")
        whole = [(p.bucket, p.folder) for p in parts if p.bucket not in changed] + [(b, folder) for b in touched]
        publish(spark, path, number + 1, [(b, f, buckets, schema.json()) for b, f in whole])
    free(best, fresh)
    return touched


def publish(spark: SparkSession, path: str, number: int, rows: list[tuple]) -> None:
    """Make the manifest ``number``, one file, the newest."""
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove data folders of which the newest manifest names no bucket, those of killed writes included; returns their names."""
    _, parts = manifest(spark, path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    idle = [s.getPath() for s in files.listStatus(place) if s.getPath().getName() not in {p.folder for p in parts}]
    for folder in idle:
        files.delete(folder, True)
    return sorted(p.getName() for p in idle)
