"""Exact deduplication by content sort.

Sampled splitters range-partition the texts by the normalised content, every partition is sorted externally by the whole
normalised text, so equal texts become neighbours, and a pass over the sorted rows compares whole neighbouring texts.
Splitters are drawn over (first characters, 64-bit digest of the whole normalised text, preference order), so a splitter is some
dozen bytes however long the texts are, and a large group of copies spans several partitions. Only a group that a splitter
cuts lies in two partitions; these groups are the last of one partition and the first of the next in the splitters' order,
and their parts are added up from one row for each partition and text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter as Tally
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACE_CLASS, surviving
from corvane.session import bound_batches, shuffle_partitions, written

#: Characters of the content in a splitter. They bound the sample that Spark draws for the splitters, and nothing else.
HEAD = 32
_COLUMNS = {"doc_id": pa.int64(), "n_points": pa.int64(), "text_key": pa.int64(), "text_sha256": pa.string(), "keep_id": pa.int64(), "group_size": pa.int64(), "kept": pa.bool_(), "twin": pa.bool_(), "head": pa.int64(), "whole": pa.int64(), "part": pa.int32(), "seq": pa.int64()}
_SCHEMA = ", ".join(f"{name} {'string' if kind == pa.string() else 'boolean' if kind == pa.bool_() else 'int' if kind == pa.int32() else 'long'}" for name, kind in _COLUMNS.items())


def normalised(text: Column) -> Column:
    """The text without blanks and U+0009 to U+000D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by text and preference to the same rows with what their run of equal texts decides.

    Of a run only numbers are held, 24 bytes a row, and a partition's rows bound them. An id that is null comes with a flag.
    """
    part, seq, start = TaskContext.get().partitionId(), 0, 0
    text, keys = None, (0, 0)
    ids, missing, points, text_keys, twin = array("q"), bytearray(), array("q"), array("q"), bytearray()
    runs: list[tuple] = []

    def close() -> None:
        nonlocal start
        n = len(ids) - start
        if n == 1:
            twin.append(0)
        elif n:
            rows = list(zip(ids[start:], missing[start:], text_keys[start:], strict=True))
            often = Tally(rows)
            twin.extend(often[x] > 1 for x in rows)
        if n:
            runs.append((hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), None if missing[start] else ids[start], n, *keys))
        start = len(ids)

    def closed() -> pa.RecordBatch:
        nonlocal seq, runs, start
        sha, keep, sizes, head, whole = zip(*runs, strict=True)
        of_run = pa.array(np.repeat(np.arange(len(runs)), sizes))
        first = np.zeros(start, bool)
        first[np.cumsum((0, *sizes[:-1]))] = True
        flags = lambda x: np.frombuffer(bytes(x[:start]), np.uint8).astype(bool)
        spread = lambda x, kind: pa.array(x, kind).take(of_run)
        values = {
            "doc_id": pa.array(np.array(ids[:start]), mask=flags(missing)),
            "n_points": pa.array(np.array(points[:start])),
            "text_key": pa.array(np.array(text_keys[:start])),
            "text_sha256": spread(sha, pa.string()),
            "keep_id": spread(keep, pa.int64()),
            "group_size": spread(sizes, pa.int64()),
            "kept": pa.array(first),
            "twin": pa.array(flags(twin)),
            "head": spread(head, pa.int64()),
            "whole": spread(whole, pa.int64()),
            "part": pa.array(np.full(start, part, np.int32)),
            "seq": pa.array(np.arange(seq, seq + start)),
        }
        seq += start
        for held in (ids, missing, points, text_keys, twin):
            del held[:start]
        runs, start = [], 0
        return pa.RecordBatch.from_arrays([values[c] for c in _COLUMNS], names=list(_COLUMNS))

    for batch in batches:
        for doc_id, n, key, head, whole, norm in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if norm != text:
                close()
                text, keys = norm, (head, whole)
            ids.append(doc_id or 0)
            missing.append(doc_id is None)
            points.append(n)
            text_keys.append(key)
        if runs:
            yield closed()
    close()
    if runs:
        yield closed()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_key and twin.

    Of texts that are equal once white space is deleted, the row with the most code points in the original text stays,
    then the smallest id (null after all others), then any one of identical rows. Null text counts as empty, and all
    empty texts form one group. ``keep_id`` is null if only rows with a null id are in the group. ``twin`` marks rows
    that may not be the only one with their id and text, ``text_key`` is a 64-bit digest of the original text. Other columns of ``docs`` are not read. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_points"), F.xxhash64(text_col).alias("text_key"), normalised(F.col(text_col)).alias("norm"))
    head, whole, better = F.substring("norm", 1, HEAD), F.xxhash64("norm"), [F.col("n_points").desc(), F.col("doc_id").asc_nulls_last()]
    spread = rows.repartitionByRange(partitions or shuffle_partitions(spark), head, whole, *better)
    ordered = spread.sortWithinPartitions("norm", *better).select("doc_id", "n_points", "text_key", F.xxhash64(head).alias("head"), whole.alias("whole"), "norm")
    found = written(ordered.mapInArrow(_runs, _SCHEMA))
    # the first and the last splitter key of each partition; a group that a splitter cuts has one of both kinds
    ends = written(found.groupBy("part").agg(F.min_by("head", "seq").alias("first_head"), F.max_by("head", "seq").alias("last_head")))
    near = found.join(F.broadcast(ends), "part")  # a row per partition
    keys = near.groupBy("part").agg(F.min_by(F.struct("head", "whole"), F.when(F.col("head") == F.col("first_head"), F.col("whole"))).alias("first"), F.max_by(F.struct("head", "whole"), F.when(F.col("head") == F.col("last_head"), F.col("whole"))).alias("last"))
    cut = keys.select(F.col("first").alias("k"), "part").unionByName(keys.select(F.col("last").alias("k"), "part")).groupBy("k.head", "k.whole").agg(F.count_distinct("part").alias("n")).where("n > 1")
    cut = written(cut.select("head", "whole"))
    rank = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("part").alias("d"), F.col("seq").alias("e"))
    parts = found.join(F.broadcast(cut), ["head", "whole"]).groupBy("text_sha256").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n_rows"))  # two keys per partition at most
    parts = written(parts)
    out = found.join(F.broadcast(parts), "text_sha256", "left")
    is_cut, mine = F.col("best").isNotNull(), rank == F.col("best")
    return out.select(
        "doc_id",
        F.when(is_cut, F.col("best.c")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n_rows", "group_size").alias("group_size"),
        F.when(is_cut, mine).otherwise(F.col("kept")).alias("kept"),
        "text_sha256",
        "text_key",
        F.when(is_cut, F.lit(True)).otherwise(F.col("twin")).alias("twin"),
    )


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns untouched; of rows with the same id and text one stays, the same in every run."""
    return surviving(docs, exact_duplicates(docs, id_col, text_col), id_col, text_col)
