"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import written

#: The white space that separates words everywhere in this subpackage: blank and U+0009 to U+000D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
_U = np.uint64


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task (a memo or a decoded model); ``make`` builds it once."""
    held = sys.modules.setdefault("_corvane_worker", types.ModuleType("_corvane_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks_of_bytes(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``limit`` bytes in each range; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def surviving(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay by ``decisions`` (doc_id, text_key, kept, twin), all columns untouched.

    ``text_key`` is the text's xxhash64, so ids may be null or repeat. Of kept rows marked ``twin``, which may have equals in id
    and text, one of each stays: the one of the smallest digest of its other columns (maps aside). Where few rows go their table is
    small, and the texts stay where they are.
    """
    gone = written(decisions.where("not kept or twin").select(F.col("doc_id").alias("__corvane_id"), F.col("text_key").alias("__corvane_key"), F.col("kept").alias("__corvane_kept")))
    match = F.col(id_col).cast("long").eqNullSafe(F.col("__corvane_id")) & (F.xxhash64(text_col) == F.col("__corvane_key"))
    stay = docs.join(gone, match, "left_anti")
    twins = gone.where("__corvane_kept")
    if twins.isEmpty():
        return stay
    plain = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    row, order = F.struct(*map(F.col, docs.columns)), F.xxhash64(*plain)
    again = docs.join(twins, match, "left_semi").groupBy(F.col(id_col).alias("__corvane_id"), F.xxhash64(text_col).alias("__corvane_key")).agg(F.min_by(row, order).alias("__corvane_row"))
    return stay.unionByName(again.select("__corvane_row.*"))
