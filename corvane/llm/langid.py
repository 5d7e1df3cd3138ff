"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: slot ``i`` holds a bit mask with one bit for each language, so one
look-up per hash function, joined by AND, gives the languages that contain an n-gram. Per-language popcounts over a
whole text, corrected for each filter's rate of false positives, decide.

``learn`` counts n-grams over about ``max_docs`` labelled rows of each language at most (a documented bound on the sample
that the model is fitted on, chosen by a hash of the id); every labelled language is learned. ``predict`` reads whole texts
of every row.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import kept_in_worker, mix64
from corvane.session import bound_batches, written

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
_U = np.uint64
#: Characters that are worked on at once; a longer text's n-grams come in several lots.
PIECE = 1 << 19
#: Slots of a filter for each n-gram of the language that has most of them, at least.
ROOM = 8


@dataclass(frozen=True)
class Model:
    """``slices``: one row of 64-bit words per slot, one bit per language; ``false_rate``: per language."""

    languages: tuple[str, ...]
    slices: np.ndarray
    false_rate: np.ndarray
    order: int
    hashes: int


def _is_letter() -> np.ndarray:
    """Letters, and the marks that are written with them."""
    return np.fromiter((chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)


def _clean(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased letters, every run of other characters as one blank, and the text that each belongs to.

    A blank stands at both ends and between texts.
    """
    letter = kept_in_worker("letters", _is_letter)
    joined, codes, owners, at, blank_before = "\0".join(t.replace("\0", " ") for t in texts).lower(), [], [], 0, True
    for i in range(0, len(joined), PIECE):
        raw = np.frombuffer(joined[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(raw == 0)
        of = at + ends - (raw == 0)
        at += int(ends[-1])
        kept = np.where(letter[raw], raw, 32).astype(np.uint32)
        blank = kept == 32
        keep = ~(blank & np.append(blank_before, blank[:-1]))
        blank_before = bool(blank[-1])
        codes.append(kept[keep])
        owners.append(of[keep])
    clean, of = np.concatenate([[32], *codes]).astype(np.uint32), np.concatenate([[0], *owners]).astype(np.int64)
    if clean[-1] != 32:
        clean, of = np.append(clean, np.uint32(32)), np.append(of, of[-1])
    return clean, of


def grams(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all n-grams in lots, with where each text's n-grams start in the lot (one more than texts).

    Words and parts of words alike give n-grams, but none crosses a blank other than at its ends.
    """
    clean, of = _clean(texts)
    blank = clean == 32
    for i in range(0, len(clean) - order + 1, PIECE):
        n = min(PIECE, len(clean) - order + 1 - i)
        code, inner = np.zeros(n, _U), np.zeros(n, bool)
        for k in range(order):
            code = code * _U(0x110001) + clean[i + k : i + k + n]
            if 0 < k < order - 1:
                inner |= blank[i + k : i + k + n]
        good = ~inner
        yield mix64(code[good]), np.searchsorted(of[i + 1 : i + 1 + n][good], np.arange(len(texts) + 1))


def _pieces(texts: list[str], order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, hashes, starts) for lots of texts of about PIECE characters; a longer text comes alone, in several lots."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        for hashed, starts in grams(texts[at:end], order):
            yield at, end, hashed, starts
        at = end


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for _, _, hashed, _ in _pieces([t for t, own in zip(texts, langs, strict=True) if own == lang], order):
                    values, counts = np.unique(hashed, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    return count


def slots_of(hashed: np.ndarray, hashes: int, size: int) -> list[np.ndarray]:
    step = (hashed >> _U(32)) | _U(1)
    return [((hashed + _U(k) * step) & _U(size - 1)).astype(np.int64) for k in range(hashes)]


def _marker(languages: tuple[str, ...], hashes: int, size: int):
    place = {lang: i for i, lang in enumerate(languages)}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for slot in slots_of(batch.column(1).to_numpy().view(_U), hashes, size):
                bit = (_U(1) << (number % 64).astype(_U)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(number // 64), pa.array(bit)], names=["slot", "word", "bit"])

    return mark


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", order: int = 4, hashes: int = 2, slots: int = 1 << 20, max_docs: int = 2000) -> Model:
    """Fit the filters on about ``max_docs`` rows of each language at most, chosen by a hash of id and text; all their n-grams count.

    A row that repeats is one row, and each language has the row of its smallest hash, so none is lost and a sample is bounded
    whatever ids look like (null ones, too). Rows with a null text or a null label are left out; with no rows left the model knows
    no language. ``slots`` is a power of two, and is doubled until the largest filter has ROOM slots for each n-gram: the sample
    bounds the model. Masks are put together by a grouped aggregation, so the driver gets the slots that are set and the names
    of the languages.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("language sample"), id_col, text_col).alias("h"))
    place = F.col("h").bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    sizes = written(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n_rows"), F.min(F.struct(place.alias("p"), F.col("h").alias("h")))["h"].alias("least")))  # a row for each language
    sample = rows.join(sizes, "lang").where((place * F.col("n_rows") < max_docs) | (F.col("h") == F.col("least"))).dropDuplicates(["lang", "h"]).select("lang", "text")
    counted = written(sample.mapInArrow(_counter(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    known = counted.select("lang", "gram")
    each = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    languages = tuple(sorted(each))
    while slots < ROOM * max(each.values(), default=0):
        slots *= 2
    slices = np.zeros((slots, max(1, math.ceil(len(languages) / 64))), _U)
    if languages:
        marks = known.mapInArrow(_marker(languages, hashes, slots), "slot long, word long, bit long").groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
        slices[marks.column(0).to_numpy(), marks.column(1).to_numpy()] = marks.column(2).to_numpy().view(_U)
    used = [np.count_nonzero(slices[:, i // 64] >> _U(i % 64) & _U(1)) for i in range(len(languages))]
    return Model(languages, slices, (np.array(used, float) / slots) ** hashes, order, hashes)


def corrected_counts(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text and language the n-grams that the language contains, without expected false positives; all n-grams."""
    found, total = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for first, last, hashed, starts in _pieces(texts, model.order):
        masks = None
        for slot in slots_of(hashed, model.hashes, len(model.slices)):
            masks = model.slices[slot] if masks is None else masks & model.slices[slot]
        total[first:last] += np.diff(starts)
        for i in range(len(model.languages)):
            ones = np.append(0, np.cumsum((masks[:, i // 64] >> _U(i % 64)) & _U(1)).astype(np.int64))
            found[first:last, i] += np.diff(ones[starts])
    return np.clip((found - total[:, None] * model.false_rate) / (1 - model.false_rate), 0, None), total


def _predictor(model_of):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if model.languages and texts:
                counts, total = corrected_counts(model, texts)
                best = counts.argmax(axis=1)
                langs = [model.languages[i] for i in best]
                scores = np.minimum(counts[np.arange(len(best)), best] / np.maximum(total, 1), 1.0)
            lettered = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x if y else UNDETERMINED for x, y in zip(langs, lettered, strict=True)], pa.string()), pa.array(np.where(lettered, scores, 0.0))], names=["doc_id", "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row of ``docs``; only the text is looked at.

    ``score`` is the share of the text's n-grams that the chosen language contains, false positives taken off. Ties go
    to the smaller name. ``und`` with score 0 stands for a null text, a text without a letter, or a model without
    languages. Repeated rows and null ids are answered like any others.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x 8 bytes for each 64 languages
    lettered = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), lettered.alias("lettered"))
    return rows.mapInArrow(_predictor(shared), "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Every fourth row by a checksum of its id; a null id is in neither part."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def accepted(docs: DataFrame, model: Model, min_score: float, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a letter and a score of at least ``min_score``, all columns untouched; no shuffle.

    What can't be judged stays, if it has a letter: texts of so few n-grams that ``min_score`` is less than one of them, and
    texts labelled with a language that the model does not know. A model without languages accepts nothing. Null and empty
    texts go, a null label is no label, and repeated rows and null ids are judged like any others; ids are not read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, label = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = {None, *own.languages}
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = np.zeros(len(texts), bool)
            if own.languages and texts:
                counts, total = corrected_counts(own, texts)
                unknown = np.array([x not in known for x in batch.column(label).to_pylist()])
                keep = np.array([LETTER.search(t) is not None for t in texts]) & ((counts.max(axis=1) >= min_score * total) | (min_score * total < 1) | unknown)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then give doc_id, lang_pred, score and held_out of every row."""
    model = learn(docs.where(~held_out()))
    return predict(docs, model).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
