"""N-gram Jaccard join by universe partition and pigeonhole.

A text's set holds its distinct word shingles, as 64-bit digests. Sets are put into size bands so narrow that a similar
pair lies in one band or in two neighbouring ones. For each band the universe of shingles is hashed into segments. If
two sets differ in at most H shingles, and segment ``j`` counts ``v(j)`` with a total over H, then some segment differs in
fewer than ``v(j)`` shingles: ``v = 1`` segments must agree exactly, ``v = 2`` segments up to one shingle, which the
one-deletion neighbourhoods of both sides find. ``allocation`` picks the number of segments of each kind by cost, with
some credit to spare. Segments whose lists turn out heavy get ``v = 0`` for every set whose credit on other segments
suffices; only sets that cannot spare them (members of large groups of near copies) are looked up there.

Within a list every set is paired with the list's smallest member only, so a group of copies costs as many pairs as it
has members. Pairs are pruned by a parity sketch, whose Hamming distance never exceeds the real difference, and verified
exactly on whole sets. Sets of one list that ended in different components are then compared with each other, so no
link between components is missed; links inside a component add nothing to it and aren't enumerated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import chunks_of_bytes, mix64, surviving
from corvane.operators.components import connected_components
from corvane.session import arrow_rows, bound_batches, free, shuffle_partitions, written

#: Lists with more sets than this are heavy.
HEAVY = 32
#: Bytes of text that are worked on at once, and rows of pairs that are gathered before repeats are dropped.
CHUNK, GATHER = 1 << 20, 1 << 19
SKETCH_WORDS = 8
#: What a false candidate costs against one posting, in the choice of an allocation.
_CANDIDATE_COST = 20.0
_U = np.uint64
_LIMIT = 1 << 31
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@dataclass(frozen=True)
class Bands:
    """Per band: largest size, segments, how many of them count twice, total credit less the band's H."""

    percent: int
    high: np.ndarray
    segments: np.ndarray
    double: np.ndarray
    spare: np.ndarray

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, sizes)

    def most_different(self, sizes: np.ndarray) -> np.ndarray:
        """The most shingles by which a set and a similar one that is no smaller differ."""
        return (sizes + 100 * sizes // self.percent) * (100 - self.percent) // (100 + self.percent)


def allocation(size: float, different: int) -> tuple[int, int, int]:
    """(segments, double segments, credit over ``different``) with the least expected cost for sets of about ``size``.

    A segment costs a posting, a double one also a posting for each of its shingles, and short segments bring false
    candidates.
    """
    credit = different + 1 + max(1, different // 16)
    segments = np.unique(np.linspace((credit + 1) // 2, credit, 256).astype(np.int64))
    double = credit - segments
    length = size / segments
    cost = segments + double * length + _CANDIDATE_COST * segments * np.exp(-length)
    best = int(cost.argmin())
    return int(segments[best]), int(double[best]), credit - different


@cache
def bands(percent: int) -> Bands:
    high, rows, low = [], [], 1
    while low < _LIMIT:
        top = max(low, 100 * low // percent)
        different = (top + 100 * top // percent) * (100 - percent) // (100 + percent)
        rows.append(allocation((low * top) ** 0.5, different) if different else (0, 0, 0))
        high.append(top)
        low = top + 1
    return Bands(percent, np.array(high), *np.array(rows).T)


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all texts, one text after another, and where each text's begin.

    A text with fewer words than ``words`` has its whole sequence as its one shingle; one without words has none.
    """
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, _U), np.zeros(len(texts) + 1, np.int64)
    letters = data[solid].astype(_U)
    begin = np.append(np.flatnonzero(first[solid]), len(letters))
    lengths = np.diff(begin)
    place = np.arange(len(letters)) - np.repeat(begin[:-1], lengths)
    factor = mix64(np.arange(1, int(lengths.max()) + 1, dtype=_U)) | _U(1)
    word = mix64(np.add.reduceat((letters + _U(1)) * factor[place], begin[:-1]) + lengths.astype(_U) * _U(0x9E3779B97F4A7C15))
    word_of = np.searchsorted(at, starts)  # index of each text's first word
    n_words = np.diff(word_of)
    n = len(word) - words + 1
    acc = np.zeros(max(n, 0), _U)
    for k in range(words if n > 0 else 0):
        acc = mix64(acc * _U(0xD6E8FEB86659FD93) + word[k : k + n])
    count = np.maximum(n_words - words + 1, 0)
    total = np.where(n_words > 0, np.maximum(count, 1), 0)
    offsets = np.append(0, np.cumsum(total))
    out = np.empty(offsets[-1], _U)
    for i in np.flatnonzero(total).tolist():
        a, b, w = offsets[i], offsets[i + 1], word_of[i]
        if count[i]:
            out[a:b] = acc[w : w + count[i]]
            out[a:b].sort()
        else:
            value = np.full(1, n_words[i], _U)
            for x in word[w : w + n_words[i]]:
                value = mix64(value * _U(0xA0761D6478BD642F) + x)
            out[a] = value[0]
    owner = np.repeat(np.arange(len(texts)), total)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], np.searchsorted(owner[keep], np.arange(len(texts) + 1))


def _sets(batches: Iterator[pa.RecordBatch], column: int, words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of each batch by chunks, with their shingles."""
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch.column(column).to_pylist()]
        for a, b in chunks_of_bytes(texts, CHUNK):
            yield batch.slice(a, b - a), *shingles(texts[a:b], words)


def fingerprints(values: np.ndarray, starts: np.ndarray, salt: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """One 64-bit number for each set, 0 for an empty one; equal sets have equal numbers."""
    sizes = np.diff(starts)
    out, full = np.zeros(len(sizes), _U), sizes > 0
    if full.any():
        out[full] = mix64(np.add.reduceat(mix64(values ^ _U(salt)), starts[:-1][full]) + mix64(sizes[full].astype(_U)))
    return out


def second_fingerprints(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers independent of the first ones."""
    return mix64(fingerprints(values, starts, 0x3C79AC492BA7B653) ^ _U(0x1C69B3F74AC4AE35))


def named(values: np.ndarray, starts: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The node of each set: its fingerprint, or its second one where different sets share the first (``shared``)."""
    out = fingerprints(values, starts)
    again = np.isin(out, shared) & (np.diff(starts) > 0) if len(shared) else np.zeros(0, bool)
    if again.any():
        out[again] = second_fingerprints(values, starts)[again]
    return out


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS signed 64-bit words for each set: bit i is the parity of the set's shingles that hash to i."""
    bits = SKETCH_WORDS * 64
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = owner * bits + (mix64(values ^ _U(0x2545F4914F6CDD1D)) & _U(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=(len(starts) - 1) * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(-1, SKETCH_WORDS)


def fine_sketches(values: np.ndarray, starts: np.ndarray, different: np.ndarray) -> pa.ListArray:
    """Parity sketches of eight bits and more for each of ``different`` shingles, a power of two of 64-bit words each."""
    width = 1 << np.ceil(np.log2(np.maximum(SKETCH_WORDS, different / 8))).astype(np.int64)
    first = np.append(0, np.cumsum(width))
    sizes = np.diff(starts)
    bit = (mix64(values ^ _U(0x6A09E667F3BCC909)) & (np.repeat(width, sizes) * 64 - 1).astype(_U)).astype(np.int64)
    odd = (np.bincount(np.repeat(first[:-1] * 64, sizes) + bit, minlength=int(first[-1]) * 64) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.packbits(odd).view(np.int64)))


@dataclass(frozen=True)
class _Segments:
    """Sets split by one band's segments: for each (set, segment) in order the count and two half sums."""

    of_value: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    segment: np.ndarray
    owner: np.ndarray


def _segments(values: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> _Segments:
    """``number``: segments of each set; a set with none takes no part."""
    if not number.all():
        values, sizes = values[np.repeat(number > 0, sizes)], np.where(number > 0, sizes, 0)
    base = np.cumsum(number) - number
    place = (mix64(values ^ _U(0x9FB21C651E98DF25)) >> _U(32)) * np.repeat(number, sizes).astype(_U) >> _U(32)
    of_value = np.repeat(base, sizes) + place.astype(np.int64)
    total = int(number.sum())
    part = mix64(values ^ _U(0xC2B2AE3D27D4EB4F))
    low = np.bincount(of_value, weights=(part & _U(0xFFFFFFFF)).astype(float), minlength=total).astype(_U)
    high = np.bincount(of_value, weights=(part >> _U(32)).astype(float), minlength=total).astype(_U)
    return _Segments(of_value, np.bincount(of_value, minlength=total), low, high, np.arange(total) - np.repeat(base, number), np.repeat(np.arange(len(sizes)), number))


def _key(low: np.ndarray, high: np.ndarray, band: np.ndarray, segment: np.ndarray) -> np.ndarray:
    return mix64(mix64(low + _U(1)) + high * _U(0x9E3779B97F4A7C15) ^ mix64(band.astype(_U) << _U(32) | segment.astype(_U)))


def _empty(b: Bands, sizes: np.ndarray, split: _Segments, own: np.ndarray) -> np.ndarray:
    """How many single segments of each set hold nothing."""
    return np.bincount(split.owner[(split.counts == 0) & (split.segment >= b.double[own][split.owner])], minlength=len(sizes))


def _describe(words: int, percent: int, shared: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bands(percent)
        for rows, values, starts in _sets(batches, 1, words):
            sizes = np.diff(starts)
            own = b.of(np.maximum(sizes, 1))
            split = _segments(values, sizes, np.where(sizes > 0, b.segments[own], 0))
            short = b.segments[own] + b.double[own] - b.most_different(sizes) - _empty(b, sizes, split, own)
            words_of = sketches(values, starts)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(sizes), pa.array(named(values, starts, shared).view(np.int64)), pa.array(second_fingerprints(values, starts).view(np.int64)), pa.array(short), *(pa.array(words_of[:, i]) for i in range(SKETCH_WORDS)), fine_sketches(values, starts, b.most_different(sizes))], names=["doc_id", "text_key", "n", "node", "second", "short", *(f"s{i}" for i in range(SKETCH_WORDS)), "fine"])

    return run


def _post(words: int, percent: int, shared: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, seen = bands(percent), set()
        for _, values, starts in _sets(batches, 0, words):
            sizes, nodes = np.diff(starts), named(values, starts, shared)
            fresh = np.zeros(len(sizes), bool)  # copies met in this task are posted once
            for i, node in enumerate(nodes.tolist()):
                if sizes[i] and node not in seen:
                    seen.add(node)
                    fresh[i] = True
            if len(seen) > 1 << 20:
                seen.clear()
            values, sizes, nodes = values[np.repeat(fresh, sizes)], sizes[fresh], nodes[fresh]
            out = []
            for step in (0, 1):  # the set's own band, and the next lower one for smaller partners
                band = b.of(sizes) - step
                fits = (band >= 0) & (b.segments[band] > 0)
                if step:
                    fits &= sizes <= 100 * b.high[band] // percent
                if not fits.any():
                    continue
                own, n, v, who = band[fits], sizes[fits], values[np.repeat(fits, sizes)], nodes[fits]
                split = _segments(v, n, b.segments[own])
                double = split.segment < b.double[own][split.owner]
                empty = _empty(b, n, split, own)
                post = (split.counts > 0) | double | (empty >= b.spare[own])[split.owner]
                credit = (np.where(double, 2, 1) if not step else np.zeros(len(double))).astype(np.int8)
                out.append((_key(split.low, split.high, own[split.owner], split.segment)[post], who[split.owner][post], credit[post]))
                if double.any():
                    t = double[split.of_value]
                    at = split.of_value[t]
                    part = mix64(v[t] ^ _U(0xC2B2AE3D27D4EB4F))
                    out.append((_key(split.low[at] - (part & _U(0xFFFFFFFF)), split.high[at] - (part >> _U(32)), own[split.owner[at]], split.segment[at]), who[split.owner[at]], credit[at]))
            if out:
                key, node, credit = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node.view(np.int64)), pa.array(credit)], names=["key", "node", "credit"])

    return run


def _summed(rows: list[tuple]) -> pa.RecordBatch:
    leader, node, light, heavy = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((node, leader))
    leader, node = leader[order], node[order]
    new = np.flatnonzero(np.append(True, (leader[1:] != leader[:-1]) | (node[1:] != node[:-1])))
    return pa.RecordBatch.from_arrays([pa.array(leader[new]), pa.array(node[new]), pa.array(np.add.reduceat(light[order], new)), pa.array(np.add.reduceat(heavy[order], new))], names=["leader", "node", "light", "heavy"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, node) to (leader, node, light, heavy), a list of any length in bounded memory.

    ``light`` counts the light lists that a set shares with their smallest member, ``heavy`` the credit that it has on heavy
    ones (a heavy list's smallest member has such a row with itself).
    """
    out, held = [], 0
    carry = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)]
    hot_key, leader = None, 0

    def emit(lead: np.ndarray, node: np.ndarray, light: np.ndarray, heavy: np.ndarray) -> None:
        nonlocal held
        if len(node):
            out.append((lead, node, light, heavy))
            held += len(node)

    def runs(key: np.ndarray, node: np.ndarray, credit: np.ndarray) -> None:
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(new, len(key)))
        size, lead, light = np.repeat(count, count), np.repeat(node[new], count), None
        light = size <= HEAVY
        use = np.where(light, (size > 1) & (lead != node), True)
        emit(lead[use], node[use], light[use].astype(np.int64), np.where(light[use], 0, credit[use]))

    for batch in batches:
        key, node, credit = (np.concatenate([c, batch.column(i).to_numpy().astype(np.int64)]) for i, c in enumerate(carry))
        if not len(key):
            continue
        once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node, credit = key[once], node[once], credit[once]
        if hot_key is not None:
            n = int(np.searchsorted(key != hot_key, True)) if key[-1] != hot_key else len(key)
            emit(np.full(n, leader), node[:n], np.zeros(n, np.int64), credit[:n])
            key, node, credit = key[n:], node[n:], credit[n:]
        carry = [key[:0], node[:0], credit[:0]]
        if len(key):
            hot_key = None
            last = int(np.searchsorted(key == key[-1], True))
            if last:
                runs(key[:last], node[:last], credit[:last])
            if len(key) - last > HEAVY:
                hot_key, leader = key[-1], node[last]
                n = len(key) - last
                emit(np.full(n, leader), node[last:], np.zeros(n, np.int64), credit[last:])
            else:
                carry = [key[last:], node[last:], credit[last:]]
        if held >= GATHER:
            yield _summed(out)
            out, held = [], 0
    if len(carry[0]):
        runs(*carry)
    if out:
        yield _summed(out)


def _set_rows(words: int, shared: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, starts in _sets(batches, 0, words):
            raw = values.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(named(values, starts, shared).view(np.int64)), pa.array([raw[8 * a : 8 * b] for a, b in zip(starts, starts[1:])], pa.binary())], names=["node", "values"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            linked = []
            for x, y in zip(left, right, strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _may_link(left: str, right: str, percent: int) -> Column:
    """Whether sizes and sketches let two sets be similar."""
    l, r = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    apart = sum((F.bit_count(l(f"s{i}").bitwiseXOR(r(f"s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    most = F.floor((l("n") + r("n")) * (100 - percent) / (100 + percent))
    return (l("n") * 100 >= r("n") * percent) & (r("n") * 100 >= l("n") * percent) & (apart <= most)


def _apart(left: Column, right: Column) -> Column:
    """The Hamming distance of two fine sketches; the longer is folded to the shorter's length."""

    def folded(a: Column, to: Column) -> Column:
        half = F.shiftright(F.size(a), 1)
        return F.when(F.size(a) > F.size(to), F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(a)

    both = F.zip_with(folded(left, right), folded(right, left), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(both, F.lit(0), lambda s, x: s + x)


def _placed(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``pairs`` with the components ``of_a`` and ``of_b`` of their ends; a node in no component is its own."""
    for x in ("a", "b"):
        of = parts.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
        pairs = pairs.join(of, x, "left").withColumn(f"of_{x}", F.coalesce(f"of_{x}", x))
    return pairs


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (node, component) after more links (a, b): rounds run over the components that links join, not over all nodes."""
    joined = _placed(links, parts).select("of_a", "of_b").distinct()
    moved = written(connected_components(joined, "of_a", "of_b")).select("node", F.col("component").alias("to"))
    kept = parts.join(moved.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = moved.join(parts, "node", "left_anti").select("node", F.col("to").alias("component"))
    return written(kept.unionByName(fresh))


class Join:
    """One run of the join; the steps leave small tables in the shared folder."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        if not 50 <= percent < 100 or words < 1:
            raise ValueError("percent is from 50 to 99 and words from 1")
        bound_batches(docs.sparkSession)
        self.words, self.percent = words, percent
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        sketch = ", ".join(f"s{i} long" for i in range(SKETCH_WORDS))
        rest = [F.any_value(c).alias(c) for c in ("n", "short", *(f"s{i}" for i in range(SKETCH_WORDS)), "fine")]
        self.shared = np.zeros(0, _U)
        while True:
            self.described = written(self.docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_describe(words, percent, self.shared), f"doc_id long, text_key long, n long, node long, second long, short long, {sketch}, fine array<long>"))
            apart = (F.min("second") != F.max("second")).alias("apart")
            self.nodes = written(self.described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), apart, *rest))
            found = self.nodes.where("apart").select("node").toArrow()  # some ten of 2e10 sets are expected to share a number
            if not found.num_rows:
                break
            self.shared = np.union1d(self.shared, found["node"].to_numpy().view(_U))
            free(self.described, self.nodes)

    def stars(self) -> DataFrame:
        """(leader, node, light, heavy) of every list with two sets or more."""
        spark = self.docs.sparkSession
        total = self.nodes.agg(F.sum("n")).first()[0] or 0
        parts = max(shuffle_partitions(spark), total // 4_000_000)
        posted = self.docs.select("text").mapInArrow(_post(self.words, self.percent, self.shared), "key long, node long, credit byte")
        lists = posted.repartition(parts, "key").sortWithinPartitions("key", "node")
        found = lists.mapInArrow(_stars, "leader long, node long, light long, heavy long")
        return written(found.groupBy("leader", "node").agg(F.sum("light").alias("light"), F.sum("heavy").alias("heavy")))

    def close(self, pairs: DataFrame) -> DataFrame:
        """(a, b, apart) of the pairs whose fine sketches differ in no more than similar sets may."""
        fine = self.nodes.select("node", "n", "fine")
        side = lambda x: fine.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}"))
        most = F.floor((F.col("n_a") + F.col("n_b")) * (100 - self.percent) / (100 + self.percent))
        found = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", _apart(F.col("fine_a"), F.col("fine_b")).alias("apart"), most.alias("most"))
        return written(found.where("apart <= most").select("a", "b", "apart"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes that are similar, judged on their whole sets."""
        need = written(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        ids = written(need.join(self.nodes, "node").select("first_id").distinct())
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("text")
        sets = written(texts.mapInArrow(_set_rows(self.words, self.shared), "node long, values binary").join(need, "node", "left_semi").dropDuplicates(["node"]))
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("values").alias("right")), "b").join(sets.select(F.col("node").alias("a"), F.col("values").alias("left")), "a")
        with arrow_rows(self.docs.sparkSession, 128):  # a row holds two whole sets
            return written(both.select("a", "b", "left", "right").mapInArrow(_verify(self.percent), "a long, b long"))

    def components(self) -> DataFrame:
        """(node, component) of every node with a link to another."""
        stars = self.stars()
        load = stars.groupBy("node").agg(F.sum("heavy").alias("load"))
        members = stars.join(self.nodes.join(load, "node").withColumn("needy", F.col("load") >= F.col("short")), "node")
        members = written(members.select("leader", "node", "light", "needy", "n", *(f"s{i}" for i in range(SKETCH_WORDS))))
        heads = self.nodes.alias("h")
        near = members.where("leader <> node").alias("m").join(heads, F.col("m.leader") == F.col("h.node")).where(_may_link("m", "h", self.percent))
        links = self.linked(self.close(near.select(F.col("m.leader").alias("a"), F.col("m.node").alias("b"))))
        parts = written(connected_components(links, "a", "b"))
        placed = members.where("leader <> node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = written(placed)
        small, large = placed.where("light > 0 or needy").alias("x"), placed.alias("y")
        before = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
        reach = ((F.col("x.light") > 0) & (F.col("y.light") > 0)) | F.col("x.needy")
        apart = small.join(large, (F.col("x.leader") == F.col("y.leader")) & (F.col("x.component") != F.col("y.component")) & before & reach & _may_link("x", "y", self.percent))
        rest = self.close(apart.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
        # the likeliest links first: most pairs come to lie in one component before they are looked at
        for most in (1, 8, None):
            if rest.isEmpty():
                break
            place = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
            ranked = written(rest.withColumn("place", place))
            turn = ranked.where(F.col("place") <= most) if most else ranked
            more = self.linked(turn.select("a", "b"))
            if not more.isEmpty():
                parts = _merged(parts, more)
            if not most:
                break
            rest = written(_placed(ranked.where(F.col("place") > most), parts).where("of_a <> of_b").select("a", "b", "apart"))
        return parts


def _classes(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, class (a node of the component; null for an empty set) and component_id of each row."""
    run = Join(docs, words, percent, id_col, text_col)
    ids = run.components().join(run.nodes, "node").select("component", "node", "first_id")
    least = ids.groupBy("component").agg(F.min("first_id").alias("least_id"))
    moved = ids.join(least, "component").select("node", "component", "least_id")
    known = run.nodes.select("node", "first_id").join(moved, "node", "left").select("node", F.coalesce("component", "node").alias("class"), F.coalesce("least_id", "first_id").alias("component_id"))
    rows = run.described.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node")
    empty = rows.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id"))
    return rows.where("n_shingles > 0").join(known, "node").select("doc_id", "text_key", "n_shingles", "class", "component_id").unionByName(empty)


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Texts are lower-cased in A-Z and split at blanks and U+0009 to U+000D. Two documents are linked if 100 times the
    shingles they share is at least ``percent`` times those that either has; ``component_id`` is the smallest id that
    links lead to. A null text or one without words has no shingles, is linked with nothing and has its own id as
    component. Rows with a null id are linked like others (their id is null; a component of such rows only has a null
    ``component_id``), and repeated rows are copies of each other. Other columns are not read; no rows give no rows.

    Sets are compared on 64-bit digests of shingles: two different shingles of a pair are taken for one with a
    probability of about (shingles of both / 2) ^ 2 / 2 ^ 64. Equal sets are found by a 64-bit number of the set; where a second,
    independent one tells sets with the same number apart, they get the second one instead.
    """
    return _classes(docs, words, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each stands for its component, all columns untouched.

    The smallest id stays (null after all others); rows without shingles all stay.
    """
    rows = written(_classes(docs, words, percent, id_col, text_col).withColumn("rank", F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"))))
    some = rows.where("class is not null")
    best = some.groupBy("class").agg(F.min("rank").alias("best"))
    judged = some.join(best, "class").select("doc_id", "text_key", (F.col("rank") == F.col("best")).alias("kept"), "class")
    same = judged.where("kept").groupBy("class").agg((F.count(F.lit(1)) > 1).alias("twin"))
    return surviving(docs, judged.join(same, "class").select("doc_id", "text_key", "kept", "twin"), id_col, text_col)
