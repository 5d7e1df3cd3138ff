"""Periodic runs of words by internal pattern matching.

The words of a batch of documents become numbers, documents one after another, each closed by a mark of its own and none equal to
another's. Doubling gives the suffix array and, for each length s = 2, 4, 8, ..., the range of it that begins with the same s words;
only suffixes that still have an equal are sorted further, so a text without repeats is done after a few rounds.

A run of period p holds a block of s words that starts at a multiple of s and again p words later, where s is the largest power of two
with 2 s - 1 <= p (4 for small p, as runs have 12 words at least; 2 for p = 6). So each such block asks for its occurrences in the
window that lies that far behind it: a wavelet tree over the suffix array gives the next occurrence in a range of suffixes at or
behind a place. Two occurrences at most s / 2 apart mean that the block has that period and that its occurrences form a progression,
which ends where the stretch of that period ends. Of a progression only a few members can be periods of a run that isn't of the
short period itself: those that carry the start or the end of the block's stretch to that of the other one; if both stretches
overlap in less than the short period, all its members can. Each candidate is extended both ways by comparing blocks of falling
lengths, and kept if it is long enough and no smaller period has the same stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import bound_batches

#: Words of a run at least, and times its period.
LEAST, TIMES = 12, 2
#: Words that are looked at together; a longer text stands alone.
GROUP = 300_000
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Suffixes:
    """The suffix array of a text of numbers whose documents end in marks that occur once each, and what doubling leaves behind.

    ``ranks[k][i]`` is the first place, among all sorted suffixes, of those that share the first 2^k numbers with suffix i.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        rank = self._first(symbols[self.order], 0)
        own = np.empty(n, np.int32)
        own[self.order] = rank
        self.ranks, size = [own], 1
        while len(tied := self._tied(self.ranks[-1], size)):
            own = self.ranks[-1]
            place = np.sort(own[tied])  # the places that the tied suffixes share
            key = own[tied].astype(np.int64) * n + own[tied + size]
            by = np.argsort(key, kind="stable")
            tied, key = tied[by], key[by]
            start = np.flatnonzero(np.diff(key, prepend=-1))
            group = place[start]  # equal first halves keep their group's first place ...
            offset = np.arange(len(tied))
            head = np.repeat(start, np.diff(np.append(start, len(tied))))
            first = np.flatnonzero(np.diff(place, prepend=-1))
            base = np.repeat(first, np.diff(np.append(first, len(tied))))
            new = own.copy()
            new[tied] = place + (head - base)  # ... and go on by what is sorted before them in it
            self.order[place + (offset - base)] = tied
            del group
            self.ranks.append(new)
            size *= 2

    @staticmethod
    def _first(ordered: np.ndarray, at: int) -> np.ndarray:
        start = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1)) if len(ordered) else np.zeros(0, np.int64)
        return np.repeat(start, np.diff(np.append(start, len(ordered)))) + at

    def _tied(self, rank: np.ndarray, size: int) -> np.ndarray:
        """Suffixes that share their first ``size`` numbers with another one."""
        self.sizes = getattr(self, "sizes", [])
        count = np.bincount(rank, minlength=len(rank)).astype(np.int32)
        self.sizes.append(count)
        return np.flatnonzero(count[rank] > 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes at ``i`` and ``j`` (different places of one document) agree."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[k][i + out] == self.ranks[k][j + out]
            out += same.astype(np.int64) << k
        return out

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the texts before ``i`` and ``j`` agree, backwards; i < j."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            able = i - out >= 1 << k
            at = np.where(able, i - out - (1 << k), 0)
            same = able & (self.ranks[k][at] == self.ranks[k][np.where(able, j - out - (1 << k), 0)])
            out += same.astype(np.int64) << k
        return out


class WaveletTree:
    """Places ``values`` (a permutation of 0 .. n - 1): the smallest value at or above a bound in a range, for many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            is_one = (values >> bit & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~is_one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~is_one], values[is_one]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of [low, high) are below the bound."""
        count = np.zeros(len(low), np.int64)
        count += np.where(bound >= 1 << self.bits, high - low, 0)
        active = bound < 1 << self.bits
        for level, before in enumerate(self.zeros):
            one = (bound >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = before[low], before[high]
            count += np.where(one & active, b - a, 0)
            low, high = np.where(one, before[-1] + low - a, a), np.where(one, before[-1] + high - b, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of [low, high)."""
        value = np.zeros(len(low), np.int64)
        for level, before in enumerate(self.zeros):
            a, b = before[low], before[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            low, high = np.where(one, before[-1] + low - a, a), np.where(one, before[-1] + high - b, b)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value of [low, high) at or above the bound, -1 where there is none."""
        k = self.below(low, high, bound)
        found = k < high - low
        out = np.full(len(low), -1, np.int64)
        out[found] = self.smallest(low[found], high[found], k[found])
        return out


class _Occurrences:
    """Next occurrences of blocks: a wavelet tree over the suffixes that share their first words with another one."""

    def __init__(self, suffixes: Suffixes, level: int):
        count, rank = suffixes.sizes[level], suffixes.ranks[level]
        shared = count[rank[suffixes.order]] > 1
        self.before = np.zeros(len(shared) + 1, np.int64)
        np.cumsum(shared, out=self.before[1:])
        kept = suffixes.order[shared]
        self.places = np.sort(kept)
        self.tree = WaveletTree(np.searchsorted(self.places, kept))

    def next(self, low: np.ndarray, high: np.ndarray, at_least: np.ndarray) -> np.ndarray:
        found = self.tree.successor(self.before[low], self.before[high], np.searchsorted(self.places, at_least))
        return np.where(found < 0, -1, self.places[found])


def candidates(suffixes: Suffixes, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of (block, period) such that each run of at least ``LEAST`` words has one of its blocks with its period among them.

    ``starts`` has each document's first place, and then the end of the text.
    """
    top = len(suffixes.ranks) - 1  # the longest blocks that may have an equal are shorter than 2^top
    if top < 1:
        return
    place = np.arange(int(starts[-1])) - np.repeat(starts[:-1], np.diff(starts))
    rank = suffixes.ranks[1]
    pair = np.flatnonzero((place[: len(rank) - 6] % 2 == 0) & (rank[: len(rank) - 6] == rank[6:])) if len(rank) > 6 else np.zeros(0, np.int64)
    yield pair, np.full(len(pair), 6)
    if top < 2:
        return
    index = None
    for level in range(2, top + 1):
        size = 1 << level
        rank, count = suffixes.ranks[level], suffixes.sizes[level]
        block = np.flatnonzero((place % size == 0) & (count[rank] > 1))
        if not len(block):
            continue
        index = index or _Occurrences(suffixes, 2)
        low = rank[block].astype(np.int64)
        high = low + count[rank[block]]
        near, far = (1, 4 * size - 2) if level == 2 else (2 * size - 1, 4 * size - 2)
        at, end = index.next(low, high, block + near), block + far
        while len(block):
            on = (at >= 0) & (at <= end)
            block, low, high, at, end = (x[on] for x in (block, low, high, at, end))
            if not len(block):
                break
            yield block, at - block
            after = index.next(low, high, at + 1)
            short = after - at
            many = (after >= 0) & (short <= size // 2)
            if many.any():
                b, i, d = block[many], at[many], short[many]
                own_end, own_start = b + d + suffixes.common(b, b + d), b - suffixes.common_before(b, b + d)
                its_end, its_start = i + d + suffixes.common(i, i + d), i - suffixes.common_before(i, i + d)
                last = i + (its_end - size - i) // d * d
                for period in (its_start - own_start, its_end - own_end):
                    fits = (period > 0) & (b + period <= end[many]) & (period >= near)
                    yield b[fits], period[fits]
                close = (its_start <= own_end) & (own_end - its_start < d) & (its_start > own_start)
                if close.any():  # all members of the progression in the window
                    b, i, d = b[close], i[close], d[close]
                    n = (np.minimum(last[close], end[many][close]) - i) // d + 1
                    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    yield np.repeat(b, n), np.repeat(i - b, n) + step * np.repeat(d, n)
                after[many] = index.next(low[many], high[many], last + 1)
            at = after


def find_runs(words: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of (start, length, period) of each text's runs, by start, then period; texts are arrays of numbers from 0."""
    lengths = np.array([len(w) + 1 for w in words])  # a mark behind each
    starts = np.concatenate([[0], np.cumsum(lengths)])
    symbols = np.full(int(starts[-1]), -1, np.int64)
    most = max((int(w.max()) for w in words if len(w)), default=0) + 2
    for d, w in enumerate(words):
        symbols[starts[d] : starts[d + 1] - 1] = w
        symbols[starts[d] : starts[d + 1]] += d * most + 1
    out = [np.zeros((0, 3), np.int64)] * len(words)
    suffixes = Suffixes(symbols)
    blocks, periods = [], []
    for b, p in candidates(suffixes, starts):
        blocks.append(b)
        periods.append(p)
    if not blocks or not sum(map(len, blocks)):
        return out
    b, p = np.concatenate(blocks), np.concatenate(periods)
    first = b - suffixes.common_before(b, b + p)
    last = b + p + suffixes.common(b, b + p)
    keep = last - first >= np.maximum(LEAST, TIMES * p)
    first, last, p = first[keep], last[keep], p[keep]
    order = np.lexsort((p, last, first))
    first, last, p = first[order], last[order], p[order]
    new = (np.diff(first, prepend=-1) != 0) | (np.diff(last, prepend=-1) != 0)  # of one stretch the smallest period
    first, last, p = first[new], last[new], p[new]
    order = np.lexsort((p, first))
    first, last, p = first[order], last[order], p[order]
    doc = np.searchsorted(starts, first, side="right") - 1
    for d in np.unique(doc).tolist():
        own = doc == d
        out[d] = np.stack([first[own] - starts[d], (last - first)[own], p[own]], axis=1)
    return out


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents, by the crc32 of the id, repeat a stretch of their own words to the end; null ids never do."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def row_of(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    """The result row of a text's words and its runs."""
    kept, best, listed = words, (None,) * 4, ""
    if len(runs):
        start, length, period = max(runs.tolist(), key=lambda r: (r[1], -r[0], -r[2]))
        best = (start, length, period, 1000 * length // period)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def periodic_runs(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), and digests of all runs and of the text without repeats.

    Words are maximal stretches without blanks and U+0009 to U+000D of the whole text. A run is a stretch of words of smallest
    period q and ``LEAST`` words and twice q at least that no neighbour extends; a word inside a run and behind its first q words is
    left out of the collapsed text. With ``plant`` some documents get a repeated tail first (``repeat_tail``). One row for each
    row of ``docs``: null and empty texts have no runs, four nulls and digests of nothing; null and repeated ids are rows like
    others. Other columns are not read. Memory grows with a text's words and the logarithm of its longest repeat.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _SCHEMA.split(", ")]

        def answer(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
            number: dict[bytes, int] = {}
            texts = []
            for _, words in held:
                for w in set(words).difference(number):
                    number[w] = len(number)
                texts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            rows = [row_of(i, words, found) for (i, words), found in zip(held, find_runs(texts))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or b"").split()
                words = repeat_tail(words, doc_id) if plant else words
                if held and size + len(words) > GROUP:
                    yield answer(held)
                    held, size = [], 0
                held.append((doc_id, words))
                size += len(words) + 1
            if held:
                yield answer(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)
