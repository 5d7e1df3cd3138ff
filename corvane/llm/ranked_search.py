"""Ranked lexical search: branch and bound over frequency-ordered prefix trees of documents.

One pass over the corpus turns each text into its length and a vector restricted to the terms that items ask for; these vectors are
written, and the counts that the weights need come from them. Then each task cuts its vectors into shards. In a shard every
document's terms are put in order of their frequency in the corpus, most frequent first, and documents are sorted by these lists, so
those that share a beginning share a path of the tree, and each node is a range of documents. A node knows the largest tf of each term
below it and the smallest m; a document's score can't be above the sum over an item's terms with these two. Nodes are visited depth first,
for all items whose bound still allows it; ranges of few documents are scored exactly. The k-th score of each item goes on from shard to
shard of a task. Items come in blocks of a bounded size, so what is broadcast is bounded; all arithmetic on scores is 64-bit integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import bound_batches, free, written

#: Term postings of a block of items, postings of a shard, documents of a range that is scored whole.
BLOCK_TERMS, SHARD_POSTINGS, LEAF = 1 << 17, 1 << 21, 64
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Bytes outside terms become blanks, A-Z become a-z.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_NONE = -1


@dataclass(frozen=True)
class Items:
    """A block of items: for each item its terms (numbers in the block) and how often it has them. ``ends`` bounds the items' terms."""

    ids: list
    terms: np.ndarray
    times: np.ndarray
    ends: np.ndarray
    vocabulary: list[str]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, times); rows that share an id are one item."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))
    return items.select(F.col(id_col).alias("item_id"), F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _block(rows: pa.Table) -> Items:
    rows = rows.sort_by("item_id")
    vocabulary = sorted(set(rows["term"].to_pylist()))
    number = {t: i for i, t in enumerate(vocabulary)}
    terms = np.array([number[t] for t in rows["term"].to_pylist()], np.int64)
    owners = rows["item_id"].to_pylist()
    starts = [i for i in range(len(owners)) if not i or owners[i] != owners[i - 1]]
    return Items([owners[i] for i in starts], terms, rows["times"].to_numpy().astype(np.int64), np.array([*starts, len(owners)]), vocabulary)


# ---- vectors


def restricted_vectors(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: n counts all its terms, the rest only those that items ask for."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode(): i for i, t in enumerate(shared.value)}
        width = len(number) + 1
        get = number.get
        for batch in batches:
            doc_ids, lengths, flat = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and (words := text.translate(_FOLD).split()):
                    doc_ids.append(doc_id)
                    lengths.append(len(words))
                    flat.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
            if not doc_ids:
                continue
            own = np.concatenate(flat)
            key = (np.repeat(np.arange(len(doc_ids)), lengths) * width + own)[own >= 0]
            key, tf = np.unique(key, return_counts=True)
            ends = np.searchsorted(key // width, np.arange(len(doc_ids) + 1)) * 4
            pack = lambda x: pa.Array.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x.astype("<i4"))])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(lengths, pa.int64()), pack(key % width), pack(tf)], names=["doc_id", "n", "terms", "tfs"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each term; tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0))[0], minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["term", "n"])

    rows = vectors.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # bounded by the block
    out = np.zeros(size, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data.view("<i4").astype(np.int64), (ends - ends[0]) // 4


# ---- trees


@dataclass(frozen=True)
class Weights:
    """What the corpus says: N, L, each term's weight, and each term's place in the order of frequency."""

    n_docs: int
    n_terms: int
    weight: np.ndarray
    place: np.ndarray


def weights(n_docs: int, n_terms: int, df: np.ndarray) -> Weights:
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    place = np.empty(len(df), np.int64)
    place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    return Weights(n_docs, n_terms, weight, place)


def length_part(n: np.ndarray, corpus: Weights) -> np.ndarray:
    """m of documents with ``n`` terms."""
    if int(n.max(initial=0)) * corpus.n_docs * 75 < 1 << 63:
        return 25 + 75 * n * corpus.n_docs // corpus.n_terms
    return np.array([25 + 75 * x * corpus.n_docs // corpus.n_terms for x in n.tolist()], np.int64)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of the score before its weight; grows with tf, falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """Documents in order of their term lists; nodes are ranges of them that share a beginning, depth first."""

    def __init__(self, doc_ids: np.ndarray, missing: np.ndarray, m: np.ndarray, terms: np.ndarray, tfs: np.ndarray, ends: np.ndarray, corpus: Weights):
        n = len(doc_ids)
        owner = np.repeat(np.arange(n), np.diff(ends))
        by = np.lexsort((corpus.place[terms], owner))
        terms, tfs = terms[by], tfs[by]
        lists = corpus.place[terms].astype(">u4").tobytes()
        bounds = (ends * 4).tolist()
        keys = [lists[a:b] for a, b in zip(bounds, bounds[1:])]
        order = sorted(range(n), key=keys.__getitem__)
        keys = [keys[i] for i in order]
        self.order = np.array(order, np.int64)
        self.doc_ids, self.missing, self.m = doc_ids[self.order], missing[self.order], m[self.order]
        sizes = np.diff(ends)[self.order]
        at = np.repeat(ends[self.order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        self.terms, self.tfs, self.ends = terms[at], tfs[at], np.concatenate([[0], np.cumsum(sizes)])
        self.corpus, self.size = corpus, len(corpus.weight)
        self.scored = corpus.weight[self.terms] * gain(self.tfs, np.repeat(self.m, sizes))
        self.keys = keys
        #: (first document, its end, children); a node of few documents or of equal lists has none.
        self.nodes: list[tuple[int, int, list[int]]] = []
        self._grow(n)

    def _grow(self, n: int) -> None:
        """Splits each range at the first place where its lists differ; small neighbours stay together in one node."""
        todo, self.nodes = [(0, 0, n)], [(0, n, [])]
        while todo:
            node, first, last = todo.pop()
            if last - first <= LEAF or self.keys[first] == self.keys[last - 1]:
                continue
            a, b = self.keys[first], self.keys[last - 1]
            depth = 0
            while a[depth : depth + 4] == b[depth : depth + 4] and depth < len(a):
                depth += 4
            cuts, at = [first], first
            while at < last:  # a child for each next term, found by halving
                head, low, high = self.keys[at][: depth + 4], at, last
                while low < high:
                    middle = (low + high) // 2
                    if self.keys[middle][: depth + 4] <= head:
                        low = middle + 1
                    else:
                        high = middle
                if low - cuts[-1] >= LEAF or low == last:
                    cuts.append(low)
                elif low - at >= LEAF // 2 and at > cuts[-1]:
                    cuts += [at, low]
                at = low
            ranges = [(x, y) for x, y in zip(cuts, cuts[1:]) if y > x]
            if len(ranges) == 1:  # many small children: halves keep the order of the lists
                middle = (first + last) // 2
                ranges = [(first, middle), (middle, last)]
            for x, y in ranges:
                self.nodes[node][2].append(len(self.nodes))
                todo.append((len(self.nodes), x, y))
                self.nodes.append((x, y, []))

    def largest(self, first: int, last: int) -> tuple[np.ndarray, int]:
        """The largest tf of each term among documents [first, last), and their smallest m."""
        a, b = self.ends[first], self.ends[last]
        top = np.zeros(self.size, np.int64)
        np.maximum.at(top, self.terms[a:b], self.tfs[a:b])
        return top, int(self.m[first:last].min())


class Best:
    """The k best (score, document) of each item of a block; ties to the smaller id, null ids last."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        n = len(items.ids)
        self.scores = np.zeros((n, k), np.int64)
        self.docs = np.zeros((n, k), np.int64)
        self.nulls = np.ones((n, k), bool)

    def sums(self, values: np.ndarray, active: np.ndarray) -> np.ndarray:
        """For each active item the sum over its terms of ``values`` (terms, or documents by terms)."""
        own = np.concatenate([np.arange(self.items.ends[i], self.items.ends[i + 1]) for i in active.tolist()])
        starts = np.concatenate([[0], np.cumsum(np.diff(self.items.ends)[active])[:-1]])
        return np.add.reduceat(values[..., self.items.terms[own]] * self.items.times[own], starts, axis=-1)

    def search(self, tree: Tree) -> None:
        """Depth first over a shard; a bound that only equals the k-th score may hide a smaller id, so it goes on."""
        stack = [(0, np.arange(len(self.items.ids)))]
        while stack:
            node, active = stack.pop()
            first, last, children = tree.nodes[node]
            top, m = tree.largest(first, last)
            bound = self.sums(tree.corpus.weight * gain(top, np.int64(m)), active)
            active = active[(bound > 0) & (bound >= self.scores[active, -1])]
            if not len(active):
                continue
            if children:
                stack += [(child, active) for child in reversed(children)]
                continue
            for a in range(first, last, LEAF):  # equal lists may be many
                self._score(tree, a, min(last, a + LEAF), active)

    def _score(self, tree: Tree, first: int, last: int, active: np.ndarray) -> None:
        a, b = tree.ends[first], tree.ends[last]
        dense = np.zeros((last - first, tree.size), np.int64)
        dense[np.repeat(np.arange(last - first), np.diff(tree.ends[first : last + 1])), tree.terms[a:b]] = tree.scored[a:b]
        scores = self.sums(dense, active).T
        able = (scores.max(axis=1) > 0) & (scores.max(axis=1) >= self.scores[active, -1])
        active, scores = active[able], scores[able]
        if not len(active):
            return
        wide = lambda x: np.broadcast_to(x[first:last], scores.shape)
        scores, docs, nulls = (np.concatenate(x, axis=1) for x in ((self.scores[active], scores), (self.docs[active], wide(tree.doc_ids)), (self.nulls[active], wide(tree.missing))))
        order = np.lexsort((docs, nulls, -scores), axis=1)[:, : self.k]
        for own, new in ((self.scores, scores), (self.docs, docs), (self.nulls, nulls)):
            own[active] = np.take_along_axis(new, order, axis=1)

    def rows(self) -> pa.RecordBatch:
        item, at = np.nonzero(self.scores > 0)
        docs = pa.array(self.docs[item, at], mask=self.nulls[item, at])
        return pa.RecordBatch.from_arrays([pa.array([self.items.ids[i] for i in item.tolist()], pa.int64()), docs, pa.array(self.scores[item, at])], names=["item_id", "doc_id", "score"])


def _searcher(items, corpus, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = Best(items.value, k), [], 0

        def shard() -> None:
            ids = pa.concat_arrays([b.column(0) for b in held])
            m = length_part(np.concatenate([b.column(1).to_numpy() for b in held]), corpus.value)
            parts = [(_numbers(b.column(2)), _numbers(b.column(3))[0]) for b in held]
            sizes = np.concatenate([np.diff(e) for (_, e), _ in parts])
            able = sizes > 0
            ends = np.concatenate([[0], np.cumsum(sizes[able])])
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            if able.any():
                best.search(Tree(ids.fill_null(0).to_numpy()[able], missing[able], m[able], np.concatenate([t for (t, _), _ in parts]), np.concatenate([f for _, f in parts]), ends, corpus.value))

        for batch in batches:
            held.append(batch)
            size += batch.nbytes // 8
            if size >= SHARD_POSTINGS:
                shard()
                held, size = [], 0
        if held:
            shard()
        yield best.rows()

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each item, ties to the smaller id, null last.

    Terms are maximal stretches of digits, ASCII letters and all other characters beyond ASCII, A-Z lower-cased. Items that share an
    id, null too, are one item with the terms of all its rows; one without terms, or whose terms no document has, gets no row. A document with
    a null text or without terms is in no count. Repeated documents are documents each. No documents or no items give no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    asked = written(item_terms(items, item_col, item_text_col))
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), asked)
    found = None
    for block in range(blocks):
        own = _block(asked.where(F.col("block") == block).select(F.col("item_id").cast("long").alias("item_id"), "term", "times").toArrow())
        if not own.ids:
            continue
        vectors = written(restricted_vectors(docs, own, id_col, text_col))
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        corpus = weights(n_docs, n_terms, document_counts(vectors, len(own.vocabulary)))
        context = spark.sparkContext
        best = written(vectors.mapInArrow(_searcher(context.broadcast(own), context.broadcast(corpus), k), "item_id long, doc_id long, score long"), vectors)
        found = best if found is None else found.unionByName(best)
    free(asked)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
