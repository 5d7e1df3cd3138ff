"""Exact top-k inner-product search with a ball tree per shard.

Every partition of the corpus is cut into shards of a bounded size, and each shard's ball tree is built once and written as
one row. Queries are packed into blocks of a bounded size. Shards are dealt into slices, and each block meets each
slice in a sort-merge join, so a task sees one block with one tree after the other: the tree's nodes are visited in order
of their upper bound, <q, c> + |q| r for a ball of centre c and radius r, for all queries at once that the bound still
allows. The k-th best score of each query goes on from shard to shard of a slice, and in every task it starts from the scores
of a fixed number of corpus vectors, so the first shard prunes, too. The plan has the same size for any number of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import arrow_rows, written

#: Queries of a block, vectors of a shard and of a leaf, numbers in a shard at most, shards of a slice, vectors that set the first bound.
BLOCK, SHARD, LEAF, SHARD_NUMBERS, SLICE, SEEDS = 4096, 16384, 128, 1 << 20, 8, 512
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Sums of products below this are exact in double precision.
_EXACT = float(1 << 53)
_TREE = "dimension int, ids binary, vectors binary, centres binary, radii binary, shape binary"
_BLOCK = "dimension int, query_ids binary, queries binary"


def integers(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, null for a vector that is null or has a null or non-finite component."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


@dataclass(frozen=True)
class Tree:
    """A ball tree over rows in tree order. ``shape``: for each node its first child (0 for a leaf; the second follows it), first row and last row + 1."""

    ids: np.ndarray
    vectors: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    shape: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray) -> Tree:
    """Splits between two far vectors, down to LEAF rows or to equal vectors."""
    order = np.arange(len(ids))
    centres, radii, shape = [], [], []

    def node(first: int, last: int) -> None:
        own = vectors[order[first:last]]
        centre = own.mean(axis=0)
        centres.append(centre)
        radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1)).max()))
        shape.append([0, first, last])

    node(0, len(ids))
    at = 0
    while at < len(shape):
        _, first, last = shape[at]
        if last - first > LEAF and radii[at]:
            own = vectors[order[first:last]]
            one = own[((own - centres[at]) ** 2).sum(axis=1).argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            half = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(own @ (other - one), half)]
            shape[at][0] = len(shape)
            node(first, first + half)
            node(first + half, last)
        at += 1
    return Tree(ids[order], vectors[order], np.array(centres), np.array(radii), np.array(shape, np.int64))


class Best:
    """The k best (score, id) of each query, better first; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.scores = np.full((len(ids), k), _NONE, np.int64)
        self.found = np.full((len(ids), k), _LAST, np.int64)
        self.norms = np.sqrt((queries**2).sum(axis=1))
        self.least = np.full(len(ids), -np.inf)

    def exact(self, vectors: np.ndarray, active: np.ndarray) -> np.ndarray:
        q = self.queries[active]
        if np.abs(q).max(initial=0) * np.abs(vectors).max(initial=0) * q.shape[1] < _EXACT:
            return np.rint(q @ vectors.T).astype(np.int64)
        wide = q.astype(np.int64).astype(object) @ vectors.astype(np.int64).astype(object).T
        return np.clip(wide, _NONE + 1, _LAST).astype(np.int64)

    def offer(self, active: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(self.ids[active][:, None] == ids[None, :], _NONE, scores)
        able = scores.max(axis=1) >= self.least[active]
        active, scores = active[able], scores[able]
        if not len(active):
            return
        all_scores = np.concatenate([self.scores[active], scores], axis=1)
        all_ids = np.concatenate([self.found[active], np.broadcast_to(ids, scores.shape)], axis=1)
        all_ids[all_scores == _NONE] = _LAST
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, : self.k]
        self.scores[active] = np.take_along_axis(all_scores, order, axis=1)
        self.found[active] = np.take_along_axis(all_ids, order, axis=1)
        kth = self.scores[active, -1]
        self.least[active] = np.maximum(self.least[active], np.where(kth == _NONE, -np.inf, kth.astype(float)))

    def seed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Start from the k-th best score among some vectors of the corpus, without keeping them."""
        other = Best(self.ids, self.queries, self.k)
        everyone = np.arange(len(self.ids))
        for a in range(0, len(ids), LEAF):
            other.offer(everyone, other.exact(vectors[a : a + LEAF], everyone), ids[a : a + LEAF])
        self.least = np.maximum(self.least, other.least)

    def search(self, tree: Tree) -> None:
        """Branch and bound over one shard, nodes in order of their bound."""

        def push(heap: list, node: int, active: np.ndarray) -> None:
            top = self.queries[active] @ tree.centres[node] + self.norms[active] * tree.radii[node]
            top += 1e-9 * np.abs(top) + 1e-6  # rounding never hides a candidate
            able = top >= self.least[active]
            if able.any():
                heapq.heappush(heap, (-float(top[able].max()), node, active[able], top[able]))

        heap: list = []
        push(heap, 0, np.arange(len(self.ids)))
        while heap:
            _, node, active, top = heapq.heappop(heap)
            active = active[top >= self.least[active]]
            if not len(active):
                continue
            child, first, last = tree.shape[node].tolist()
            if child:
                push(heap, child, active)
                push(heap, child + 1, active)
                continue
            for a in range(first, last, 4 * LEAF):  # a ball of equal vectors may be large
                rows = slice(a, min(last, a + 4 * LEAF))
                self.offer(active, self.exact(tree.vectors[rows], active), tree.ids[rows])

    def rows(self) -> pa.RecordBatch:
        query, place = np.nonzero(self.scores != _NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(self.found[query, place]), pa.array(self.scores[query, place])], names=["query_id", "vec_id", "score"])


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors) of up to ``most`` rows of one dimension each, and up to SHARD_NUMBERS numbers."""
    held: dict[int, list] = {}
    for batch in batches:
        ids, lengths = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
        for dimension in np.unique(lengths).tolist():
            own, step = np.flatnonzero(lengths == dimension), max(1, min(most, SHARD_NUMBERS // max(1, dimension)))
            flat = batch.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            new = held.pop(dimension, []) + [(ids[own], flat.reshape(len(own), dimension))]
            i, v = (np.concatenate(x) for x in zip(*new, strict=True))
            while len(i) >= step:
                yield dimension, i[:step], v[:step]
                i, v = i[step:], v[step:]
            if len(i):
                held[dimension] = [(i, v)]
    for dimension, ((i, v),) in held.items():
        yield dimension, i, v


def _row(dimension: int, parts: list[np.ndarray], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([dimension], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=names)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dimension, ids, vectors in _groups(batches, SHARD):
        tree = build(ids, vectors)
        yield _row(dimension, [tree.ids, tree.vectors, tree.centres, tree.radii, tree.shape], _TREE)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dimension, ids, queries in _groups(batches, BLOCK):
        yield _row(dimension, [ids, queries], _BLOCK)


def _numbers(value: pa.Scalar, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind).reshape(shape)


def _searcher(seeds, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block, slice_, dimension = (batch.column(c)[i].as_py() for c in ("block", "slice", "dimension"))
                if (block, slice_) != now:
                    if best is not None:
                        yield best.rows()
                    ids = _numbers(batch.column("query_ids")[i], np.int64, -1)
                    best, now = Best(ids, _numbers(batch.column("queries")[i], np.float64, len(ids), dimension), k), (block, slice_)
                    if dimension in seeds.value:
                        best.seed(*seeds.value[dimension])
                ids = _numbers(batch.column("ids")[i], np.int64, -1)
                radii = _numbers(batch.column("radii")[i], np.float64, -1)
                best.search(Tree(ids, _numbers(batch.column("vectors")[i], np.float64, len(ids), dimension), _numbers(batch.column("centres")[i], np.float64, len(radii), dimension), radii, _numbers(batch.column("shape")[i], np.int64, len(radii), 3)))
        if best is not None:
            yield best.rows()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows of ``vectors`` for each query, rows of the query's own id left out.

    Scores are inner products of the vectors in ``scale``-ths, as integers; ties go to the smaller id, and fewer than ``k``
    candidates give fewer rows. Vectors that are null or hold a null or non-finite component, and rows with a null id,
    take no part; only vectors of a query's own length are its candidates. Queries need not be rows of ``vectors``. Rows
    that repeat an id are candidates each for itself; a query id that repeats asks with each of its vectors, and the ``k``
    best of all their scores count. A score beyond 64 bits is cut to their range. No rows or no queries give no rows.
    Other columns are not read.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")

    corpus, asked = clean(vectors), written(clean(queries))
    blocks = asked.repartition(max(1, -(-asked.count() // BLOCK))).mapInArrow(_pack, _BLOCK)
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), asked)
    index = written(corpus.mapInArrow(_index, _TREE))
    slices = max(1, -(-index.count() // SLICE))
    some = corpus.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(SEEDS).toArrow()
    seeds = {dimension: (ids, own) for dimension, ids, own in _groups(iter(some.to_batches()), SEEDS)}
    trees = index.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)))
    asked = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    both = asked.join(trees.hint("merge"), ["slice", "dimension"])  # the block stands still while its slice's trees pass
    with arrow_rows(spark, 1):  # a row holds a block and a tree
        found = written(both.mapInArrow(_searcher(spark.sparkContext.broadcast(seeds), k), "query_id long, vec_id long, score long"), index)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
