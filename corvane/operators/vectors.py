"""Cosine search (R5, R6, J17, P15): exact by blocks with bounds, and a stored index of cells.

Both start from cells: centres fitted by k-means to a bounded sample of unit vectors, and every vector assigned to its nearest. The exact
search packs vectors of one cell into blocks with their centre and radius, queries into blocks, too, and deals vector blocks into
slices; a block of queries meets a slice in a merge join and multiplies matrices, block after block, unless the centre and radius say
that no query can find anything better than its k-th score so far. The index writes the vectors in folders by cell, so a search opens the
folders of the cells that it probes and ranks what lies there exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import arrow_rows, bound_batches, free, shuffle_partitions, written

#: Rows that centres are fitted to at most, centres at most, rounds of k-means; vectors and queries of a block, vector blocks of a slice.
SAMPLE, CELLS, ROUNDS = 20_000, 256, 8
BLOCK, ASKED, SLICE = 4096, 1024, 16
#: Pairs whose buckets are compared at a time.
PAIRS = 65_536
_BLOCK = "scope string, ids binary, units binary, centre binary, radius double"


def unit(c: Column) -> Column:
    """The vector in double precision over its length; null for a null or zero vector, or one with a null component."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(norm > 0, F.transform(c, lambda x: x.cast("double") / norm))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit(rows: DataFrame) -> np.ndarray:
    """Centres of unit vectors (doc_id, unit): k-means on the ``SAMPLE`` rows of the smallest hash; about one for each root of the rows."""
    n = rows.count()
    some = rows.orderBy(F.xxhash64("doc_id", "unit"), "doc_id").limit(SAMPLE).select("unit").toArrow().combine_chunks()
    own = _matrix(some["unit"].combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.float64())))
    if not len(own):
        return np.zeros((0, 0))
    centres = own[np.linspace(0, len(own) - 1, max(1, min(CELLS, int(n**0.5), len(own)))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (own @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, own)
        norms = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def with_cells(rows: DataFrame, centres: np.ndarray, n: int = 1) -> DataFrame:
    """``rows`` with ``cells``: the numbers of the ``n`` nearest centres, nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # CELLS centres at most
    at = rows.columns.index("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column(at)) if batch.num_rows else np.zeros((0, shared.value.shape[1]))
            order = np.argsort(-(own @ shared.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * order.shape[1], pa.int32()), pa.array(order.reshape(-1)))
            yield batch.append_column("cells", cells)

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cells array<int>")


def _packer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def row() -> pa.RecordBatch:
            ids, own = (np.concatenate(x) for x in zip(*held))
            centre = own.mean(axis=0)
            radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, own, centre)), pa.array([radius])], names=["scope", "ids", "units", "centre", "radius"])

        for batch in batches:
            ids, own = batch.column(2).to_numpy(), _matrix(batch.column(3))
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    n = sum(len(x) for x, _ in held)
                    if held and (keys[a] != now or n >= size):
                        yield row()
                        held, n = [], 0
                    now = keys[a]
                    step = min(b - a, size - n)
                    held.append((ids[a : a + step], own[a : a + step]))
                    a += step
        if held:
            yield row()

    return run


def _blocks(rows: DataFrame, centres: np.ndarray, size: int) -> DataFrame:
    """Blocks of up to ``size`` rows (scope, id, unit) of one scope and cell; a hot cell is dealt out by its ids, too."""
    placed = with_cells(rows.select("scope", "id", "unit"), centres).select("scope", F.element_at("cells", 1).alias("cell"), "id", "unit")
    return _packed(placed, size)


def _packed(placed: DataFrame, size: int) -> DataFrame:
    """Rows (scope, cell, id, unit) as blocks of up to ``size`` of one scope and cell."""
    placed = placed.repartitionByRange(shuffle_partitions(placed.sparkSession), "scope", "cell", F.xxhash64("id")).sortWithinPartitions("scope", "cell")
    return written(placed.mapInArrow(_packer(size), _BLOCK))


def _best(k: int, ids: np.ndarray, scores: np.ndarray, found: np.ndarray, own: np.ndarray, dot: np.ndarray, able: np.ndarray, share: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
    """Put into ``scores`` and ``found`` what of ``dot``, the queries ``able`` by the rows ``own``, is among their ``k`` best; only what is as good as a k-th score is sorted."""
    dot[ids[able][:, None] == own[None, :]] = -np.inf
    least = scores[able, -1]
    open_ = np.flatnonzero(~np.isfinite(least))
    if share is not None:  # without a k-th score, pairs that share nothing must go first
        for i in range(0, len(open_), 64):
            some = open_[i : i + 64]
            row, col = np.nonzero(np.isfinite(dot[some]))
            away = ~share(able[some[row]], col)
            dot[some[row[away]], col[away]] = -np.inf
    if share is None and dot.shape[1] > k:
        least = np.maximum(least, np.partition(dot, -k, axis=1)[:, -k])
    elif dot.shape[1] > k and open_.size:
        least[open_] = np.partition(dot[open_], -k, axis=1)[:, -k]
    row, col = np.nonzero((dot >= least[:, None]) & np.isfinite(dot))
    if share is not None and len(row):
        keep = share(able[row], col)
        row, col = row[keep], col[keep]
    if not len(row):
        return
    rows = np.unique(row)
    old, place = np.nonzero(np.isfinite(scores[able[rows]]))
    whose = np.concatenate([row, rows[old]])
    score = np.concatenate([dot[row, col], scores[able[rows[old]], place]])
    doc = np.concatenate([own[col], found[able[rows[old]], place]])
    order = np.lexsort((doc, -score, whose))
    whose, score, doc = whose[order], score[order], doc[order]
    rank = np.arange(len(whose)) - np.searchsorted(whose, whose)
    kept = rank < k
    scores[able[rows]] = -np.inf
    scores[able[whose[kept]], rank[kept]], found[able[whose[kept]], rank[kept]] = score[kept], doc[kept]


def _searcher(k: int, tables: int = 0):
    """The ``k`` best of each block of queries in each slice; with ``tables``, vectors end in so many bucket numbers, and a pair must share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = ids = asked = scores = found = hashes = None

        def rows() -> pa.RecordBatch:
            query, place = np.nonzero(np.isfinite(scores))
            return pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(found[query, place]), pa.array(scores[query, place])], names=["query_id", "doc_id", "score"])

        for batch in batches:
            for block, slice_, scope, query_ids, queries, own_ids, units, centre, radius in zip(*(batch.column(c).to_pylist() for c in ("block", "slice", "scope", "query_ids", "queries", "ids", "units", "centre", "radius"))):
                if (block, slice_, scope) != now:
                    if now:
                        yield rows()
                    now, ids = (block, slice_, scope), np.frombuffer(query_ids, np.int64)
                    asked = np.frombuffer(queries, np.float64).reshape(len(ids), -1)
                    asked, hashes = np.split(asked, [asked.shape[1] - tables], axis=1)
                    scores, found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
                if tables:
                    able = np.arange(len(ids))
                else:
                    able = np.flatnonzero(asked @ np.frombuffer(centre, np.float64) + radius + 2e-6 >= scores[:, -1])  # queries are unit vectors
                if not len(able):
                    continue
                own = np.frombuffer(own_ids, np.int64)
                units = np.frombuffer(units, np.float64).reshape(len(own), -1)
                units, other = np.split(units, [units.shape[1] - tables], axis=1)
                share = (lambda row, col, other=other: np.concatenate([(hashes[row[a : a + PAIRS]] == other[col[a : a + PAIRS]]).any(axis=1) for a in range(0, max(len(row), 1), PAIRS)])) if tables else None
                _best(k, ids, scores, found, own, np.round(asked[able] @ units.T, 6), able, share)
        if now:
            yield rows()

    return run


def bucket_top_k(queries: DataFrame, vectors: DataFrame, tables: int, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` best of the pairs that share a bucket; ``queries`` (query_id, unit, buckets) and ``vectors`` (doc_id, unit, buckets).

    Where buckets hold most rows, joining on them makes a row for nearly every pair and table. Here rows and queries meet once, in blocks, in which
    a pair is looked at if its score may count, and its buckets are compared then.
    """
    held = lambda df, id_col: df.select(F.lit("").alias("scope"), F.lit(0).alias("cell"), F.col(id_col).cast("long").alias("id"), F.concat("unit", F.transform("buckets", lambda b: b.cast("double"))).alias("unit"))
    bound_batches(vectors.sparkSession)
    blocks, lots = _packed(held(vectors, "doc_id"), BLOCK), _packed(held(queries, "query_id"), ASKED)
    found = _met(blocks, lots, k, tables, 4)
    free(blocks, lots)
    return found


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, scope: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine top ``k`` rounded to 6 digits, ties to the smaller id; own ids left out.

    With ``scope`` columns a query meets vectors of equal, non-null scope only. Vectors that are null, zero or hold a null take no part;
    all others must have one length. No queries or no vectors give no rows. Each block of queries meets each slice of its scope once, so
    the work is the product of both sides less what bounds skip; nothing is broadcast but the centres.
    """
    spark = vectors.sparkSession
    key = F.to_json(F.array(*(F.col(c).cast("string") for c in scope))) if scope else F.lit("")
    known = F.lit(True)
    for c in scope:
        known = known & F.col(c).isNotNull()

    def clean(df: DataFrame, id_col: str) -> DataFrame:
        return df.where(known).select(key.alias("scope"), F.col(id_col).cast("long").alias("id"), unit(F.col("embedding")).alias("unit")).where("unit is not null and id is not null")

    items, asked = written(clean(vectors, "doc_id")), written(clean(queries, "query_id"))
    centres = fit(items.select(F.col("id").alias("doc_id"), "unit"))
    if not len(centres) or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    blocks, lots = _blocks(items, centres, BLOCK), _blocks(asked, centres, ASKED)
    free(items, asked)
    found = _met(blocks, lots, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def _met(blocks: DataFrame, lots: DataFrame, k: int, tables: int = 0, slice_: int = SLICE) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` best of each block of queries (``lots``) in each slice of the blocks of its scope."""
    sizes = blocks.groupBy("scope").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / slice_)).alias("slices"))  # a row for each scope
    dealt = written(blocks.join(sizes, "scope").withColumn("slice", F.pmod(F.xxhash64("ids"), F.col("slices"))))
    lots = lots.withColumn("block", F.monotonically_increasing_id()).join(sizes, "scope").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    pairs = lots.select("block", "scope", "slice", F.col("ids").alias("query_ids"), F.col("units").alias("queries")).join(dealt.select("scope", "slice", "ids", "units", "centre", "radius").hint("merge"), ["scope", "slice"])
    with arrow_rows(blocks.sparkSession, 4):  # a row holds two blocks
        return written(pairs.mapInArrow(_searcher(k, tables), "query_id long, doc_id long, score double"), dealt).withColumn("score", F.round("score", 6))


# ---- the stored index


def build_index(path: str, vectors: DataFrame, scope: tuple[str, ...] = (), copies: int = 2) -> None:
    """Write ``vectors`` (doc_id, embedding, scope columns) by scope and cell under ``path``, with the centres.

    Every row is indexed, in its ``copies`` nearest cells: a neighbour just across a cell's border is found in its second one.
    """
    spark = vectors.sparkSession
    rows = written(vectors.select(*scope, "doc_id", unit(F.col("embedding")).alias("unit")).where("unit is not null"))
    centres = fit(rows.select("doc_id", "unit"))
    spark.createDataFrame(pa.table({"cell": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})).coalesce(1).write.parquet(f"{path}/centres")
    if len(centres):
        placed = with_cells(rows, centres, copies).withColumn("cell", F.explode("cells")).drop("cells")
        placed.repartitionByRange(shuffle_partitions(spark), *scope, "cell", F.xxhash64("doc_id")).sortWithinPartitions(*scope, "cell").write.partitionBy(*scope, "cell").parquet(f"{path}/cells")
    free(rows)


def probe(spark: SparkSession, path: str, queries: DataFrame, share: float, scope: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(asked, cells): queries with each of the ``share`` of all cells that is nearest, and the rows of the index in any of these cells."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()  # CELLS at most
    centres = np.array(rows["centre"].to_pylist())
    asked = queries.select("query_id", *scope, unit(F.col("embedding")).alias("unit")).where("unit is not null")
    asked = written(with_cells(asked, centres, max(1, int(np.ceil(share * len(centres))))).select("query_id", *scope, F.col("unit").alias("q"), F.explode("cells").alias("cell")))
    wanted = sorted(r[0] for r in asked.select("cell").distinct().collect())  # CELLS at most
    return asked, spark.read.parquet(f"{path}/cells").where(F.col("cell").isin(*wanted))


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, share: float = 0.4, scope: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` of the vectors in the ``share`` of cells nearest to each query, ranked exactly.

    Rows and queries of a cell meet in blocks, like those of the exact search, and a block of queries keeps its ``k`` best only.
    The default finds nine of ten neighbours even where vectors form no clusters; clustered ones need much less.
    """
    asked, cells = probe(spark, path, queries, share, scope)
    key = F.to_json(F.array(*(F.col(c).cast("string") for c in (*scope, "cell")))).alias("scope")
    known = F.lit(True)
    for c in scope:
        known = known & F.col(c).isNotNull()
    kind = dict(cells.dtypes)["doc_id"], dict(asked.dtypes)["query_id"]
    held = lambda df, id_col, vector: df.where(known & F.col(id_col).isNotNull()).select(key, F.col("cell").cast("int").alias("cell"), F.col(id_col).cast("long").alias("id"), F.col(vector).alias("unit"))
    blocks, lots = _packed(held(cells, "doc_id", "unit"), BLOCK), _packed(held(asked, "query_id", "q"), ASKED)
    found = _met(blocks, lots, k).dropDuplicates(["query_id", "doc_id"])  # a row lies in several cells
    free(blocks, lots)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.select(F.col("query_id").cast(kind[1]).alias("query_id"), F.col("doc_id").cast(kind[0]).alias("doc_id"), "score").withColumn("rank", rank).where(F.col("rank") <= k)
