"""Token ids as compact files: canonical length-limited Huffman codes from global counts, independent blocks, checkpoints.

A file set is a folder of three Parquet tables. ``codes`` has (id, bits): the length of each id's code, from which the canonical
codes follow. ``blocks`` has the documents in order, packed: a block holds whole documents of about ``BLOCK`` ids (a longer document
has a block of its own) and can be decoded alone; every ``STRETCH`` ids a checkpoint says at which bit the next stretch begins, so
all stretches of a block are decoded side by side, an id of each per step, by one look into a table. ``parts`` has the number
of ids before each part, which makes places inside a part places in the whole.

The order is made by a range partitioning on the id, the digest of the ids and the row's number, so rows that share an id spread over
several parts. Codes are bounded by the vocabulary, parts by the number of partitions; nothing else is gathered.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import kept_in_worker
from corvane.session import bound_batches, free, shuffle_partitions, written

#: Ids of a block and of a stretch between two checkpoints; bits of the longest code; different chunks of text that a worker remembers.
BLOCK, STRETCH, MAX_BITS, MEMO = 1 << 16, 128, 20, 700_000
#: Bytes of text whose chunks are told apart together.
GATHERED = 6 << 20
_TAIL = ".,;:!?"
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_BLOCK_SCHEMA = "part int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary, checkpoints binary"


# ---- codes


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """The bits of each symbol's code in an optimal prefix code of no code over ``max_bits``, by package-merge; all counts are above 0."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, np.int64)[order]
    merged, packages = weights, []
    for _ in range(max_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        place = np.argsort(both, kind="stable")  # of equals the symbol comes before the package
        packages.append(place >= n)
        merged = both[place]
    bits, taken = np.zeros(n, np.int64), 2 * n - 2
    for is_package in reversed(packages):
        chosen = int(is_package[:taken].sum())
        bits[: taken - chosen] += 1
        taken = 2 * chosen
    bits[:taken] += 1
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


class Codes:
    """The canonical codes of symbols (ids, ascending) with the given lengths: shorter first, then smaller id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.lengths = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.longest = int(self.lengths.max(initial=1))
        step = np.left_shift(1, self.longest - self.lengths)
        first = np.cumsum(step) - step  # of the table's entries that begin with the code
        size = int(self.ids.max(initial=0)) + 1
        self.code_of, self.bits_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids] = first >> (self.longest - self.lengths)
        self.bits_of[self.ids] = self.lengths
        self._step = step

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of ``ids`` one after another, high bits first, and the bit at which each stretch begins."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        bits = self.bits_of[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        word, shift = at >> 5, (64 - bits - (at & 31)).astype(np.uint64)
        wide = self.code_of[ids] << shift
        starts = np.flatnonzero(np.diff(word, prepend=-1))  # codes are shorter than a word, so one starts in each
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[word[starts]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), starts)
        out[word[starts] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), starts)
        return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::STRETCH]

    def table(self) -> np.ndarray:
        """For each string of ``longest`` bits the id that it begins with, shifted up by 5, and the bits of its code."""
        entries = (self.ids << 5 | self.lengths).repeat(self._step)
        return np.concatenate([entries, np.ones((1 << self.longest) - len(entries), np.int64)])

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a payload: one step decodes the next id of every stretch."""
        if not n:
            return np.zeros(0, np.uint32)
        if not hasattr(self, "_table"):
            self._table = self.table()
        raw = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.int64)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at, out = checkpoints.astype(np.int64), np.empty((STRETCH, len(checkpoints)), np.uint32)
        last, table, low, mask = len(window) - 1, self._table, 32 - self.longest, (1 << self.longest) - 1
        for i in range(min(STRETCH, n)):
            found = table[(window[np.minimum(at >> 3, last)] >> (low - (at & 7))) & mask]
            out[i] = found >> 5
            at += found & 31
        return out.T.reshape(-1)[:n]  # the last stretch may be short; what is read behind it is cut off


# ---- ids of texts


class Encoder:
    """Ids of whole texts by a tokenizer that drops white space and never looks across it, so each chunk between blanks is encoded alone.

    The chunks of a batch are told apart first, so each different one is looked up once; ids are remembered, and what is new goes to
    the library in one call. Ids are unsigned integers of ``width`` bytes.
    """

    def __init__(self, path: str, width: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype(f"<u{width}")
        self.memo: dict[bytes, bytes] = {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.closes = None
        if suffix:
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _library(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters alone go as one text, as each ends with the only token that ends a word; other chunks go one by one."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        words = [i for i, t in enumerate(texts) if t.isalpha()]
        found = {}
        if self.closes is not None and words:
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([texts[i] for i in words])], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words):  # each has one at least
                packed, width = ids.tobytes(), self.dtype.itemsize
                found = {chunks[i]: packed[a:b] for i, a, b in zip(words, np.concatenate([[0], ends[:-1] * width]).tolist(), (ends * width).tolist())}
        rest = [i for i, c in enumerate(chunks) if c not in found]
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            found[chunks[i]] = np.array(x.ids, self.dtype).tobytes()
        return found

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, sizes, ids): each text's number among the different ones, and the sizes and ids of these."""
        told = texts.dictionary_encode()
        different = told.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) > MEMO:
            self.memo = {}
        found = list(map(self.memo.get, different))
        if None in found:
            self.memo.update(self._library([c for c, ids in zip(different, found) if ids is None]))
            found = list(map(self.memo.__getitem__, different))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        return told.indices.to_numpy(), sizes, np.frombuffer(b"".join(found), self.dtype)

    def encode(self, texts: pa.Array, end_id: int | None) -> pa.Array:
        """The packed ids of each text of a string array, nulls as empty texts, each followed by ``end_id`` if there is one.

        Stops at the end of a chunk, behind a letter or digit, are a token of their own in any context, and case is dropped; so chunks
        that differ in that share their core's ids.
        """
        chunks = pc.ascii_split_whitespace(texts.fill_null(""))
        told = chunks.flatten().dictionary_encode()
        core = pc.ascii_rtrim(told.dictionary, characters=_TAIL)
        ends = np.frombuffer(core.buffers()[1], np.int32)[core.offset : core.offset + len(core) + 1]
        data = np.frombuffer(core.buffers()[2] or b"", np.uint8)
        last = data[np.maximum(ends[1:] - 1, 0)] if len(data) else np.zeros(len(core), np.uint8)
        apart = pa.array(_ALNUM[last] & (np.diff(ends) > 0))
        plain = pc.and_(pc.string_is_ascii(told.dictionary), pc.invert(pc.match_substring(told.dictionary, "<|")))
        core = pc.if_else(apart, core, told.dictionary)
        core = pc.if_else(plain, pc.ascii_lower(core), core)
        lengths = lambda x: pc.binary_length(x).to_numpy().astype(np.int64)
        whole = told.dictionary
        tail_at = lengths(whole) - lengths(core)
        tails = pa.array([w[-n:] if n else "" for w, n in zip(whole.take(pa.array(np.flatnonzero(tail_at))).to_pylist(), tail_at[tail_at > 0].tolist())], pa.string())
        place, sizes, pool = self._pieces(pa.concat_arrays([core, tails]))
        first = np.cumsum(sizes) - sizes
        # two pieces for each different chunk, the second one mostly without ids
        parts = np.full((len(core), 2), -1, np.int64)
        parts[:, 0] = place[: len(core)]
        parts[np.flatnonzero(tail_at), 1] = place[len(core) :]
        n_of = np.append(sizes, 0)[parts]
        own = n_of.sum(axis=1)
        pool = pool[_ragged(np.append(first, 0)[parts].reshape(-1), n_of.reshape(-1))]
        first = np.cumsum(own) - own
        place = told.indices.to_numpy()
        n = own[place]
        ends = np.concatenate([[0], np.cumsum(n)])[np.asarray(chunks.offsets) - chunks.offsets[0].as_py()]
        ids = pool[_ragged(first[place], n)]
        if end_id is not None:
            all_ids = np.empty(len(ids) + len(texts), self.dtype)
            closing = ends[1:] + np.arange(len(texts))
            others = np.ones(len(all_ids), bool)
            others[closing] = False
            all_ids[others], all_ids[closing] = ids, end_id
            ids, ends = all_ids, ends + np.arange(len(ends))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((ends * self.dtype.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, self.dtype))])


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... ``n[0]`` numbers, then the same of the next."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``size`` bytes."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def encode(docs: DataFrame, path: str, end_id: int | None = None, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each row's ids, little-endian unsigned integers of ``width`` bytes, then ``end_id`` if there is one.

    ``path`` names a file of the tokenizers library whose normalisation and pre-tokens never look across ASCII white space (it drops
    it). Null text counts as empty; null and repeated ids are rows like others; other columns are not read.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Encoder = kept_in_worker(f"token file {path} {width}", lambda: Encoder(path, width))
        for table in _gathered(batches, GATHERED):
            yield pa.RecordBatch.from_arrays([table.column(0), own.encode(table.column(1), end_id)], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


# ---- files


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each row's begin and end; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def id_counts(encoded: DataFrame, width: int = 2) -> DataFrame:
    """(id, n) over all rows; each task adds up its own rows first, so a task sends a row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(_flat(batch.column(0))[0].view(f"<u{width}"))
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(encoded: DataFrame, path: str, width: int = 2, max_bits: int = MAX_BITS) -> None:
    """Write rows of (doc_id, ids) as a file set under ``path``, in ascending order of doc_id, null first.

    Rows with equal doc_id follow one another by the digest of their ids. ``path`` is a folder that all nodes share and that
    doesn't exist yet. No rows give a set without blocks.
    """
    if not 1 <= max_bits <= 25:
        raise ValueError("codes of 1 to 25 bits")
    spark = encoded.sparkSession
    rows = written(encoded.select("doc_id", "ids").withColumns({"digest": F.xxhash64("ids"), "row": F.monotonically_increasing_id()}))
    counts = id_counts(rows, width).toArrow().sort_by("id")  # bounded by the vocabulary
    ids, n = (counts[c].to_numpy().astype(np.int64) for c in ("id", "n"))
    lengths = code_lengths(n, max_bits)
    shape = spark.createDataFrame(pa.table({"id": pa.array(ids), "bits": pa.array(lengths.astype(np.int32))})) if len(ids) else spark.createDataFrame([], "id long, bits int")
    shape.coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((ids, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, part, block, start = Codes(*shared.value), TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, held, n_held = [], [], [], 0

        def row() -> pa.RecordBatch:
            payload, checkpoints = codes.pack(np.concatenate(held) if held else np.zeros(0, np.int64))
            values = [[part], [block], [start], [n_held], [doc_ids], [sizes], [payload], [checkpoints.astype("<u8").tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in _BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            data, ends = _flat(batch.column(1))
            own, cuts = data.view(f"<u{width}").astype(np.int64), ends // width
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                size = int(cuts[i + 1] - cuts[i])
                if doc_ids and (n_held + size > BLOCK or len(doc_ids) >= BLOCK):
                    yield row()
                    block, start, doc_ids, sizes, held, n_held = block + 1, start + n_held, [], [], [], 0
                doc_ids.append(doc_id)
                sizes.append(size)
                held.append(own[cuts[i] : cuts[i + 1]])
                n_held += size
        if doc_ids:
            yield row()

    keys = [F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("row")]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "ids").mapInArrow(run, _BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    free(rows)
    sizes = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("part", F.coalesce(before, F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of a file set: ids as little-endian unsigned 32-bit integers, start counts all ids before.

    With ``first`` or ``last`` only documents with such ids; blocks that hold none of them are not decoded. Any block can be read
    by any task.
    """
    codes = spark.read.schema("id long, bits int").parquet(f"{path}/codes").toArrow().sort_by("id")
    shared = spark.sparkContext.broadcast(tuple(codes[c].to_numpy().astype(np.int64) for c in ("id", "bits")))
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks").join(spark.read.schema("part int, base long").parquet(f"{path}/parts"), "part")
    if first is not None or last is not None:
        low, high = -(1 << 63) if first is None else first, (1 << 63) - 1 if last is None else last
        inside = lambda x: x.between(low, high)
        blocks = blocks.where(F.exists("doc_ids", inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Codes | None = None
        for batch in batches:
            own = own or Codes(*shared.value)
            for start, n, doc_ids, sizes, payload, checkpoints in zip(*(batch.column(c).to_pylist() for c in range(6))):
                ids = own.unpack(payload, np.frombuffer(checkpoints, "<u8"), n).astype("<u4")
                ends = np.cumsum([0, *sizes])
                packed = ids.tobytes()
                values = [pa.array(doc_ids, pa.int64()), pa.array(ends[:-1] + start), pa.array(np.diff(ends)), pa.array([packed[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())]
                yield pa.RecordBatch.from_arrays(values, names=["doc_id", "start", "n_tokens", "ids"])

    bound_batches(spark)
    out = blocks.select((F.col("start") + F.col("base")).alias("start"), "n_ids", "doc_ids", "lengths", "payload", "checkpoints").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    return out if first is None and last is None else out.where(inside(F.col("doc_id")))
