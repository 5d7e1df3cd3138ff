"""Token files: codes against Huffman's own cost, exact round trips, ids against the library, hard rows."""

import heapq
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_support import HARD, vocabulary
from tokenizers import Tokenizer

from corvane.llm import queries, token_file

SF, WORDS = "/root/testdata/sf0.001", vocabulary("word_bpe_49k.json")


def huffman_cost(counts):
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total or sum(counts)


def best_limited(counts, limit):
    """The least cost over all lengths up to the limit that fulfil Kraft's inequality; rarer symbols get longer codes."""
    counts = sorted(counts, reverse=True)

    def go(i, room, least):
        if i == len(counts):
            return 0
        costs = [counts[i] * bits + rest for bits in range(least, limit + 1) if (left := room - 2 ** (limit - bits)) >= 0 and (rest := go(i + 1, left, bits)) is not None]
        return min(costs, default=None)

    return go(0, 2**limit, 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=2, max_size=40))
def test_codes_without_a_limit_cost_what_huffman_costs(counts):
    bits = token_file.code_lengths(np.array(counts), 25)
    assert int((bits * counts).sum()) == huffman_cost(counts)
    assert abs(sum(2.0**-b for b in bits.tolist()) - 1) < 1e-12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=2, max_size=8), st.integers(3, 4))
def test_limited_codes_are_optimal(counts, limit):
    bits = token_file.code_lengths(np.array(counts), limit)
    assert bits.max() <= limit and int((bits * counts).sum()) == best_limited(counts, limit)


def test_limit_holds_for_skewed_counts():
    counts = np.array([2**i for i in range(40)])
    for limit in (6, 10, 20):
        bits = token_file.code_lengths(counts, limit)
        assert bits.max() <= limit and sum(2.0**-b for b in bits.tolist()) <= 1 + 1e-12
    with pytest.raises(ValueError):
        token_file.code_lengths(np.ones(9, np.int64), 3)


@pytest.mark.parametrize("n,symbols", [(0, 5), (1, 1), (127, 1), (128, 2), (129, 3), (5000, 700), (70_000, 40_000)])
def test_pack_and_unpack(n, symbols):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(8 / symbols if symbols > 8 else 0.5, n), symbols) - 1
    found, counts = np.unique(ids, return_counts=True)
    codes = token_file.Codes(found, token_file.code_lengths(counts))
    payload, checkpoints = codes.pack(ids)
    assert len(checkpoints) == -(-n // token_file.STRETCH)
    assert codes.unpack(payload, checkpoints, n).tolist() == ids.tolist()


def rows_by_library(rows):
    tokenizer, start, out = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query_on_driver_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op13_token_file(spark, SF).collect()
    assert sorted(map(tuple, got)) == rows_by_library(docs)


HARD_TEXTS = ["", None, " \t\n", "a  b\x1cc\x85d\xa0e <|endoftext|>x<|STARTOFTEXT|> <|startoftext|>.", "J̌a' It's DON'T ΣΑΣ İstanbul ﬁ é.., 12.5! ́x x́, ẞ 漢字。", "x" * 3000, "K Å̧.;", "word. Word, WORD", "...", "a.b.", "1.", "\x0bq\x0c", "İ İ.", "don't.'s", "퟿ \U0001f600."]


def test_ids_are_the_library_s():
    tokenizer, own = Tokenizer.from_file(WORDS), token_file.Encoder(WORDS, 2)
    for texts in (HARD_TEXTS, HARD_TEXTS[::-1], [t for t in HARD_TEXTS if t]):
        for text, ids in zip(texts, own.encode(pa.array(texts), None).to_pylist()):
            assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbJ.,!' \ň́ΣİßéÅ1<|>漢"), max_size=20), max_size=8))
def test_random_texts_get_the_library_s_ids(texts):
    tokenizer, own = Tokenizer.from_file(WORDS), test_random_texts_get_the_library_s_ids.__dict__.setdefault("own", token_file.Encoder(WORDS, 2))
    got = own.encode(pa.array(texts, pa.string()), 2).to_pylist()
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_hard_rows_and_one_id_for_many(spark, tmp_path):
    rows = [(r[0], r[1]) for r in HARD] + [(7, f"t {i % 40}") for i in range(400)] + list(enumerate(HARD_TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", token_file.F.lit(1))
    path = f"file://{tmp_path}/ids"
    token_file.write(token_file.encode(docs, WORDS, end_id=2), path)
    got = token_file.read(spark, path).collect()
    assert len(got) == len(rows)
    want = sorted((repr(r[0]), r[2], r[3]) for r in rows_by_library(rows))
    assert sorted((repr(r.doc_id), r.n_tokens, zlib.crc32(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    by_start = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert by_start == sorted(by_start, key=lambda i: (i is not None, i))
    some = token_file.read(spark, path, first=3, last=5).collect()
    assert sorted(r.start for r in some) == sorted(r.start for r in got if r.doc_id is not None and 3 <= r.doc_id <= 5)


def test_parts_and_blocks_dont_change_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "Delta."]) for _ in range(rng.choice([0, 3, 200])))) for i in range(500)] + [(600, "w " * 90_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        path = f"file://{tmp_path}/ids{n}"
        token_file.write(token_file.encode(docs, WORDS, end_id=2), path)
        found.append(sorted(map(tuple, token_file.read(spark, path).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and [r[:1] + r[1:3] + (zlib.crc32(r[3]),) for r in found[0]] == rows_by_library(rows)


def test_wide_ids_and_bounds(spark, tmp_path):
    rows = [(1, struct.pack("<3I", 5, 70_000, 5)), (2, b""), (3, None)]
    token_file.write(spark.createDataFrame(rows, "doc_id long, ids binary"), f"file://{tmp_path}/wide", width=4)
    got = sorted(map(tuple, token_file.read(spark, f"file://{tmp_path}/wide").collect()))
    assert got == [(1, 0, 3, rows[0][1]), (2, 3, 0, b""), (3, 3, 0, b"")]
    with pytest.raises(ValueError):
        token_file.write(spark.createDataFrame(rows, "doc_id long, ids binary"), f"file://{tmp_path}/no", max_bits=30)
