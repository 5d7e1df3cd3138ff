"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged over, so every such pair
in a text is a certain cut. The fragments between cuts are encoded independently, each distinct fragment once in a
worker's memo, and their ids are concatenated. A fragment of one kind of character (letters, digits or marks, perhaps
after a blank) holds no pre-token boundary in any context; where some other fragment turns up (runs of white
space, contractions), the pre-tokeniser's pattern is applied to that stretch of text first and its pre-tokens are cut
the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import kept_in_worker
from corvane.session import bound_batches

# Code points that the pattern library counts as letters or digits, but the tokenizer's Unicode 16 does not.
_NEWER = (
    r"[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
# The pre-tokeniser's pattern, with white space named by its Unicode property.
_S, _L, _N = r"\p{White_Space}", rf"[\p{{L}}--{_NEWER}]", rf"[\p{{N}}--{_NEWER}]"
_MARK = rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||{_NEWER}]"
PRE_TOKEN = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?{_MARK}+|{_S}+(?!\P{{White_Space}})|{_S}+"
ONE_KIND = rf"(?V1) ?{_L}+| ?{_N}+| ?{_MARK}+|{_S}"
#: Distinct fragments that a worker remembers; beyond that it starts anew.
MEMO = 120_000
_SHORT = 60
_NEVER = 1 << 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, to the byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass(frozen=True)
class Vocabulary:
    """``merges``: (left id, right id) to (rank, id); ``special``: added strings to ids, longest first."""

    tokens: list[bytes]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]
    name: str


def load(path: str) -> Vocabulary:
    """Read a tokenizer file of byte-level BPE; small and fixed, so the driver reads it and shares it."""
    with open(path, encoding="utf-8") as file:
        raw = json.load(file)
    alphabet, vocab = byte_alphabet(), raw["model"]["vocab"]
    special = {t["content"]: t["id"] for t in raw["added_tokens"]}
    tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for text, i in vocab.items():
        tokens[i] = bytes(alphabet[c] for c in text) if text not in special else text.encode()
    for text, i in special.items():
        tokens[i] = text.encode()
    merges = {}
    for rank, pair in enumerate(raw["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
    special = dict(sorted(special.items(), key=lambda x: -len(x[0])))
    return Vocabulary(tokens, merges, special, hashlib.sha256(repr((tokens, sorted(merges.items()), special)).encode()).hexdigest())


class Coder:
    """Encodes and decodes single texts; ids are handled packed, as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.merges = vocabulary.merges
        self.rank_of = {pair: rank << 32 | new for pair, (rank, new) in vocabulary.merges.items()}.get
        self.special = vocabulary.special
        own = set(vocabulary.special.values())
        self.byte_id = [-1] * 256
        inside = np.zeros(1 << 16, bool)
        for i, token in enumerate(vocabulary.tokens):
            if i in own:
                continue
            if len(token) == 1:
                self.byte_id[token[0]] = i
            for a, b in zip(token, token[1:]):
                inside[a << 8 | b] = True
        self.cut = ~inside
        self.cut.reshape(256, 256)[:, 0x80:0xC0] = False  # only where a character begins, so that fragments are text
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pre_token, self.one_kind = regex.compile(PRE_TOKEN), regex.compile(ONE_KIND)
        self.lengths = np.array([len(t) for t in vocabulary.tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        #: Ids of fragments that stand alone in any context, and of pre-tokens; b"" marks a fragment that needs its context.
        self.memo: dict[bytes, bytes] = {}
        self.pre_memo: dict[str, bytes] = {}

    def merge(self, fragment: bytes) -> bytes:
        """The ids of one fragment: the pair of lowest rank is merged first, the leftmost of equals first."""
        ids = [self.byte_id[b] for b in fragment]
        if len(ids) > _SHORT:
            return self.pack(self._merge_long(ids))
        rank_of = self.rank_of
        ranks = [rank_of(pair, _NEVER) for pair in zip(ids, ids[1:])]  # rank and new id in one number
        while ranks and (best := min(ranks)) < _NEVER:
            at = ranks.index(best)
            ids[at : at + 2] = [best & 0xFFFFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), _NEVER)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), _NEVER)
        return self.pack(ids)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same through a heap and links between neighbours, n log n in the fragment's length."""
        n, merges = len(ids), self.merges
        ahead, back = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = ahead[i] if ids[i] >= 0 else -1
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            ahead[i] = ahead[j]
            if ahead[i] >= 0:
                back[ahead[i]] = i
            for left in (back[i], i):
                if left >= 0 and (right := ahead[left]) >= 0 and (found := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, found[1], ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def fragments(self, data: bytes) -> list[bytes]:
        """``data`` cut at each pair of bytes that no token holds, at starts of characters."""
        if len(data) < 2:
            return [data] if data else []
        raw = np.frombuffer(data, np.uint8)
        ends = (np.flatnonzero(self.cut[raw[:-1].astype(np.uint16) << 8 | raw[1:]]) + 1).tolist()
        return [data[i:j] for i, j in zip([0, *ends], [*ends, len(data)])]

    def _learn(self, memo: dict, key: bytes | str) -> bytes:
        if len(memo) >= MEMO:
            memo.clear()
        if isinstance(key, str):
            found = b"".join(map(self.merge, self.fragments(key.encode("utf-8", "surrogatepass"))))
        else:
            found = self.merge(key) if self._stands_alone(key) else b""
        memo[key] = found
        return found

    def _stands_alone(self, fragment: bytes) -> bool:
        try:
            return self.one_kind.fullmatch(fragment.decode()) is not None
        except UnicodeDecodeError:
            return False

    def _encode_stretch(self, text: str) -> bytes:
        pieces = self.fragments(text.encode("utf-8", "surrogatepass"))
        memo = self.memo
        out = list(map(memo.get, pieces))
        if None in out:
            out = [self._learn(memo, p) if o is None else o for p, o in zip(pieces, out)]
        if b"" not in out:
            return b"".join(out)
        memo, tokens = self.pre_memo, self.pre_token.findall(text)
        out = list(map(memo.get, tokens))
        if None in out:
            out = [self._learn(memo, t) if o is None else o for t, o in zip(tokens, out)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.split_special is None or not any(s in text for s in self.special):
            return self._encode_stretch(text)
        parts = self.split_special.split(text)
        return b"".join(self.pack([self.special[p]]) if i % 2 else self._encode_stretch(p) for i, p in enumerate(parts))

    def decode(self, packed: bytes) -> str:
        """The tokens' bytes one after another, read as UTF-8 with U+FFFD for what is no UTF-8."""
        out = []
        for at in range(0, len(packed), 4 << 18):
            ids = np.frombuffer(packed[at : at + (4 << 18)], "<u4").astype(np.int64)
            size = self.lengths[ids]
            shift = np.repeat(self.offsets[ids] - (np.cumsum(size) - size), size)
            out.append(self.blob[shift + np.arange(len(shift))].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def coder(vocabulary) -> Coder:
    return kept_in_worker(f"bpe {vocabulary.value.name}", lambda: Coder(vocabulary.value))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) for each row; null text counts as empty and has no ids."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # a vocabulary's size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared)
        for batch in batches:
            packed = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for rows of (doc_id, ids); null ids give an empty text."""
    bound_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared)
        for batch in batches:
            texts = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the packed ids and of the text decoded from them, in one pass over whole texts.

    One row for each row of ``docs``, repeated rows and null ids included; null text counts as empty. Strings of added
    tokens inside a text become those tokens. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                packed = own.encode(text or "")
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(packed).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
