"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's pieces that end at each character; dynamic programming carries the
best score and its number of pieces, nothing else. Ties follow the tokenizer: of equal scores the piece that starts
first wins. A character that is no piece of its own costs the lowest score less 10 and counts as its UTF-8 bytes.
Pieces never continue from another character into the blank mark, so words are scored one by one, each distinct word
once in a worker's memo.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import kept_in_worker
from corvane.session import bound_batches

MARK = "▁"
_UNKNOWN_PENALTY = 10.0
#: What a sentencepiece file of merges has for a piece that no merge makes.
NO_SCORE = -1e9
BYTE = regex.compile("<0x[0-9A-F]{2}>")
#: Distinct words that a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 500_000, 64


@dataclass(frozen=True)
class Unigram:
    pieces: tuple[tuple[str, float], ...]
    name: str


def load(path: str) -> Unigram:
    """The ordinary pieces of a vocabulary file with their log-probabilities.

    A ``.json`` file is the tokenizers library's, with a unigram model whose unknown characters fall back to bytes; others are
    sentencepiece models. Where a sentencepiece file's scores are ranks of merges (0, -1, -2 and so on, as BPE has them), they
    are no log-probabilities, and Zipf's law over the rank stands in: log(1 / (rank + 1)) less the logarithm of their sum.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        if model["type"] != "Unigram":
            raise ValueError(f"{path} is no unigram vocabulary")
        own = {model.get("unk_id")}
        pieces = [(p, float(s)) for i, (p, s) in enumerate(model["vocab"]) if i not in own and not BYTE.fullmatch(p)]
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in plain]
        if len(pieces) > 1 and all(s in (-i, NO_SCORE) for i, (_, s) in enumerate(pieces)):
            total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
            pieces = [(p, -math.log(i + 1) - total) for i, (p, _) in enumerate(pieces)]
    return Unigram(tuple(pieces), hashlib.sha256(repr(pieces).encode()).hexdigest())


class Counter(dict):
    """Word to number of pieces; a word stands for itself behind one blank mark."""

    def __init__(self, vocabulary: Unigram):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - _UNKNOWN_PENALTY
        self.by_word = not any(regex.search(f"[^{MARK}]{MARK}", p) for p, _ in vocabulary.pieces)
        self.word = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __missing__(self, word: str) -> int:
        found = self.best(MARK + word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found

    def best(self, text: str) -> int:
        """The number of pieces of the best segmentation of ``text``, which has its blank marks already."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        ending: list[list] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            ending[end].append(found)
        for end in range(n):
            best, pieces = None, 0
            for length, own in sorted(ending[end], reverse=True):  # longest first: it starts first
                total = score[end + 1 - length] + own
                if best is None or total > best:
                    best, pieces = total, count[end + 1 - length] + 1
            if text[end] not in self.single:
                total = score[end] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[end] + len(text[end].encode("utf-8", "surrogatepass"))
            score[end + 1], count[end + 1] = best, pieces
        return count[n]

    def of(self, text: str) -> int:
        if not text:
            return 0
        if self.by_word and MARK not in text:
            words = text.split(" ")
            if "" not in words:
                return sum(map(self.__getitem__, words))
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.best(marked)
        return sum(self[w[1:]] if w[0] == MARK else self.best(w) for w in self.word.findall(marked))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens for each row of ``docs``; a blank mark is put before the text, blanks become marks.

    A null or empty text has 0 tokens. Null ids and repeated rows are answered like any others; other columns are not
    read. Texts are read whole, however long.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # a vocabulary's size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker(f"unigram {shared.value.name}", lambda: Counter(shared.value))
        for batch in batches:
            counts = [counter.of(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
