"""The corpus pipeline: language, exact copies, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept; all but the last return the
columns of ``docs``. Stages never look at what an earlier one dropped. Any column may hold nulls, ids and rows may repeat, and
other columns than those of documents go through untouched, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, exact_dedup, jaccard, langid, mixing
from corvane.session import written

#: Below this share of n-grams that the best language knows, a text is in none of the learned languages.
LEAST_SCORE = 0.1


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and texts in none of the learned languages; all labelled rows are learned from.

    Null and empty texts go. With no label at all, texts with a letter stay; so do texts too short to judge and texts labelled
    with a language that isn't learned. Repeated rows share their fate.
    """
    model = langid.learn(docs)
    return langid.accepted(docs, model, LEAST_SCORE) if model.languages else docs.where(F.col("text").rlike("\\p{L}"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the one with the most code points stays, then the smallest id (null last).

    Null and empty texts are equal; of rows with the same id and text one stays, the same in every run.
    """
    return exact_dedup.without_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles, the smallest id stays (null last).

    Texts without words all stay. Of rows with the same id and text one stays, the same in every run.
    """
    return jaccard.without_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mixture takes them: twice at most, in part by chance drawn from the id.

    A null source is a source. Rows that repeat an id are decided each for itself.
    """
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the token ids, one row for each row of the mixture, null ids and repeats included; a null text is empty."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_known_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]
#: Language filters, sketches and token ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if i + 1 < len(STAGES) else docs
    return docs
