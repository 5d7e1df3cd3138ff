"""The pipeline against a plain version of each stage."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_jaccard import brute
from test_text_operators import plain_grams
from tests_support import HARD, vocabulary
from tokenizers import Tokenizer

import corpus_pipeline
from corvane.llm import langid, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps of the smallest documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], "/root/testdata/sf0.001")))
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_names_and_columns(kept):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == COLUMNS for df in kept[:-1])


def test_language_stage(kept):
    """Against learning and judging again with counters and sets of n-grams; texts within the filters' error of the threshold aside."""
    counts = {}
    before = kept[0].collect()
    for r in before:
        if r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    known = [set(c) for c in counts.values()]
    stay = {r.doc_id for r in kept[1].collect()}
    for r in before:
        own = plain_grams(r.text or "")
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert r.doc_id not in stay
        elif len(own) * corpus_pipeline.LEAST_SCORE < 1:
            assert r.doc_id in stay
        else:
            share = max(sum(g in k for g in own) for k in known) / len(own)
            if abs(share - corpus_pipeline.LEAST_SCORE) > 0.02:
                assert (r.doc_id in stay) == (share > corpus_pipeline.LEAST_SCORE)


def test_exact_stage(kept):
    best = {}
    for r in rows(kept[1]):
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        rank = (-len(r[1] or ""), r[0])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    assert sorted(rows(kept[2])) == sorted(r for _, r in best.values())


def test_near_stage(kept):
    before = rows(kept[2])
    want = brute([(i, t) for i, t, _ in before], 5, 80)
    assert sorted(rows(kept[3])) == sorted(r for r in before if want[r[0]][1] == r[0])


def test_mix_stage(kept):
    copies = {r.doc_id: r.copies for r in mixing.mix(kept[3]).collect()}
    assert sorted(rows(kept[4])) == sorted(r for r in rows(kept[3]) for _ in range(copies[r[0]]))


def test_token_stage(kept):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t, _ in rows(kept[4])}
    want = sorted((i, len(ids[i]), hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest()) for i, _, _ in rows(kept[4]))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in kept[5].collect()) == want


def test_run_equals_stages(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())) == sorted(map(tuple, kept[5].collect()))


def test_stages_on_hard_and_empty_rows(spark):
    docs = spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long, size long, node long, rank int, kept boolean, norm string")
    for start in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.written(stage(spark, start, ""))
            assert after.columns == start.columns
            start = after
        ids = corpus_pipeline.STAGES[-1][1](spark, start, "").collect()
        assert len(ids) == start.count() and all(r.n_tokens is not None for r in ids)


def test_language_stage_keeps_what_it_cannot_judge(spark):
    common = [(i, f"the weather in the valley was fine and people walked along the river {i}", "en") for i in range(1, 60)]
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 == 2)
    rare = [(held, "mvua kubwa ilinyesha usiku kucha milimani", "sw")]
    short = [(201, "a b c", "en"), (202, "zq", None), (203, "\u0915\u093f \u0915\u0940 \u0917\u0941 \u0938\u0947", None)]
    bad = [(301, "12 34 !!", "en"), (302, "xkqj zzvw qqpx wvkz jjqx", None)]
    frame = lambda rows: spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stay = lambda rows: {r.doc_id for r in corpus_pipeline.keep_known_language(spark, frame(rows), "").collect()}
    assert stay(common + rare + short + bad) == {i for i, _, _ in common + rare + short}
    unlabelled = [(i, t, None) for i, t, _ in common + short + bad]
    assert stay(unlabelled) == {i for i, _, _ in unlabelled} - {301}
