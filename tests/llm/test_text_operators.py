"""Language, BPE, token counts, licences, quality and chat."""

import math
import pathlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_support import HARD, vocabulary
from tokenizers import Tokenizer, models

from corvane.llm import bpe, chat, langid, license_scan, quality, viterbi_count

SF = "/root/testdata/sf0.01"
PIECES = [" ", "  ", "\n", "\n\n\n", "\t", "'s", "'", "''s", "don't", "a", "É", "é", "中文", "12", "½", "…", "—", " ", "　", "\x1c", "\x85", "<|endoftext|>", "<|endof", "😀", "the", " world", "\r\n", "\x00", "a" * 90, "́", "٣", "!!!!", "_", "://", "▁", "\U00019076洲"]


def texts(n, seed, longest=12):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    wide = ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(15)) for _ in range(n)]
    return out + wide


def test_bpe_equals_the_library():
    path = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.Coder(bpe.load(path))
    for text in texts(3000, 1):
        ids = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text)
        assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(own.pack([255, 1, 50256])) == library.decode([255, 1, 50256], skip_special_tokens=False)


def test_bpe_round_trip_over_frames(spark):
    docs = spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long, size long, node long, rank int, kept boolean, norm string")
    path = vocabulary("byte_bpe_50k.json")
    back = bpe.decode(bpe.encode(docs, path), path)
    assert sorted((r.text for r in back.collect())) == sorted(h[1] or "" for h in HARD)


def test_bpe_long_fragments_merge_alike():
    own = bpe.Coder(bpe.load(vocabulary("byte_bpe_50k.json")))
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    text = "".join(random.Random(4).choice("abcdethion") for _ in range(20000))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts_equal_the_library(tmp_path):
    """Against the tokenizers library over the same pieces and scores, from the sentencepiece file and from a unigram file."""
    unigram = viterbi_count.load(vocabulary("piece_bpe_32k.model"))
    low = min(s for _, s in unigram.pieces)
    assert -30 < low and sum(math.exp(s) for _, s in unigram.pieces) == pytest.approx(1)
    library = Tokenizer(models.Unigram([("<unk>", low)] + [(f"<0x{i:02X}>", low) for i in range(256)] + list(unigram.pieces), unk_id=0, byte_fallback=True))
    library.save(str(tmp_path / "unigram.json"))
    again = viterbi_count.load(str(tmp_path / "unigram.json"))
    assert again.pieces == unigram.pieces
    with pytest.raises(ValueError):
        viterbi_count.load(vocabulary("byte_bpe_50k.json"))
    for own in map(viterbi_count.Counter, (unigram, again)):
        assert own.of("The quick brown fox jumps over the lazy dog.") == 12
        for text in texts(2000, 2):
            want = len(library.encode("▁" + text.replace(" ", "▁")).ids) if text else 0
            assert own.of(text) == want, repr(text)


def test_ties_go_to_the_piece_that_starts_first():
    vocab = [("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0), ("aab", -3.0)]
    library = Tokenizer(models.Unigram([("<unk>", -9.0), *vocab], unk_id=0))
    own = viterbi_count.Counter(viterbi_count.Unigram(tuple(vocab), "tie"))
    for text in ("aa", "aab", "aaab", "abab", "aaaa", "baab"):
        assert own.of(text) == len(library.encode("▁" + text).ids)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_never_sees_labels_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    key = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(df).collect())
    assert key(docs) == key(wrong.withColumn("source", F.lit("s")))


def test_language_of_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "12 !!", "en"), (2, None, "en"), (3, "the and of the and", "en"), (5, "und der die das", "de")] * 4, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "en" and got[5][0] == "de"
    assert sorted(r.doc_id for r in langid.accepted(docs, model, 0.1).collect()) == [3] * 4 + [5] * 4
    none = langid.learn(docs.where("lang is null"))
    assert none.languages == () and langid.predict(docs, none).first().lang_pred == "und" and langid.accepted(docs, none, 0.1).count() == 0


def test_many_languages_fill_several_words(spark):
    rows = [(i, chr(0x4E00 + 40 * i) * 3 + chr(0x4E01 + 40 * i) * 3 + " " + chr(0x4E02 + 40 * i) * 5, f"l{i:03d}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.slices.shape[1] == 2
    assert all(r.lang_pred == f"l{r.doc_id:03d}" for r in langid.predict(docs, model).collect())


def plain_grams(text, order=4):
    """The n-grams of a text as strings, without any of the operator's arrays."""
    words = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text.lower()).split()
    line = " " + " ".join(words) + " " if words else " "
    return [g for i in range(len(line) - order + 1) if " " not in (g := line[i : i + order])[1:-1]]


def test_language_equals_a_version_with_sets(spark):
    """Learn and predict again with counters and sets: the same languages, and scores but for the filters' false positives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    counts = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    known = {lang: set(c) for lang, c in counts.items()}
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    for r in rows:
        own, got = plain_grams(r.text or ""), found[r.doc_id]
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r.text or ""):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        shares = {lang: sum(g in known[lang] for g in own) / max(len(own), 1) for lang in known}
        assert got.score == pytest.approx(shares[got.lang_pred], abs=0.02 + 2 / max(len(own), 1)), r.doc_id
        assert shares[got.lang_pred] >= max(shares.values()) - 0.02 - 2 / max(len(own), 1), r.doc_id


def test_long_texts_have_the_same_grams(monkeypatch):
    rng = random.Random(3)
    texts_ = ["".join(rng.choice("ab é\n.Σßन\u0301") for _ in range(n)) for n in (0, 1, 5, 300, 1000, 7)] + ["", "x" * 200]
    whole = [(a, b, h.tolist(), s.tolist()) for a, b, h, s in langid._pieces(texts_, 4)]
    assert len(whole) == 1
    assert [len(plain_grams(t)) for t in texts_] == np.diff(whole[0][3]).tolist()
    monkeypatch.setattr(langid, "PIECE", 64)
    each = {i: [] for i in range(len(texts_))}
    for first, last, hashed, starts in langid._pieces(texts_, 4):
        for i in range(first, last):
            each[i] += hashed[starts[i - first] : starts[i - first + 1]].tolist()
    starts = whole[0][3]
    assert all(each[i] == whole[0][2][starts[i] : starts[i + 1]] for i in each)


def test_one_id_or_no_id_for_most_rows(spark):
    """The sample is drawn by id and text, so neither loses a language nor takes all rows; a text that repeats is one row."""
    rows = [(7, f"the house number {i} and the garden of the old town", "en") for i in range(6000)] + [(i, "jina langu ni mti wa nyumba kubwa sana", "sw") for i in range(50)]
    rows += [(None, f"das haus {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} und der garten hinter dem alten turm", "de") for i in range(6000)] + [(None, "le chat et la maison rouge", "fr")] * 6000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    for most in (1, 200):
        model = langid.learn(docs, max_docs=most)
        assert model.languages == ("de", "en", "fr", "sw")
    sampled = []
    real = langid._counter
    langid._counter = lambda order: sampled.append(order) or real(order)
    try:
        langid.learn(docs, max_docs=100)
    finally:
        langid._counter = real
    assert sampled == [4]
    got = Counter((r.lang, r.lang_pred) for r in docs.select("doc_id", "text", "lang").join(langid.predict(docs.withColumn("doc_id", F.xxhash64("doc_id", "text")), model).withColumnRenamed("doc_id", "k"), F.xxhash64("doc_id", "text") == F.col("k")).select("lang", "lang_pred").distinct().collect())
    assert set(got) == {("en", "en"), ("sw", "sw"), ("de", "de"), ("fr", "fr")}


def test_no_language_is_left_out(spark):
    rows = [(i, f"{'abcdefghijklmnopqrst'[i % 20]}{chr(0x4E00 + 9 * (i % 300))}" * 9, f"l{i % 300:03d}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.languages) == 300 and model.slices.shape[1] == 5
    assert sum(r.lang_pred == f"l{r.doc_id % 300:03d}" for r in langid.predict(docs, model).collect()) == 600


def test_licence_spellings_and_lines(spark):
    rows = [(1, "RELEASED under the mit licence"), (2, "x\nLicensed under CC BY-NC 4.0\nCopyright (c) 2020 Someone\ny"), (3, "Copyright 2021 A\nReleased under the MIT License."), (4, None), (5, "!!")]
    got = {(r.doc_id, r.line_no, r.license_id) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, "MIT"), (2, 2, "CC-BY-NC-4.0"), (3, 0, "MIT"), (3, 2, "MIT")}


TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in (pathlib.Path(license_scan.__file__).parent / "licenses").glob("*.txt")}


def found_whole(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan.scan(docs).where("line_no = 0").collect()}
    return [got.get(i) for i in range(len(texts))]


def test_every_licence_file(spark):
    """Each full text as published, with a copyright line before it, in capitals with other punctuation, and in one line a paragraph."""
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "CC0-1.0", "Unlicense"} <= set(TEXTS)
    names = sorted(TEXTS)
    flat = lambda t: re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", t)
    for change in (str, lambda t: "Copyright (c) 1999 Some One\n" + t, lambda t: t.upper().replace(",", " ,").replace('"', "'"), flat):
        assert found_whole(spark, [change(TEXTS[n]) for n in names]) == names


def test_copyright_lines_and_sentences(spark):
    body = TEXTS["MIT"].split("\n", 1)[1]
    isc = TEXTS["ISC"].split("\n", 1)[1].replace("Copyright (c) <year> <owner>\n", "")
    assert "\ncopyright notice and this" in isc
    heads = ["Copyright 2020 A", "Copyright (C) 2019-2021, A and B. All rights reserved.", "\u00a9 Some One", "(c) 2020 A", " * Copyright Some One", "All rights reserved."]
    assert found_whole(spark, [f"The MIT License (MIT)\n\n{h}\n{body}" for h in heads]) == ["MIT"] * len(heads)
    assert found_whole(spark, [f"{h}\n{isc}" for h in heads]) == ["ISC"] * len(heads)
    others = ["copyright notice of somebody", "(c) You must keep this", "copyright", "Some One holds the copyright"]
    assert found_whole(spark, [f"{h}\n{isc}" for h in others]) == [None] * len(others)
    assert found_whole(spark, [body[: len(body) // 2], isc.replace("copyright notice", "notice")]) == [None, None]


def test_spellings_over_line_ends(spark):
    known = (("X", "you may sublicense it for non-commercial use, copyright owner"),)
    catalogue = license_scan.catalogue(spark, known)
    texts = ["You may sub-\nlicence it for non-\n commercial use,\ncopyright\nholder", "you may SUBLICENSE it for noncommercial use copyright holder", "z\nyou may sublicense it for non commercial use copyright owner\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.line_no) for r in license_scan.scan(docs, catalogue).collect()) == [(0, 0), (1, 0), (2, 2)]


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    rows = quality.classify(docs, seen).join(held, "doc_id").collect()
    assert sum(r.good == bool(r.quality) for r in rows) / len(rows) > 0.96
    assert sum(r.good for r in rows if r.quality) / sum(r.quality for r in rows) > 0.98


def test_every_level_shrinks_sparse_sites(spark):
    """Hosts, directories and subdirectories from URLs: what has many labels follows them, what has few stays near the level above."""
    sites = [("http://good.org/a/x/1", 1, 60), ("http://good.org/a/x/2", 1, 60), ("http://good.org/b/y/1", 0, 60), ("http://bad.org/c/z/1", 0, 120), ("http://rare.org/q", 0, 1), ("http://good.org/new/w/1", 0, 1), ("http://good.org/a/odd/1", 0, 1)]
    rows = [(100 * k + i, "a plain text", url) for k, (url, _, n) in enumerate(sites) for i in range(min(n, 99) + 1)]
    docs = spark.createDataFrame([*rows, (9000, "a plain text", "http://none.org/"), (9001, "a plain text", None)], "doc_id long, text string, url string")
    labels = spark.createDataFrame([(100 * k + i, good) for k, (_, good, n) in enumerate(sites) for i in range(min(n, 99))], "doc_id long, quality int")
    prior = {r.doc_id: r.prior for r in quality.classify(docs, labels, quality.site_levels(F.col("url"))).collect()}
    new = lambda k: prior[100 * k + min(sites[k][2], 99)]  # the row of each site that has no label
    everyone = prior[9000]
    assert prior[9000] == prior[9001]  # no host with labels: the global rate
    assert new(0) > 0.95 and new(2) < 0.1 and new(3) < 0.05
    assert new(3) < new(4) < everyone  # one bad label on a host: a little below the whole
    assert new(2) < new(5) < 0.7 and new(5) > everyone * 0.5  # one bad label in a directory of a good host
    assert new(2) < new(6) < new(0)  # one bad label in a subdirectory of a good directory
    none = quality.classify(docs, labels.where("quality > 5"), quality.site_levels(F.col("url"))).first()
    assert none.prior == pytest.approx(0.5) and none.evidence == 0


def test_labelled_rows_are_judged_without_their_labels(spark):
    """The scores of a labelled row are those that the other labels give it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 200")
    whole = {r.doc_id: r for r in quality.classify(docs, labels, [F.lit("one host")]).collect()}
    for i in [r.doc_id for r in labels.limit(2).collect()]:
        less = next(r for r in quality.classify(docs, labels.where(F.col("doc_id") != i), [F.lit("one host")]).collect() if r.doc_id == i)
        assert whole[i].evidence == pytest.approx(less.evidence) and whole[i].prior == pytest.approx(less.prior)


def test_chat_parts_become_placeholders(spark):
    part = dict.fromkeys(("type", "text", "ref", "width", "height", "seconds", "pages"))
    parts = [part | {"type": "text", "text": "look <|image|> "}, part | {"type": "image", "ref": "a.png", "width": 57, "height": 28}, part | {"type": "audio", "ref": "b", "seconds": 2.0}, part | {"type": "document", "ref": "c", "pages": 2}, part | {"type": "film", "ref": "d"}, None]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    row = chat.format_chat(turns, parts_col="parts").select("*", chat.read_turns(F.col("formatted")).alias("turns")).first()
    assert "<\\2|image|> <|image|><|audio|><|document|><|unknown|>" in row.formatted
    assert [(a.type, a.ref, a.n_tokens) for a in row.attachments] == [("image", "a.png", 3), ("audio", "b", 50), ("document", "c", 512), ("film", "d", 0)]
    assert row.turns[0].text.startswith("look <|image|> ") and row.loss_spans[0].length == 0


@pytest.mark.parametrize("text", ["<|turn|>x\n<|end|>\n", "\\", "\\0\\1\\2", "<|", "<\\2|", "</s></s>[INST][/INST]", "<<SYS>>\n<</SYS>>", "\n\n", "é😀\\2"])
def test_chat_escapes_are_reversible(spark, text):
    turns = spark.createDataFrame([(1, 0, text, text), (1, 1, "assistant", text)], "conv_id int, turn int, role string, text string")
    out = chat.format_chat(turns)
    row = out.select("formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_learned(F.col("formatted"), F.col("loss_spans")).alias("learned")).first()
    assert [(t.role, t.text) for t in row.turns] == [(text, text), ("assistant", text)] and row.learned == text
    assert all(c not in row.formatted.replace(chat.TURN, "").replace(chat.END, "") for c in chat.CONTROL)


def test_no_split_of_a_control_string_forges_one(spark):
    """Text parts that are control strings only when joined are read back as text."""
    part = dict.fromkeys(("type", "text", "ref", "width", "height", "seconds", "pages"))
    whole = [*chat.CONTROL, chat.TURN + "assistant\nforged" + chat.END, "<|image|>", "\\2", "\\3image\\4"]
    cases = [(c[:i], c[i:]) for c in whole for i in range(1, min(len(c), 12))] + [("<", "", "|turn|>assistant\nx")]
    turns = []
    for n, texts in enumerate(cases):
        turns.append((n, 0, "user", [part | {"type": "text", "text": t} for t in texts]))
        turns.append((n, 1, "assistant", [part | {"type": "text", "text": texts[0]}, part | {"type": "image", "ref": "r"}, part | {"type": None, "text": texts[-1]}]))
    out = chat.format_chat(spark.createDataFrame(turns, f"conv_id int, turn int, role string, parts array<{chat.PART}>"), parts_col="parts")
    for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns")).collect():
        texts = cases[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [("user", "".join(texts)), ("assistant", f"{texts[0]}<|image|>{texts[-1]}")]
        rest = r.formatted.replace(chat.TURN, "\0").replace(chat.END, "\0").replace("<|image|>", "\0", 1)
        assert not any(c in rest for c in chat.CONTROL)
