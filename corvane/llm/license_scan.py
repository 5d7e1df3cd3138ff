"""Licence scans by canonical digests.

Case, punctuation, copyright lines and equivalent spellings are normalised away; the digest of an entire text, and of
each entire line of it (a notice often stands alone on a line), is looked up among the digests of known licences. A text
is normalised once, with its line ends; only units as long as a known text are hashed.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import written

# Spellings that count as equal, in lower case and with single blanks between words.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("copyright holder", "copyright owner"), ("favour", "favor"), ("organisation", "organization"), ("whilst", "while"), ("non commercial", "noncommercial"), ("https", "http"))
# Words that continue a sentence after "copyright"; a copyright line has a sign, a year or a name there.
CONTINUES = ("act", "acts", "also", "and", "are", "as", "by law", "claim", "claims", "disclaimer", "disclaimers", "doctrine", "doctrines", "does", "for", "has", "have", "holder", "holders", "if", "in", "infringement", "interest", "interests", "is", "law", "laws", "licence", "licences", "license", "licenses", "like", "line", "lines", "material", "materials", "may", "notice", "notices", "of", "on", "or", "owner", "owners", "ownership", "permission", "permissions", "protection", "protections", "right", "rights", "statement", "statements", "status", "terms", "that", "the", "this", "to", "treaties", "treaty", "was", "work", "works")
# Licence notices, as published.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


#: Full texts of licences, a file each that is named after the licence.
TEXTS = Path(__file__).parent / "licenses"
# The titles that short licences go by; they stand without one, too.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "Zlib": ("zlib License", "The zlib/libpng License")}


def full_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the full texts, of the short ones with each title and none, in lines as published and in one line a paragraph."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        text, titles = path.read_text(encoding="utf-8"), TITLES.get(path.stem)
        body = text.split("\n", 1)[1] if titles else text
        for one in [f"{title}\n\n{body}" for title in titles] + [body] if titles else [text]:
            out += [(path.stem, one), (path.stem, re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", one))]
    return out


#: A line that names who holds a copyright: the word and then no word that continues a sentence, or the sign, or the reservation of rights.
COPYRIGHT_LINE = "(?dm)^[^\\p{L}\\p{N}\\n]*(?:copyright\\b(?![^\\p{L}\\p{N}\\n]*(?:" + "|".join(CONTINUES) + ")\\b)[^\\n]*[\\p{L}\\p{N}][^\\n]*|\u00a9[^\\n]*|\\(c\\)[^\\p{L}\\p{N}\\n]*(?:[0-9]{4}|copyright\\b)[^\\n]*|all rights reserved[^\\p{L}\\p{N}\\n]*)$"


def spelled(words: str, spelling: str) -> list[tuple[str, str]]:
    """The replacements of one spelling: within a line, and broken over two, where the line end stays before the word or between the words."""
    if " " not in words:
        return [(words, spelling)]
    return [(words, spelling), (words.replace(" ", "\n"), spelling.replace(" ", "\n") if " " in spelling else "\n" + spelling)]


REPLACED = [(" \n", "\n"), ("\n ", "\n"), *(x for s in SPELLINGS for x in spelled(*s)), (" \n", "\n")]


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, with one spelling, and words of letters and digits between single blanks; line ends stay."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    text = F.regexp_replace(text, "[^\\p{L}\\p{N}\\n]+", " ")
    return F.trim(reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), REPLACED, text))


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def catalogue(spark: SparkSession, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(digest, n_chars, license_id) of the known licences, by default of the notices and the full texts; of texts that normalise alike the smaller id counts."""
    rows = spark.createDataFrame([*KNOWN, *full_texts()] if known is None else list(known), "license_id string, text string")
    rows = rows.select("license_id", _whole(F.split(canonical(F.col("text")), "\n")).alias("unit")).where("unit <> ''")
    return rows.groupBy(F.sha2("unit", 256).alias("digest"), F.length("unit").alias("n_chars")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, license_id, digest): a row for each text and each line that is a known licence as a whole.

    ``line_no`` counts from 1, and is 0 for a whole text. Null and empty texts match nothing, nor does a text without a letter
    or digit; repeated rows give repeated matches, a null id stays null, other columns are not read. Whole texts that
    are one line are reported once, as whole texts. ``known`` is a table like ``catalogue`` makes; its distinct lengths, a
    number for each known text at most, are read beforehand, and the planner broadcasts it if its size allows.
    """
    known = written(catalogue(docs.sparkSession)) if known is None else known
    lengths = [r[0] for r in known.select("n_chars").distinct().collect()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.split(canonical(F.col(text_col)), "\n").alias("lines"))
    unit = lambda n, text: F.struct(n.cast("long").alias("line_no"), text.alias("unit"))
    whole = F.array(unit(F.lit(0), _whole(F.col("lines"))))
    units = F.when(F.size("lines") > 1, F.concat(whole, F.transform("lines", lambda x, i: unit(i + 1, x)))).otherwise(whole)
    rows = rows.select("doc_id", F.explode(F.filter(units, lambda u: F.length(u["unit"]).isin(lengths))).alias("u"))
    found = rows.select("doc_id", "u.line_no", F.sha2("u.unit", 256).alias("digest"))
    return found.join(known.select("digest", "license_id"), "digest").select("doc_id", "line_no", "license_id", "digest")
