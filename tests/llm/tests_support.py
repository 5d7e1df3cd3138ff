"""Rows and helpers that the tests of this folder share."""

import math
import os

TEXTS = [None, "", " \n\t", "a", "A", "a b c", "A  b\nc", "x" * 5000, "word " * 3000, "é" * 40 + " ß", "12 34 !!", "\\ </s> <|endoftext|> [INST]", "Released under the MIT License.", "one\nReleased under the MIT Licence\nCopyright 2020 x", "the same words in the same order here", "The same words  in the same order here", "z\x0b\x0cz", "  ", "𝔘 𝔫 😀"]
HARD = [(i if i % 7 else None, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "")[i % 4], None, i, i, 1, True, "n") for i, t in enumerate(TEXTS * 2)] + [(3, "a", "en", "s1", 1, 1, 1, 1, False, None)] * 2


def plain_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(plain(tuple(r)[i]) for i in order) for r in rows), key=repr)


def vocabulary(name):
    return os.path.join("/opt/tokenizers", name)
