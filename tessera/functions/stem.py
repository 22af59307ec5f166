"""The Porter stemmer, from its published description (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import functions as F

# The suffix rules of steps 2, 3 and 4.
_STEP2 = dict(pair.split(">") for pair in "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble".split())
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _form(word: str) -> str:
    """The word as consonants and vowels; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _replace(word: str, rules: dict[str, str]) -> str:
    for end in sorted(rules, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + rules[end] if _measure(stem) > 0 else word
    return word


def _short(word: str) -> bool:
    return len(word) >= 3 and _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


@functools.lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case English word; other words come back unchanged or shortened by the same rules."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _form(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(words):
    """Stems of an array column of words, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)
