"""Full-text tokens: Unicode words without accents, and Porter stems (the algorithm of 1980)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=4096)
def _kind(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co"


def fold(text: str) -> str:
    """Lower case without combining marks; letters that have no decomposition stay."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def words(text: str | None) -> list[str]:
    """Runs of letters and numbers (index digits included)."""
    if not text:
        return []
    plain = fold(text)
    if plain.isascii():
        return re.findall(r"[a-z0-9]+", plain)
    return "".join(c if _kind(c) else " " for c in plain).split()


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return len(re.findall("vc", re.sub(r"(v|c)\1*", r"\1", _shape(stem))))


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _short(word: str) -> bool:
    """Ends consonant-vowel-consonant, the last one not w, x or y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(word: str, rules: tuple, least: int) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _measure(stem) > least else word
    return word


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    """Stem of a lower-case ASCII word; words of one or two letters and other words stay."""
    if len(word) < 3 or not re.fullmatch(r"[a-z0-9]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, _STEP2, 0)
    word = _swap(word, _STEP3, 0)
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fts_tokens(text: str | None, stemmed: bool) -> list[str]:
    return [porter(w) for w in words(text)] if stemmed else words(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def fts_words(text: pd.Series) -> pd.Series:
    """Tokens of a text without stemming; null gives an empty list."""
    return text.map(lambda t: fts_tokens(t, False))


@F.pandas_udf(T.ArrayType(T.StringType()))
def fts_stems(text: pd.Series) -> pd.Series:
    """Porter-stemmed tokens; null gives an empty list."""
    return text.map(lambda t: fts_tokens(t, True))
