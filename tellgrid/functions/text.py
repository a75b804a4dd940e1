"""Text functions as column expressions; Python only where the JVM has no equivalent.

Null in gives null out unless a function says otherwise.
"""

from __future__ import annotations

import html
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters after which digits are index digits, in source spellings and in typed queries (fixed values).
SPELLING_LETTERS = "A-Za-zŋŠšḫṣṭŊḪṢṬ"
QUERY_LETTERS = "A-Za-zŋŠšḪḫṣṢṭṬʾ"
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"

#: Named entities of the bilingual corpus (fixed values); the Latin ones follow the HTML standard.
CORPUS_ENTITIES = {
    "c": "š", "C": "Š", "g": "ŋ", "G": "Ŋ", "h": "ḫ", "H": "Ḫ", "hr": "ḫ", "s": "š", "s1": "s₁", "s2": "ś", "s3": "ṣ", "s4": "ŝ",
    "s5": "s₅", "s6": "s₆", "s7": "s₇", "s8": "s₈", "s9": "s₉", "t": "ṭ", "aleph": "ʾ", "qryb": "«", "qrye": "»", "damb": "⸢", "dame": "⸣",
    "suppb": "⟨", "suppe": "⟩", "times": "×", "commat": "@", "plus": "+", "sect": "§", "X": "X",
    "amacr": "ā", "Amacr": "Ā", "emacr": "ē", "Emacr": "Ē", "imacr": "ī", "Imacr": "Ī", "omacr": "ō", "Omacr": "Ō", "umacr": "ū", "Umacr": "Ū",
    "apos": "'", "nbsp": " ",
}
#: Determinatives as they come out (fixed values).
DETERMINATIVES = {
    "d": "{d}", "dug": "{dug}", "f": "{f}", "gi": "{gi}", "id2": "{id₂}", "im": "{im}", "jic": "{ŋeš}", "ki": "{ki}", "ku6": "{ku₆}", "kuc": "{kuš}",
    "lu2": "{lu₂}", "m": "{m}", "mu": "{mu}", "mucen": "{mušen}", "mul": "{mul}", "zabar": "{zabar}", "na4": "{na₄}", "sar": "{sar}", "tug2": "{tug₂}",
    "u2": "{u₂}", "udu": "{udu}", "urud": "{urud}", "uzu": "{uzu}", "ance": "{anše}", "cah2": "{šaḫ₂}", "e2": "{e₂}", "gud": "{gud}", "iku": "{iku}",
    "kac": "{kaš}", "kur": "{kur}", "ninda": "{ninda}", "sa": "{sa}", "tum9": "{tum₉}",
}
_LATIN = (
    "euml iuml Iuml aacute eacute iacute oacute uacute Aacute Eacute Iacute Oacute Uacute ouml auml uuml Ouml Auml Uuml "
    "ccedil Ccedil ntilde Ntilde agrave egrave igrave ograve ugrave acirc ecirc icirc ocirc ucirc szlig amp lt gt quot"
).split()
_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9_]*);")


def entity_map() -> dict[str, str]:
    """Entity name to text."""
    latin = {name: html.entities.html5[name + ";"] for name in _LATIN}
    return latin | CORPUS_ENTITIES | DETERMINATIVES


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full Unicode case folding (ß becomes ss); meant for build time, not for the query path."""
    return text.map(lambda t: None if t is None else t.casefold())


@F.pandas_udf(T.StringType())
def expand_entities(text: pd.Series) -> pd.Series:
    """Replace the known named entities; an unknown one stays as it is."""
    known = entity_map()
    return text.map(lambda t: None if t is None else _ENTITY.sub(lambda m: known.get(m.group(1), m.group(0)), t))


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def ascii_lower(text: Column) -> Column:
    """Lower-case the 26 ASCII letters only, as a LIKE without regard to case does in the source engine."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_pattern(needle: str) -> str:
    """A substring pattern in which % and _ of the needle stay wildcards and a backslash is itself."""
    return "%" + needle.replace("\\", "\\\\") + "%"


def contains_like(text: Column, needle: str) -> Column:
    """Substring test with the needle's own % and _ as wildcards; a plain needle becomes a pushed-down contains."""
    return text.like(like_pattern(needle)) if set(needle) & set("%_") else text.contains(needle)


def contains_ascii_ci(text: Column, needle: str) -> Column:
    """The same, without regard to the case of ASCII letters."""
    return contains_like(ascii_lower(text), "".join(c.lower() if c.isascii() else c for c in needle))


def strip_subscripts(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SUBSCRIPTS}]", "")


def digits_to_subscripts(text: Column) -> Column:
    return F.translate(text, "0123456789", SUBSCRIPTS)


def _index_digits(text: Column, letters: str) -> Column:
    """A run of digits right behind a letter becomes index digits; digits behind anything else stay."""
    runs = F.split(text, f"(?<=[{letters}])(?=[0-9])|(?<=[0-9])(?=[^0-9])", -1)
    lowered = F.transform(runs, lambda run, i: F.when((i > 0) & run.rlike("^[0-9]+$"), digits_to_subscripts(run)).otherwise(run))
    return F.array_join(lowered, "")


def normalize_translit(text: Column) -> Column:
    """Source spellings in ASCII to the usual letters: j c to ŋ š (both cases), then index digits."""
    return _index_digits(F.translate(text, "jJcC", "ŋŊšŠ"), SPELLING_LETTERS)


def normalize_query(text: Column) -> Column:
    """A typed query: sz s, t, j ' to š ṣ ṭ ŋ ʾ in this order, then index digits."""
    swaps = (("sz", "š"), ("s,", "ṣ"), ("t,", "ṭ"), ("j", "ŋ"), ("'", "ʾ"))
    swapped = reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), swaps, strip(text))
    return _index_digits(swapped, QUERY_LETTERS)


def strip(text: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    """Trimmed text, or null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def has_scan(text: Column) -> Column:
    """1 where a field is not blank, else 0 (0 for null)."""
    return F.when(F.coalesce(strip(text), F.lit("")) != "", 1).otherwise(0)


def strip_markup(text: Column) -> Column:
    """Text of a marked-up fragment: tags removed, white space collapsed, trimmed; entities are left to html_unescape."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"(?U)\s+", " "))


def line_label(line_id: Column, number: Column) -> Column:
    """c141.1 to 1, c24216.A.5 to A.5; else the given number, else '?'."""
    column = F.regexp_extract(line_id, r"^c\d+(?:\.([A-Z]))?\.(\d+)$", 1)
    row = F.regexp_extract(line_id, r"^c\d+(?:\.([A-Z]))?\.(\d+)$", 2)
    labelled = F.when(row != "", F.when(column != "", F.concat_ws(".", column, row)).otherwise(row))
    return F.coalesce(labelled, F.nullif(number, F.lit("")), F.lit("?"))


def leading_number(text: Column) -> Column:
    """The number a line range starts with, or null (B.1-5 has none)."""
    return F.regexp_extract(text, r"^(\d+)", 1).try_cast("bigint")


def format_p_id(raw: Column) -> Column:
    """347 to P000347; longer numbers keep their length; anything but digits gives null."""
    digits = strip(raw)
    return F.when(digits.rlike(r"^\d+$"), F.format_string("P%06d", digits.try_cast("bigint")))


def normalize_p_id(raw: Column) -> Column:
    """A typed id, with or without P (repeated or not), in catalogue form; null if it has other characters."""
    return format_p_id(F.regexp_replace(strip(raw), "^[Pp]+", ""))


#: Signs stripped from the ends of a word (fixed values).
_EDGES = r"\[\]⸢⸣(),;:!?"


def clean_word(word: Column, placeholders: bool = False) -> Column:
    """A word without determinatives and edge punctuation; with ``placeholders`` a lone x or X becomes empty."""
    bare = strip(F.regexp_replace(word, r"\{[^}]*\}", ""))
    bare = F.regexp_replace(bare, f"^[{_EDGES}]+|[{_EDGES}]+$", "")
    return F.when(bare.isin("x", "X"), "").otherwise(bare) if placeholders else bare


def tokens(text: Column, placeholders: bool = False) -> Column:
    """Words of a transliteration without determinatives and edge punctuation; empty ones drop out."""
    words = F.transform(F.split(strip(text), r"(?U)\s+"), lambda w: clean_word(w, placeholders))
    return F.filter(words, lambda w: w != "")


def pieces(word: Column) -> Column:
    """Parts of a word between hyphens and dots."""
    return F.filter(F.split(word, r"[-.]"), lambda p: p != "")


def clean_pieces(word: Column) -> Column:
    """Parts of a word between hyphens and dots, each cleaned like a word; placeholders and empty ones drop out."""
    return F.filter(F.transform(F.split(word, r"[-.]"), lambda p: clean_word(p, True)), lambda p: p != "")


def joined(separator: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])
