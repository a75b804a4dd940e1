"""Spellings rendered in signs by a dictionary of sign names and values."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a sign that cannot be rendered.
PLACEHOLDER = "□"
#: Most sign names and values a dictionary may have to be sent to every task.
LIMIT = 200_000
_NO_SIGN = frozenset(("x", "X", "*", "...", "[...]"))
_PARTS = re.compile(r"\{([^}]*)\}|(\{)|([^{]+)")


def sign_dictionary(signs: DataFrame) -> dict[str, str]:
    """Name or value to glyph from ``sign_name, utf8, values, position``; the first sign of the file wins.

    Signs without a glyph are left out. The size is checked: it is a reference list, not data that grows.
    """
    rows = signs.filter("utf8 is not null and utf8 <> ''").select(
        F.explode(F.concat(F.array("sign_name"), F.coalesce("values", F.array().cast("array<string>")))).alias("key"), "utf8", "position"
    )
    first = rows.groupBy("key").agg(F.min(F.struct("position", "utf8"))["utf8"].alias("glyph")).limit(LIMIT + 1).collect()
    if len(first) > LIMIT:
        raise ValueError(f"more than {LIMIT} sign names and values")
    return {r["key"]: r["glyph"] for r in first}


def render(spelling: str | None, glyphs: dict[str, str]) -> str:
    """Words stay apart, signs of a word are joined; what is unknown becomes the placeholder; null gives ''."""

    def sign(token: str) -> str:
        if token in _NO_SIGN:
            return PLACEHOLDER
        token = token.partition("\\")[0]
        inner = token[token.find("(") + 1 : -1] if "(" in token and token.endswith(")") else ""
        token = inner or token
        return glyphs.get(token) or glyphs.get(token.rstrip("?!*")) or PLACEHOLDER

    def word(text: str) -> str:
        out = []
        for inside, unclosed, plain in _PARTS.findall(text):
            if unclosed:
                out.append(PLACEHOLDER)
                break
            out += [sign(t) for t in re.split(r"[-.]", inside or plain) if t]
        return "".join(out)

    return " ".join(map(word, (spelling or "").split()))


def cuneify(spelling: Column, glyphs: dict[str, str]) -> Column:
    """Column version of render; the dictionary travels with the function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: render(t, glyphs))

    return run(spelling)


def placeholder_count(rendered: Column) -> Column:
    return F.length(rendered) - F.length(F.replace(rendered, F.lit(PLACEHOLDER), F.lit("")))


def cuneified(spelling: Column, glyphs: dict[str, str]) -> Column:
    """struct<glyphs, missing, complete>: a spelling in signs, how many of them are unknown, and whether none is."""
    shown = cuneify(spelling, glyphs)
    missing = placeholder_count(shown)
    return F.struct(shown.alias("glyphs"), missing.alias("missing"), ((missing == 0) & (shown != "")).alias("complete"))
