"""Collation of citation forms by the dictionary's own alphabet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet in order (fixed values); it has no F, J, Q, V.
ALPHABET = "ABCDEGŊHḪIKLMNOPRSṢŠTṬUWXYZ"


def _codes() -> Column:
    """Character to its place in the order: blanks, letters, digits, dot."""
    codes = {c: " " for c in " -/"} | {".": "4"}
    codes |= {c.lower(): f"{i:02d}{c.lower()}" for i, c in enumerate(ALPHABET)}
    codes |= {c: f"3{i}" for digits in ("0123456789", "₀₁₂₃₄₅₆₇₈₉") for i, c in enumerate(digits)}
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])


def sort_key(text: Column) -> Column:
    """Key under which a < a aŋ < aaba < ab < A.A < A.AL; unknown characters come last; null stays null."""
    codes = _codes()
    characters = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    return F.array_join(F.transform(characters, lambda c: F.coalesce(F.try_element_at(codes, c), F.concat(F.lit("99"), c))), "")


def first_letter(text: Column) -> Column:
    """Upper-case first letter if it is in the alphabet, else '?' (also for null and empty)."""
    letter = F.upper(F.substring(text, 1, 1))
    return F.when(letter.isin(*ALPHABET), letter).otherwise("?")
