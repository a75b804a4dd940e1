"""Structural n-gram patterns: a small language of slots, compiled to column predicates.

A slot is TARGET, optionally [SENSE], optionally :CASE. TARGET is * (anything), a part of speech (contains / or is at most
four capitals), a family of them (ends in *), else a citation form. ! before the sense or case negates it. A negated sense
leaves nulls out, a negated case keeps them; absolutive, none and null name the missing case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellgrid.functions.text import ascii_lower

#: Names of the case that is not written (fixed values).
UNMARKED = ("absolutive", "none", "null")


class PatternError(ValueError):
    """A pattern that cannot be read or has the wrong length."""


@dataclass(frozen=True)
class Slot:
    kind: str  # any, cf, pos, family
    target: str | None
    sense: str | None = None
    not_sense: bool = False
    case: str | None = None
    not_case: bool = False


def parse_slot(text: str) -> Slot:
    rest, case, sense = text.strip(), None, None
    if m := re.fullmatch(r"(.*?):([^:]+)", rest, re.S):
        rest, case = m.groups()
    if m := re.fullmatch(r"([^\[]*)\[([^\]]+)\]", rest, re.S):
        rest, sense = m.groups()
    target = rest.strip()
    if not target or set(target) & set("[:") or sense == "!" or case == "!":
        raise PatternError(f"cannot read the slot {text!r}")

    def negated(value: str | None) -> tuple[str | None, bool]:
        value = value.strip() if value else None
        return (value[1:].strip(), True) if value and value.startswith("!") else (value, False)

    kind = "any" if target == "*" else "family" if target.endswith("*") else "pos" if "/" in target or (target.isupper() and len(target) <= 4) else "cf"
    name = None if kind == "any" else target[:-1] if kind == "family" else target
    (sense, not_sense), (case, not_case) = negated(sense), negated(case)
    return Slot(kind, name, sense, not_sense, case, not_case)


def parse_pattern(slots: list[str]) -> list[Slot]:
    if not isinstance(slots, list) or not 2 <= len(slots) <= 4:
        raise PatternError("a pattern has two to four slots")
    return [parse_slot(s) for s in slots]


def _family(column: Column, start: str) -> Column:
    return ascii_lower(column).startswith(start.lower())


def slot_predicate(slot: Slot, cf: Column, gw: Column, pos: Column, case: Column) -> Column:
    """The slot as a predicate over the columns of one place."""
    test = F.lit(True)
    if slot.kind == "cf":
        test = cf == slot.target
    elif slot.kind == "pos":
        test = pos == slot.target
    elif slot.kind == "family":
        test = _family(pos, slot.target)
    if slot.sense:
        test = test & ((gw != slot.sense) if slot.not_sense else (gw == slot.sense))
    if slot.case:
        if slot.case.lower() in UNMARKED:
            test = test & (case.isNotNull() if slot.not_case else case.isNull())
        else:
            test = test & (((case != slot.case) | case.isNull()) if slot.not_case else (case == slot.case))
    return test


def match_pattern(grams: DataFrame, slots: list[str]) -> DataFrame:
    """Rows of a feature-annotated n-gram table (n, cf1.., gw1.., pos1.., case1..) that fit the pattern."""
    parsed = parse_pattern(slots)
    test = F.col("n") == len(parsed)
    for i, slot in enumerate(parsed, 1):
        test = test & slot_predicate(slot, *[F.col(f"{name}{i}") for name in ("cf", "gw", "pos", "case")])
    return grams.filter(test)


def match_pattern_plain(grams: DataFrame, entries: DataFrame, slots: list[str]) -> DataFrame:
    """The same over a table without features: a part of speech holds if any entry of the citation form has it."""
    parsed = parse_pattern(slots)
    if any(s.sense or s.case for s in parsed):
        raise PatternError("senses and cases need the feature-annotated table")
    found = grams.filter(F.col("n") == len(parsed))
    for i, slot in enumerate(parsed, 1):
        if slot.kind == "cf":
            found = found.filter(F.col(f"cf{i}") == slot.target)
        elif slot.kind != "any":
            fits = entries.filter(F.col("pos") == slot.target) if slot.kind == "pos" else entries.filter(_family(F.col("pos"), slot.target))
            fits = fits.select(F.col("cf").alias("_cf")).distinct()
            found = found.join(fits, F.col(f"cf{i}") == F.col("_cf"), "left_semi")
    return found


def slots_of(grams: DataFrame, n: int) -> Column:
    """array<struct<cf, gw, pos, case>> of the first ``n`` places."""
    return F.array(*[F.struct(*[F.col(f"{name}{i}").alias(name) for name in ("cf", "gw", "pos", "case")]) for i in range(1, n + 1)])
