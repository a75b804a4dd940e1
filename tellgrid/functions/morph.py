"""Rule-based morphology of spellings, as column expressions that stay in the JVM.

The tables hold fixed values of the grammar; everything else is folded over arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOCATIVE_ALSO = (
    "nominalizer (-a on a finite verb makes it a relative/subordinate clause)",
    "genitive (the consonantal -k often elides, leaving only -a)",
)
_ERGATIVE_ALSO = (
    "directive (-e 'at, to' on a non-person noun, collides with ergative)",
    "3sg/3pl ergative verbal agreement (when attached to a verb stem in marû)",
)
#: Endings in the order they are tried (fixed values): ending, role, kind, other readings.
SUFFIXES = (
    ("-zu-ne-ne", "2pl_possessive", "possessive", ()),
    ("-ane-ne", "3pl_h_possessive", "possessive", ()),
    ("-ne-ne", "3pl_h_possessive", "possessive", ()),
    ("-bi-ne", "3pl_nh_possessive", "possessive", ()),
    ("-gin₇", "equative", "case", ()),
    ("-šè", "terminative", "case", ()),
    ("-še₃", "terminative", "case", ()),
    ("-še", "terminative", "case", ()),
    ("-ta", "ablative_instrumental", "case", ()),
    ("-da", "comitative", "case", ()),
    ("-ra", "dative", "case", ()),
    ("-ak", "genitive", "case", ()),
    ("-ene", "plural", "plural", ("3sg_h_possessive (when bare -ne)",)),
    ("-ne", "plural", "plural", ("3sg_h_possessive (when bare -ne)",)),
    ("-ŋu₁₀", "1sg_possessive", "possessive", ()),
    ("-zu", "2sg_possessive", "possessive", ()),
    ("-ani", "3sg_h_possessive", "possessive", ()),
    ("-ni", "3sg_h_possessive", "possessive", ()),
    ("-bi", "3sg_nh_possessive_or_anaphoric", "possessive", ("demonstrative ('this/that')",)),
    ("-me", "1pl_possessive", "possessive", ()),
    ("-a", "locative", "case", _LOCATIVE_ALSO),
    ("-e", "ergative", "case", _ERGATIVE_ALSO),
)
#: Pieces that may stand in a verb's prefix chain (fixed values).
VERB_PREFIXES = ("ḫe₂", "na", "ga", "bara", "nu", "mu", "ba", "bi₂", "al", "i₃", "i", "e", "ni", "ši", "ta", "da", "bi", "n", "b")
#: Case to phrase role, and role to short label (fixed values).
CASE_ROLES = {
    "ergative": "subject_ergative", "dative": "oblique_dative", "locative": "oblique_locative", "comitative": "oblique_comitative",
    "ablative_instrumental": "oblique_ablative", "terminative": "oblique_terminative", "equative": "comparison_equative",
    "genitive": "genitive_modifier",
}
ROLE_LABELS = {
    "subject_ergative": "ERG", "object_absolutive": "ABS", "noun_head_unmarked": "ABS", "oblique_dative": "DAT", "oblique_locative": "LOC",
    "oblique_comitative": "COM", "oblique_ablative": "ABL", "oblique_terminative": "TERM", "comparison_equative": "EQUATIVE",
    "genitive_modifier": "GEN", "adjective_modifier": "ADJ", "verb_head": "V", "unknown": "?",
}
#: Names of verb features and the slots they stand for (fixed values).
CONJUGATION = {"mu": "mu", "ba": "ba", "i": "i", "bi": "bi", "ga": "ga", "ha": "ha", "imp": ""}
DIMENSIONS = {"dat": "na", "loc": "ni", "com": "da", "abl": "ta", "term": "ši", "loc2": "e"}
OBJECTS = {"3sg.h": "n", "3sg.nh": "b", "3pl.h": "neš", "1sg": "ʔ"}
IMPERFECTIVE = ("e", "ed", "en", "eš")

_SUFFIX_TYPE = "struct<spelling:string,role:string,kind:string,ambiguous_with:array<string>>"


def _as_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _suffix(row: tuple) -> Column:
    spelling, role, kind, also = row
    others = F.array(*[F.lit(a) for a in also]).cast("array<string>")
    return F.struct(F.lit(spelling).alias("spelling"), F.lit(role).alias("role"), F.lit(kind).alias("kind"), others.alias("ambiguous_with"))


def peel_suffixes(word: Column) -> Column:
    """struct<base, suffixes>: endings peeled from the right, first fit in table order, until none fits.

    Every ending begins with a hyphen, so a word has no more endings than hyphens and the fold is that long.
    """

    def ending(rest: Column) -> Column:
        return reduce(lambda found, row: F.when(rest.endswith(row[0]), _suffix(row)).otherwise(found), reversed(SUFFIXES), F.lit(None).cast(_SUFFIX_TYPE))

    def step(state: Column, _: Column) -> Column:
        found = ending(state["base"])
        shorter = F.length(state["base"]) - F.length(found["spelling"])
        return F.when(found.isNull(), state).otherwise(
            F.struct(F.substr(state["base"], F.lit(1), shorter).alias("base"), F.concat(F.array(found), state["suffixes"]).alias("suffixes"))
        )

    start = F.struct(word.alias("base"), F.array().cast(f"array<{_SUFFIX_TYPE}>").alias("suffixes"))
    hyphens = F.filter(F.split(word, ""), lambda c: c == "-")
    return F.when(word.isNotNull(), F.aggregate(hyphens, start, step))


def outermost_case(suffixes: Column) -> Column:
    """Role of the last ending that marks a case, or null."""
    return F.try_element_at(F.filter(suffixes, lambda s: s["kind"] == "case"), F.lit(-1))["role"]


def verbal_prefixes(word: Column) -> Column:
    """The leading pieces of a hyphenated word that are verb prefixes, joined by hyphens; null if there is none.

    The last piece is the root and never part of the chain.
    """
    parts = F.split(word, "-")
    ahead = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def step(state: Column, piece: Column) -> Column:
        going = state["going"] & piece.isin(*VERB_PREFIXES)
        return F.struct(going.alias("going"), F.when(going, F.concat(state["chain"], F.array(piece))).otherwise(state["chain"]).alias("chain"))

    start = F.struct(F.lit(True).alias("going"), F.array().cast("array<string>").alias("chain"))
    chain = F.aggregate(ahead, start, step)["chain"]
    return F.when(F.size(chain) > 0, F.array_join(chain, "-"))


def morph_slots(template: Column) -> Column:
    """struct<pre, suf> of a slot-encoded template: mu.na.n:~;a gives [mu, na, n] and [a].

    The base stands at the last ':~', else at the first '~'; a template without either is all prefix.
    """
    last = r"^(.*):~(.*)$"
    first = r"^([^~]*)~(.*)$"
    pre = F.when(template.contains(":~"), F.regexp_extract(template, last, 1)).when(template.contains("~"), F.regexp_extract(template, first, 1)).otherwise(template)
    suf = F.when(template.contains(":~"), F.regexp_extract(template, last, 2)).when(template.contains("~"), F.regexp_extract(template, first, 2)).otherwise("")
    full = lambda parts: F.filter(parts, lambda s: s != "")
    return F.when(template.isNotNull(), F.struct(full(F.split(pre, r"\.")).alias("pre"), full(F.split(suf, "[;,]")).alias("suf")))


def matches_features(
    template: Column,
    polarity: str = "affirm",
    prefix: str | None = None,
    dimensional: list[str] | None = None,
    object_person: str | None = None,
) -> Column:
    """Whether a template has the asked features, slot by slot from the left.

    Negation is a first slot nu, then the conjugation prefix; the object marker is the last slot; the dimensional markers
    asked for stand in between in their order, others may be among them. "affirm" without a prefix does not exclude nu.
    """
    pre = morph_slots(template)["pre"]
    wanted = [DIMENSIONS[d] for d in DIMENSIONS if d in (dimensional or [])]
    start, tests = 1, []
    if polarity == "neg":
        tests.append(F.coalesce(F.get(pre, F.lit(0)) == "nu", F.lit(False)))
        start += 1
    if prefix is not None:
        if not CONJUGATION[prefix]:
            if object_person or wanted:
                return F.lit(False)
            tests.append(F.size(pre) == start - 1)
            return reduce(lambda a, b: a & b, tests)
        tests.append(F.coalesce(F.get(pre, F.lit(start - 1)) == CONJUGATION[prefix], F.lit(False)))
        start += 1
    tail = F.slice(pre, start, F.greatest(F.size(pre) - (start - 1), F.lit(0)))
    if object_person is not None:
        tests.append(F.coalesce(F.try_element_at(tail, F.lit(-1)) == OBJECTS[object_person], F.lit(False)))
        tail = F.slice(tail, 1, F.greatest(F.size(tail) - 1, F.lit(0)))
    if wanted:
        sought = F.array(*[F.lit(w) for w in wanted])
        reached = F.aggregate(tail, F.lit(0), lambda at, slot: at + F.when(F.get(sought, at) == slot, 1).otherwise(0))
        tests.append(reached == len(wanted))
    test = reduce(lambda a, b: a & b, tests, F.lit(True))
    if prefix is None:
        bare = F.lit(object_person is None and not wanted and polarity == "affirm")
        test = F.when(F.size(pre) == 0, bare).otherwise(test)
    return F.when(template.isNull(), F.lit(False)).otherwise(test)


def is_imperfective(template: Column) -> Column:
    return F.exists(morph_slots(template)["suf"], lambda s: s.isin(*IMPERFECTIVE))


def has_nominalizer(template: Column) -> Column:
    return F.array_contains(morph_slots(template)["suf"], "a")


def is_reduplicated(template: Column) -> Column:
    return F.length(template) - F.length(F.replace(template, F.lit("~"), F.lit(""))) > 1


def synthesize(template: Column, base: Column) -> Column:
    """A spelling made from a template: ~ is the base, all separators become hyphens."""
    dashed = F.translate(template, ".:;,", "----")
    spaced = F.replace(dashed, F.lit("~"), F.lit("-~-"))
    filled = F.replace(spaced, F.lit("~"), base)
    return F.regexp_replace(F.regexp_replace(filled, "-+", "-"), "^-|-$", "")


def phrase_role(case: Column, top_pos: Column, has_candidates: Column) -> Column:
    """Role of a nominal word from its outermost case, else from its part of speech, else from being known at all."""
    by_case = F.coalesce(F.try_element_at(_as_map(CASE_ROLES), case), F.lit("unknown"))
    return (
        F.when(case.isNotNull(), by_case).when(top_pos == "AJ", "adjective_modifier").when(has_candidates, "noun_head_unmarked").otherwise("unknown")
    )


def role_label(role: Column) -> Column:
    return F.coalesce(F.try_element_at(_as_map(ROLE_LABELS), role), F.lit("?"))


def skeleton(chunks: Column) -> Column:
    """Skeleton of an ordered array of struct<text, adjective>: an adjective is spliced into the bracket before it."""

    def step(parts: Column, chunk: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-1))
        spliced = F.concat(F.substr(last, F.lit(1), F.length(last) - 1), F.lit(" +ADJ:"), chunk["text"], F.lit("]"))
        inside = F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(spliced))
        alone = F.concat(parts, F.array(F.concat(F.lit("[ADJ "), chunk["text"], F.lit("]"))))
        return F.when(chunk["adjective"] & last.endswith("]"), inside).when(chunk["adjective"], alone).otherwise(F.concat(parts, F.array(chunk["text"])))

    joined = F.array_join(F.aggregate(chunks, F.array().cast("array<string>"), step), " ")
    return F.when(F.size(chunks) > 0, joined).otherwise("(empty input)")
