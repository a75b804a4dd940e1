"""Mapping freely typed values to a canonical list; what matches nothing, or several entries alike, is reported as 0.

A typed value is read in steps: words that say nothing (``fillers``) are dropped, a date range is taken out, a name typed
backwards at a comma is turned round, numerals are compared as numbers. What is left of the name is looked up in a BK-tree
over the reference names under a true edit metric, which returns every entry within the radius; before it abbreviations
(N. Tarsumic) and after it initials (NT) are read as such. The nearest entry wins; a tie is no match. Two names joined by
"or", "and", "to", "&", "/" or ";" are a value of several entries, unless the list has a name with such a joint that is
meant (Trinidad and Tobago): the whole value is looked up among those first.

A word that by itself sets entries apart (``qualifiers``: old, early, neo ...) is taken as typed: if it is spelled right it
must be part of the entry, so "Late X" never becomes "Neo-X" though they are few edits apart.

A reference of at most ``shard`` entries is broadcast, and values are matched where they lie (a bounded memo per task spares
repeats), so nothing is shuffled. A larger one never leaves the executors: it is cut into shards of that size by hash, every
distinct value passes every shard's tree, and the candidates of all shards are merged. A shard answers with the step at
which it found an entry, its distance and whether its dates fit, and all choices between candidates are made in the merge,
so the answer is the same for any size of shard.

Defined results
---------------
* a null value gives null; an empty or blank one gives 0; an exact name gives its own entry;
* an empty reference gives 0 for everything; a reference with the same name twice (under different ids) gives 0 for that name;
* reference rows with a null name or id are left out; repeated ones count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellgrid.llm.bktree import BKTree, edit_distance
from tellgrid.session import ship, unused, width

#: Reference entries of a shard (of a BK-tree); the bound of what is broadcast.
SHARD = 50_000
#: Values remembered by a task.
MEMO = 1 << 16

_RANGE = re.compile(r"(?<!\d)(\d{2,5})\s*(?:[-‐-―−]|\bto\b)\s*(\d{2,5})(?!\d)")
_SEVERAL = re.compile(r"\s*(?:;|/|\bor\b|\band\b|\bto\b|&)\s*", re.I)
_NUMERAL = re.compile(r"^(i{1,3}|iv|vi{0,3}|ix|x)([a-d]?)$")
_DIGITS = re.compile(r"^(\d{1,2})([a-d]?)$")
_ROMAN = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")


def _numeral(token: str) -> str | None:
    if m := _NUMERAL.match(token):
        return m.group(0)
    if (m := _DIGITS.match(token)) and 0 < int(m.group(1)) < len(_ROMAN):
        return _ROMAN[int(m.group(1))] + m.group(2)
    return None


def _words(name: str) -> list[str]:
    """Lower-case words of a name; a word ending in a dot keeps it (an abbreviation)."""
    name = unicodedata.normalize("NFC", name)
    name = re.sub(r"(?<![^\W\d_])([^\W\d_])([^\W\d_]+)", lambda m: m.group(0) if m.group(1).islower() else m.group(1) + re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZŠ])", " ", m.group(2)), name)
    name = re.sub(r"[\s_‐-―−\-]+", " ", name.casefold().replace("&", " and "))
    return re.findall(r"[^\W_]+\.?", name)


class Entry:
    """A reference entry, read."""

    def __init__(self, ident: int, name: str, fillers: frozenset[str] = frozenset()) -> None:
        self.id, self.name = ident, name
        dated = _RANGE.search(name)
        self.years = (int(dated.group(1)), int(dated.group(2))) if dated else None
        plain = re.sub(r"[\(\[].*?[\)\]]", " ", name)
        words = [w.rstrip(".") for w in _words(plain) if w.rstrip(".") not in fillers]
        self.several = len([p for p in _SEVERAL.split(plain) if _words(p)]) > 1
        self.numeral = _numeral(words[-1]) if len(words) > 1 else None
        self.words = words[:-1] if self.numeral else words
        self.key = "".join(self.words)
        self.initials = "".join(w[0] for w in self.words) if len(self.words) + bool(self.numeral) > 1 else None


#: Edits that a name of four letters, of six, and of eight with a date range that fits may have.
_EDITS = (1, 2, 3)


def _radius(name: str, dated: bool) -> int:
    """Edits within which a listed name is meant, by its length."""
    return 0 if len(name) < 4 else _EDITS[0] if len(name) < 6 else _EDITS[2] if dated and len(name) > 7 else _EDITS[1]


def _abbreviates(typed: str, word: str) -> bool:
    """A dotted word stands for one that has its letters in this order and the same first one."""
    letters = typed.rstrip(".")
    if not letters or letters[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in letters)


#: Steps at which an entry is found (fixed values); the first step that finds anything decides. YEARS says that dates are known.
EXACT, SHORTENED, SPELLED, INITIALS, DATED, YEARS = range(6)
#: step, distance, entry, whether its dates are the value's
Candidate = tuple[int, int, int, bool]


class Matcher:
    """Looks values up in one shard of the reference."""

    def __init__(self, rows: list[tuple[int, str]], qualifiers: frozenset[str] = frozenset(), fillers: frozenset[str] = frozenset()) -> None:
        self.qualifiers, self.fillers = qualifiers, fillers
        self.entries = [Entry(i, n, fillers) for i, n in rows if n]
        self.exact: dict[str, set[int]] = {}
        self.years: dict[tuple[int, int], set[int]] = {}
        for e in self.entries:
            self.exact.setdefault(e.name, set()).add(e.id)
            if e.years:
                self.years.setdefault(e.years, set()).add(e.id)
        self.tree = BKTree((e.key, e) for e in self.entries)
        # abbreviated names are looked for among the entries with as many words and the same numeral, initials by themselves
        self.shapes: dict[tuple, list[Entry]] = {}
        self.initials: dict[tuple, list[Entry]] = {}
        for e in self.entries:
            for place, word in enumerate(e.words):
                self.shapes.setdefault((len(e.words), e.numeral, place, word[0]), []).append(e)
            if e.initials:
                self.initials.setdefault((e.initials, e.numeral), []).append(e)

    def names(self, text: str, years: tuple[int, int] | None, several: bool) -> list[Candidate]:
        """Entries that a single name may mean, by the first step that finds any in this shard."""
        words = [w for w in _words(",".join(reversed(text.split(","))) if text.count(",") == 1 else text) if w.rstrip(".") not in self.fillers]
        if not words:
            return []
        # the last word that reads as a numeral is one, if the name has another word ("V II": initial and numeral)
        at = next((i for i in range(len(words) - 1, -1, -1) if _numeral(words[i])), None) if len(words) > 1 else None
        numeral = _numeral(words[at]) if at is not None else None
        rest = [w for i, w in enumerate(words) if i != at]
        plain = [w.rstrip(".") for w in rest]
        key = "".join(plain)
        found: dict[int, Candidate] = {}

        def add(step: int, distance: int, entry: Entry) -> None:
            if several <= entry.several and (entry.id not in found or distance < found[entry.id][1]):
                found[entry.id] = step, distance, entry.id, years is not None and entry.years == years

        dotted = next((i for i, w in enumerate(rest) if w.endswith(".")), None)
        if dotted is not None:
            for entry in self.shapes.get((len(rest), numeral, dotted, rest[dotted][0]), ()):
                near = [0 if t.endswith(".") and _abbreviates(t, w) else edit_distance(t.rstrip("."), w) for t, w in zip(rest, entry.words)]
                if all(d <= _radius(w, False) for d, w in zip(near, entry.words)):
                    add(SHORTENED, sum(near), entry)
        if not found:
            strict = {w for w in plain if w in self.qualifiers}
            for distance, own, entry in self.tree.within(key, max(_EDITS)):
                # a word that the listed one merely goes on from (a place, the people of it) is a word of its own
                fits = years is not None and entry.years == years
                if distance > _radius(own, fits) or (own.startswith(key) and len(own) - len(key) > 1):
                    continue
                if entry.numeral == numeral and strict <= set(entry.words) and not self._lacks(plain, entry):
                    add(SPELLED, distance, entry)
        if not found and (len(plain) == 1 or all(len(w) == 1 for w in plain)):
            for entry in self.initials.get((key, numeral), ()):
                add(INITIALS, 0, entry)
        return list(found.values())

    def _lacks(self, plain: list[str], entry: Entry) -> bool:
        """The entry has a qualifier of which the value has no trace."""
        own = [w for w in entry.words if w in self.qualifiers]
        return bool(own) and len(plain) < len(entry.words) and not any("".join(plain).startswith(w[:2]) or w in "".join(plain) for w in own)

    def candidates(self, value: str) -> list[Candidate]:
        """What this shard has for a value."""
        if value in self.exact:
            return [(EXACT, 0, i, True) for i in sorted(self.exact[value])]
        dated = _RANGE.search(value)
        years = (int(dated.group(1)), int(dated.group(2))) if dated else None
        ids = self.years.get(years, set()) if years else set()
        known: list[Candidate] = [(YEARS, 0, 0, True)] if ids else []
        name = value[: dated.start()] + " " + value[dated.end() :] if dated else value
        name = re.sub(r"\b[Bb]\.?\s?[Cc]\.?(\s?[Ee]\.?)?(?=\W|$)", " ", name)
        parts = [p for p in _SEVERAL.split(name) if any(w.rstrip(".") not in self.fillers for w in _words(p))]
        if not parts:
            return known + [(DATED, 0, i, True) for i in sorted(ids)]
        return known + self.names(name if len(parts) > 1 else parts[0], years, len(parts) > 1)


def decide(candidates: list[Candidate]) -> int:
    """The entry that the candidates of all shards together mean, or 0."""
    found = [c for c in candidates if c[0] != YEARS]
    if not found:
        return 0
    step = min(c[0] for c in found)
    found = [c for c in found if c[0] == step and (c[3] or len(found) == len(candidates))]
    if not found:
        return 0
    best = min(c[1] for c in found)
    near = {c[2] for c in found if c[1] == best}
    return min(near) if len(near) == 1 else 0


@lru_cache(maxsize=1)
def _built(rows: tuple, qualifiers: frozenset[str], fillers: frozenset[str]) -> Matcher:
    return Matcher(list(rows), qualifiers, fillers)


def match_values(
    df: DataFrame, value: str, reference: DataFrame, ident: str, name: str, out: str, shard: int = SHARD,
    qualifiers: frozenset[str] = frozenset(), fillers: frozenset[str] = frozenset(),
) -> DataFrame:
    """``df`` with the int column ``out``: the entry that ``value`` means, or 0."""
    spark = df.sparkSession
    ship(spark)
    listed = reference.select(F.col(ident).cast("int").alias("_id"), F.col(name).alias("_v")).filter("_id is not null and _v is not null").distinct()
    # at most shard + 1 rows come to the driver
    some = sorted((r[0], r[1]) for r in listed.limit(shard + 1).collect())
    if len(some) <= shard:
        only = spark.sparkContext.broadcast(tuple(some))

        @F.pandas_udf("int")
        def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = _built(only.value, qualifiers, fillers)

            @lru_cache(maxsize=MEMO)
            def one(v: str) -> int:
                return decide(matcher.candidates(v))

            for batch in batches:
                yield pd.Series([None if v is None else one(v) for v in batch], dtype="Int32")

        return df.withColumn(out, look_up(F.col(value)))

    shards = -(-listed.count() // shard)
    # the values of a shard are spread over blocks, each of which gets the shard's entries ahead of its values
    blocks = max(1, -(-width(spark) // shards))
    entries = listed.select("_id", "_v", F.pmod(F.xxhash64("_v"), F.lit(shards)).alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    values = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v")).distinct()
    values = values.select(F.lit(None).cast("int").alias("_id"), "_v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("_shard"), F.pmod(F.xxhash64("_v"), F.lit(blocks)).cast("int").alias("_block"))
    met = entries.unionByName(values).withColumn("_entry", F.col("_id").isNotNull()).repartition("_shard", "_block").sortWithinPartitions("_shard", "_block", F.col("_entry").desc())

    def pass_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, matcher = None, [], None
        for batch in batches:
            for place, part in batch.groupby(["_shard", "_block"], sort=False):
                if place != held:
                    held, rows, matcher = place, [], None
                own = part["_entry"].to_numpy(bool)
                rows += [(int(i), n) for i, n in zip(part["_id"][own], part["_v"][own])]
                asked = part["_v"][~own]
                if not len(asked):
                    continue
                matcher = matcher or Matcher(sorted(rows), qualifiers, fillers)
                found = [(v, *c) for v in asked for c in matcher.candidates(v)]
                if found:
                    yield pd.DataFrame(found, columns=["_v", "_step", "_d", "_id", "_fits"])

    @F.pandas_udf("int")
    def merge(all_: pd.Series) -> pd.Series:
        return pd.Series([decide([(c["_step"], c["_d"], c["_id"], c["_fits"]) for c in row]) for row in all_], dtype="int32")

    # a candidate for each entry within the radius; the years of a value are known or not, once
    hits = met.mapInPandas(pass_by, "_v string, _step int, _d int, _id int, _fits boolean").distinct()
    decided = hits.groupBy("_v").agg(F.collect_list(F.struct("_step", "_d", "_id", "_fits")).alias("_all")).select("_v", merge("_all").alias("_id"))
    held, found = unused(df, "_v", "_id")
    decided = decided.toDF(held, found)
    joined = df.join(decided, df[value] == decided[held], "left")
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), F.coalesce(found, F.lit(0))).cast("int")).drop(held, found)
