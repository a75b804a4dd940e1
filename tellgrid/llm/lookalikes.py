"""Visually identical text with different characters: one consistent spelling for look-alikes and invisible characters.

The tokens of an unusual value are read as they stand, in units: a base letter with its accents, or a character that cannot be
seen. A trie of the collection's own vocabulary is walked with a weighted edit automaton: a unit may step to itself or to any
letter it may be taken for at no cost, what cannot be seen costs nothing, any other edit costs 1 (and ``most`` 0 allows
none). Of the tokens reached at the least cost the commonest is the canonical spelling. Tokens that reach none are normalized
by table. A word that is wholly written in another script, with a letter there that looks like none of the project's, is no
look-alike and stays, and so do the words in that script beside it.

Only values that hold something unusual take part; all others are told by one JVM expression to be in the consistent form.
Vocabulary and tokens are brought together by the skeleton that look-alike tokens share and pass by in its order, so a trie
holds one batch of the vocabulary at a time and nothing is broadcast.

Defined results
---------------
* a null value is no case and stays null; an empty value is consistent; an only-blank value becomes empty;
* index digits, raised figures, fractions, primes, daggers, sign-name punctuation and cuneiform stay as they are, and so does
  a Roman numeral that stands by itself (inside a word its letters are look-alikes);
* an apostrophe before a capital in a word with small letters (O'Neil) is one, elsewhere beside a letter it may stand for ʾ;
* an accented letter is composed where Unicode has one character for it and left alone where it has none;
* repeated values get the same spelling; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellgrid.session import ship, unused

#: Characters of other scripts and blocks that look like a letter (fixed values): letter -> its look-alikes.
LOOKALIKES = {
    "a": "аɑα⍺", "b": "ЬƄ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "еҽ℮", "f": "ƒ", "g": "ɡց", "h": "һհ", "i": "іιıɩ", "j": "јϳ", "k": "κкᴋ",
    "l": "ӏⅼ∣", "m": "ⅿᴍ", "n": "ոռ", "o": "оοօσ", "p": "рρ", "q": "ԛզ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτᴛ", "u": "սυᴜ", "v": "νѵⅴ",
    "w": "ԝωѡ", "x": "хⅹ", "y": "уү", "z": "ᴢ", "ŋ": "ƞղη", "ʾ": "ʼ’'ʹ՚ˀ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹⅭ", "D": "ⅮᎠ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙⅠӀ", "J": "ЈᎫ", "K": "КΚᏦ", "L": "ⅬᏞ",
    "M": "МΜⅯ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "ᎡᏒ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Սᑌ", "V": "ѴⅤᏙ", "W": "ԜᎳ",
    "X": "ХΧⅩ", "Y": "УΥҮ", "Z": "ΖᏃ",
}
#: Dashes that look like the ordinary hyphen (fixed values).
HYPHENS = "‐‑‒–—―−﹣－﹘⁃˗"
#: Invisible characters outside the Unicode category of format characters (fixed values).
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\u180e"

#: Look-alikes of which the table takes one letter and that may stand for another too (fixed values).
ALSO = {"ƞ": "n", "ղ": "n", "η": "n"}
_LETTER = {look: letter for letter, looks in LOOKALIKES.items() for look in looks}
#: ASCII characters that stand in for another inside a word, by the case of the word (fixed values).
_INSIDE_SMALL = {"I": "l", "1": "l"}
_ASCII = {"I": ("I", "l"), "1": ("1", "l"), "l": ("l", "I")}
_MARKS = "\u0300-\u036f"
_NUMERALS = re.compile("[Ⅰ-ⅿ]+")


def _hidden(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in INVISIBLE or "\ufe00" <= c <= "\ufe0f"


def _seen(text: str) -> str:
    return "".join(c for c in text if not _hidden(c))


def _letter(c: str) -> str:
    if "！" <= c <= "～":  # full-width forms
        return chr(ord(c) - 0xFEE0)
    return _LETTER.get(c, c)


@lru_cache(maxsize=1 << 16)
def by_table(text: str) -> str:
    """The consistent form by table alone, but for characters that only a word's own spelling can tell (I or 1 for l)."""
    out = []
    for c in _seen(text):
        if c in HYPHENS:
            out.append("-")
        elif unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\t\n\r\v\f":
            out.append(" ")
        else:
            out.append(_letter(c))
    return unicodedata.normalize("NFC", "".join(out))


@lru_cache(maxsize=1 << 16)
def _options(unit: str) -> tuple[str, ...]:
    """What a unit (a base letter and its accents) may be taken for, itself first; nothing for what cannot be seen."""
    base, *marks = unicodedata.normalize("NFD", unit)
    letters = [base, *_ASCII.get(base, ()), _letter(base), *ALSO.get(base, "")]
    return tuple(dict.fromkeys(unicodedata.normalize("NFC", x + "".join(marks)) for x in letters))


def units(token: str) -> list[str]:
    """Base letters with the accents that follow them; what cannot be seen is a unit of its own and parts no accent from its letter."""
    out: list[str] = []
    last = -1
    for c in token:
        if _hidden(c):
            out.append("")
        elif unicodedata.combining(c) and last >= 0:
            out[last] += c
        else:
            last = len(out)
            out.append(c)
    return out


#: Letters that some unit may be taken for alike (fixed values).
_SAME = {"I": "l", "1": "l", "ŋ": "n"}


@lru_cache(maxsize=1 << 16)
def _bone(unit: str) -> str:
    base, *marks = unicodedata.normalize("NFD", unit)
    base = _letter(base)
    return unicodedata.normalize("NFC", _SAME.get(base, base) + "".join(marks))


def skeleton(token: str) -> str:
    """What all tokens share that look the same."""
    return "".join(_bone(u) for u in units(token) if u)


#: The same for the letters a clean token may have, as a translation.
_LETTERS = [chr(c) for c in (*range(0x21, 0x250), *range(0x1E00, 0x1F00)) if skeleton(chr(c)) != chr(c) and len(skeleton(chr(c))) == 1]
_FOLD = ("".join(_LETTERS), "".join(map(skeleton, _LETTERS)))


def settle(token: str) -> str:
    """A tabled token of which the vocabulary knows no look-alike: I and 1 between small letters are l, l between capitals is I."""
    small = sum(c.islower() for c in token.replace("l", ""))
    capital = sum(c.isupper() for c in token.replace("I", ""))
    if small and small >= capital:
        return "".join(_INSIDE_SMALL.get(c, c) if c in "I1" else c for c in token)
    if capital and not small:
        return "".join("I" if c in "l1" else c for c in token)
    return token


class Trie:
    """A vocabulary with counts."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, token: str, count: int) -> None:
        node = self.root
        for c in token:
            node = node.setdefault(c, {})
        node[""] = (count, token)

    def look_alikes(self, token: str, most: int = 0) -> list[tuple[int, int, str]]:
        """(cost, count, spelling) of all entries within ``most``: look-alikes and what cannot be seen are free, other edits cost 1."""
        states = self._skips([(self.root, 0)], most)
        for unit in units(token):
            if not unit:
                continue
            options, reached = _options(unit), {}
            for node, cost in states:
                steps = [(node[x], cost) for x in options if len(x) == 1 and x in node]
                steps += [(end, cost) for x in options if len(x) > 1 and (end := self._down(node, x)) is not None]
                if cost < most:  # another letter, or one too many
                    steps += [(child, cost + 1) for x, child in node.items() if x and x not in options] + [(node, cost + 1)]
                for there, price in steps:
                    if reached.get(id(there), (None, most + 1))[1] > price:
                        reached[id(there)] = there, price
            states = self._skips(list(reached.values()), most)
            if not states:
                return []
        return [(cost, *node[""]) for node, cost in states if "" in node]

    @staticmethod
    def _down(node: dict, letters: str) -> dict | None:
        for c in letters:
            node = node.get(c)
            if node is None:
                return None
        return node

    @staticmethod
    def _skips(states: list, most: int) -> list:
        """The states, and those that a missing letter leads to."""
        best = {id(node): (node, cost) for node, cost in states}
        waiting = [s for s in states if s[1] < most]
        while waiting:
            node, cost = waiting.pop()
            for x, child in node.items():
                if x and best.get(id(child), (None, most + 1))[1] > cost + 1:
                    best[id(child)] = child, cost + 1
                    if cost + 1 < most:
                        waiting.append((child, cost + 1))
        return list(best.values())


def _script(c: str) -> str:
    """The script of a letter, as its Unicode name begins; empty for others."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


@lru_cache(maxsize=1 << 14)
def _foreign(c: str) -> str:
    """The other script that a letter belongs to, and whether it looks like none of the project's letters ('!' behind the script)."""
    base = unicodedata.normalize("NFD", c)[0]
    script = _script(base)
    if not script or script in ("LATIN", "MODIFIER", "CUNEIFORM", "FULLWIDTH") or unicodedata.category(base) in ("Lm", "Nl"):
        return ""
    return script + "!" * (_letter(base) == base)


def _is_word(text: str, at: int) -> bool:
    """A character of a token: letters, figures and accents, and what may stand for a letter where it touches one."""
    c = text[at]
    if c.isalnum() or unicodedata.category(c)[0] == "M":
        return True
    return c in _LETTER and (text[at - 1 : at].isalpha() or text[at + 1 : at + 2].isalpha())


def parts_of(value: str) -> list[tuple[bool, str]]:
    """The tokens of a value as they stand (true) and what is between them (false)."""
    out: list[tuple[bool, str]] = []
    seen = [i for i, c in enumerate(value) if not _hidden(c)]
    bare = "".join(value[i] for i in seen)
    word = dict.fromkeys(range(len(value)))
    for k, i in enumerate(seen):
        word[i] = _is_word(bare, k)
    held = False
    for i, c in enumerate(value):
        is_word = held if word[i] is None else word[i]  # what cannot be seen goes with what is before it
        if out and out[-1][0] == is_word:
            out[-1] = is_word, out[-1][1] + c
        else:
            out.append((is_word, c))
        held = is_word
    return out


def split_value(value: str) -> list[tuple[bool, str]]:
    """Tokens to be looked up (true), and what has its final form already (false)."""
    parts = parts_of(value)
    # scripts of which a word of the value has a letter like none of the project's
    real = {f[:-1] for is_word, p in parts if is_word and (known := {_foreign(c) for c in _seen(p) if c.isalpha()}) and "" not in known for f in known if f[-1:] == "!"}
    out = []
    for is_word, part in parts:
        if not is_word:
            out.append((False, by_table(part)))
            continue
        seen = _seen(part)
        own = {_foreign(c).rstrip("!") for c in seen if c.isalpha()}
        apostrophe = re.search(r"'([^\W\d_])", seen)
        name = apostrophe is not None and apostrophe.group(1).isupper() and any(c.islower() for c in seen)
        if (own and "" not in own and own <= real) or name or _NUMERALS.fullmatch(seen):
            out.append((False, unicodedata.normalize("NFC", seen)))
        else:
            out.append((True, part))
    return out


def unusual(value: Column) -> Column:
    """True for values that may not be in the consistent form; the others surely are."""
    strange = value.rlike(r"[^\x20-\x7e¡-¬®-ɏḀ-ỿʾ⁰-ₜ†‡′-‴⅐-↋\x{12000}-\x{1254f}]")
    spaces = value.rlike(r"^ | $|  ")
    inside = value.rlike(r"(?:[a-zß-ÿāŋšḫʾ][I1'])|(?:[I1'][a-zß-ÿŋšḫʾ])|(?:[A-ZŊŠḪ][l1])|(?:[l1][A-ZŊŠḪ])")
    lookalike_latin = value.rlike(r"[ıƄƅƒƞ]")
    numeral = value.rlike(r"\p{L}[Ⅰ-ⅿ]|[Ⅰ-ⅿ]\p{L}")
    return strange | spaces | inside | lookalike_latin | numeral


#: What separates the tokens of a clean value (for the vocabulary, in the JVM).
_APART = r"[^\p{L}\p{N}\p{M}]+"


def spell(token: str, trie: Trie, most: int = 0) -> str:
    """The canonical spelling of a token as it stands."""
    found = trie.look_alikes(token, most) if any(c.isalpha() and c not in "lI" for c in token) else []
    if found:
        # the commonest spelling; ties go to the one that sorts last, where small l stands after I and 1
        return min(found, key=lambda f: (f[0], -f[1], [-ord(c) for c in f[2]]))[2]
    return settle(by_table(token))


def canonical_values(values: DataFrame, value: str, vocabulary: DataFrame, token: str, count: str) -> DataFrame:
    """``value`` and its ``canonical`` form for distinct, non-null ``values``; ``vocabulary`` has distinct clean tokens."""
    ship(values.sparkSession)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(v, at, is_word, part, skeleton(part) if is_word else "") for v in batch["_v"] for at, (is_word, part) in enumerate(split_value(v) or [(False, "")])]
            yield pd.DataFrame(rows, columns=["_v", "_at", "_is", "_part", "_skeleton"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by skeleton; the last skeleton of a batch may go on in the next."""
        rest = None
        for batch in _then_none(batches):
            rows = batch if rest is None else rest if batch is None else pd.concat([rest, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            open_ = None if batch is None else rows["_skeleton"].iloc[-1]
            now = rows if open_ is None else rows[rows["_skeleton"] != open_]
            rest = None if open_ is None else rows[rows["_skeleton"] == open_]
            trie = Trie()
            known = now[now["_count"] > 0]
            for t, n in zip(known["_token"], known["_count"]):
                trie.add(t, int(n))
            wanted = now.loc[now["_count"] == 0, "_token"].tolist()
            yield pd.DataFrame({"_token": wanted, "_spelt": [spell(t, trie) for t in wanted]}, dtype=object)

    parts = values.select(F.col(value).alias("_v")).mapInPandas(split, "_v string, _at int, _is boolean, _part string, _skeleton string")
    wanted = parts.filter("_is").select(F.col("_part").alias("_token"), "_skeleton").distinct()
    known = vocabulary.select(F.col(token).alias("_token"), F.translate(F.col(token), *_FOLD).alias("_skeleton"), F.col(count).cast("bigint").alias("_count"))
    known = known.join(wanted.select("_skeleton").distinct(), "_skeleton", "left_semi")
    both = wanted.withColumn("_count", F.lit(0).cast("bigint")).unionByName(known)
    spelt = both.repartition("_skeleton").sortWithinPartitions("_skeleton").mapInPandas(walk, "_token string, _spelt string")
    joined = parts.join(spelt, (parts["_part"] == spelt["_token"]) & parts["_is"], "left")
    piece = F.struct("_at", F.coalesce("_spelt", "_part").alias("_s"))
    whole = joined.groupBy("_v").agg(F.array_sort(F.collect_list(piece)).alias("_all"))
    text = F.array_join(F.transform("_all", lambda p: p["_s"]), "")
    return whole.select(F.col("_v").alias(value), F.trim(F.regexp_replace(text, " +", " ")).alias("canonical"))


def _then_none(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def consistent_form(rows: DataFrame, value: str, out: str = "canonical") -> DataFrame:
    """``rows`` whose ``value`` is not in the consistent form, with that form as ``out`` (a column of that name is replaced).

    The vocabulary is made of the tokens of the values that are.
    """
    given = rows.filter(F.col(value).isNotNull())
    odd = given.filter(unusual(F.col(value)))
    clean = given.filter(~unusual(F.col(value))).select(F.explode(F.split(F.col(value), _APART)).alias("_token"))
    vocabulary = clean.filter(r"_token rlike '\\p{L}'").groupBy("_token").agg(F.count(F.lit(1)).alias("_count"))
    forms = canonical_values(odd.select(value).distinct(), value, vocabulary, "_token", "_count")
    (held,) = unused(rows, "_value")
    forms = forms.select(F.col(value).alias(held), F.col("canonical").alias(out)).filter(~F.col(held).eqNullSafe(F.col(out)))
    return odd.drop(out).join(forms, odd[value] == forms[held]).drop(held)
