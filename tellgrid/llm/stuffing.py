"""Keyword-stuffed and link-list pages.

The suffixes of every page are sorted by their first ``LEAST_REPEAT`` characters (the page's suffix array, cut at that
depth), which finds every repeated stretch of at least so many characters; the characters under such maximal repeats are the
page's repeated cover. A suffix automaton of the characters gives the same cover (the tests compare them) at many times the
cost of array arithmetic. A page's other measure is its missing clause structure: the share of the text in stretches that
are no sentences, in links, and in sentences that serve to repeat the page's keyword. Lines in the form of a record, ledger,
index, word list or edition lack clauses too, but have a structure of their own and count by ``RECORD`` only.

A page is a case if more than ``MOST`` of it lacks clauses, and cover times missing structure is at least ``LEAST_SCORE``: a
list of names or signs that says nothing twice is none, nor is a litany that repeats itself in sentences.

Defined results
---------------
* null, empty and blank texts and texts without words are no cases; no language is needed, and none is assumed;
* whole texts are read; a repeated row comes out as often as it comes in; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellgrid.session import ship

#: Share of the text that must be made for search engines (the problem's "most"), and what a line in record form counts.
MOST, RECORD = 0.5, 0.25
#: Least length of a repeat in characters: shorter ones are shared by chance, by any text of a page's length.
LEAST_REPEAT = 7
#: Least product of cover and missing clause structure.
LEAST_SCORE = 0.275
#: Mentions a sentence of the page's keyword from which sentences are taken to serve it.
MENTIONS = 1.3
#: Share of such sentences' words that the keyword's first two words make up.
DENSITY = 0.2

_WORD = re.compile(r"[^\W_]+(?:[̀-ͯ'’][^\W_]*)*")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|net|org|info|biz|example|test|invalid|[a-z]{2})/\S*|</?a\b[^>]*>|\]\([^)\s]*\)", re.I)
#: A sentence ends with . ! or ? before white space or the end, perhaps with a closing quote or bracket.
_SENTENCE = re.compile(r"[^\n]*?[.!?]+[\"'»”’)\]]*(?=\s|$)|[^\n]+")
_ENDED = re.compile(r"[.!?]+[\"'»”’)\]]*\s*$")
#: Lines of scholarly lists (fixed forms): numbered edition lines, quantities, glosses, index entries with page numbers, labelled fields.
_EDITION = re.compile(r"^\s*(?:(?:obv|rev|o|r|col|seal|edge|[ivx]+)[.\s]*){0,3}\d+[a-z]?['′]?\.\s", re.I)
_QUANTITY = re.compile(r"^\s*\d+(?:[./]\d+)?\s*\([^)]*\)\s*\S")
_GLOSS = re.compile(r"^\s*[^\s=:–—\t|]+(?:\s[^\s=:–—\t|]+)?\s*(?:\s[=–—:]\s|\t)\s*\S+(?:\s\S+){0,3}\s*$")
_INDEX = re.compile(r"^\s*[^,;]{1,40}(?:,\s*\d{1,4}(?:[-–]\d{1,4})?)+\s*$")
_FIELD = re.compile(r"^\s*[^\W\d_][\w ]{1,24}:\s+\S")


def character_cover(text: str, least: int = LEAST_REPEAT) -> float:
    """Share of the characters under stretches of at least ``least`` characters that the text repeats, whatever their case."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = len(codes) - least + 1
    if starts < 2:
        return 0.0
    signs, codes = np.unique(codes, return_inverse=True)
    # a number for the first characters of every suffix; numbers that get too large are replaced by their ranks
    keys, largest = np.zeros(starts, np.int64), 1
    for at in range(least):
        if largest > (1 << 62) // len(signs):
            ranked, keys = np.unique(keys, return_inverse=True)
            largest = len(ranked)
        keys = keys * len(signs) + codes[at : starts + at]
        largest *= len(signs)
    order = np.sort(keys)
    repeated = order[1:][order[1:] == order[:-1]]
    if not len(repeated):
        return 0.0
    found = np.flatnonzero(repeated[np.minimum(np.searchsorted(repeated, keys), len(repeated) - 1)] == keys)
    edges = np.zeros(len(codes) + 1, np.int32)
    edges[found] += 1
    edges[found + least] -= 1
    return float(np.count_nonzero(np.cumsum(edges[:-1]))) / len(codes)


def _is_sentence(piece: str) -> bool:
    """It ends as one, begins as one (not with a small letter), and has three words, of which not all others are names or shouted."""
    if not _ENDED.search(piece):
        return False
    words = _WORD.findall(piece)
    if len(words) < 3 or next((c for c in piece if c.isalpha()), "").islower():
        return False
    return any(w[0].islower() for w in words[1:]) or not any(w[0].isupper() for w in words)


def _is_record(line: str) -> bool:
    if _QUANTITY.match(line) or _EDITION.match(line) or _INDEX.match(line) or _GLOSS.match(line):
        return True
    pieces = line.split(";")
    return len(pieces) > 1 and sum(1 for p in pieces if _INDEX.match(p)) * 2 > len(pieces)


def clause_shares(text: str) -> tuple[float, float, float, float]:
    """Shares of the text that are bare (no sentence and no record), marked (links), served (sentences for a keyword) and records."""
    sentences: list[str] = []
    whole = bare = marked = records = 0
    in_record = False
    for line in text.splitlines():
        body = line.strip()
        if not body:
            continue
        whole += len(body)
        pieces = _SENTENCE.findall(body)
        ended = [p for p in pieces if _is_sentence(p)]
        if len(ended) == len(pieces) and "://" not in body:
            sentences += ended
            continue
        if _is_record(body) or (in_record and line[:1].isspace()):
            in_record = True
            records += len(body)
            continue
        in_record = False
        links = sum(len(m.group()) for m in _LINK.finditer(body))
        if links * 3 > len(body) and not _ENDED.search(body):
            marked += len(body)
            continue
        sentences += ended
        field = _FIELD.match(body) is not None
        for piece in pieces:
            if piece in ended:
                continue
            if field and piece.count(" ") < 9:
                records += len(piece)
            elif _WORD.search(piece):
                bare += len(piece)
    if not whole:
        return (0.0, 0.0, 0.0, 0.0)
    return (bare / whole, marked / whole, _served(sentences) / whole, records / whole)


def _served(sentences: list[str]) -> int:
    """Characters of the sentences that serve the page's keyword: its commonest two words, named again and again."""
    if len(sentences) < 3:
        return 0
    lists = [_WORD.findall(s.lower()) for s in sentences]
    pairs: Counter = Counter()
    for words in lists:
        pairs.update(zip(words, words[1:]))
    if not pairs:
        return 0
    keyword, times = pairs.most_common(1)[0]
    if times < 4:
        return 0
    named = [(len(s), n, len(w)) for s, w in zip(sentences, lists) if (n := sum(1 for p in zip(w, w[1:]) if p == keyword))]
    mentions = sum(n for _, n, _ in named)
    if len(named) < 3 or mentions < MENTIONS * len(named) or 2 * mentions < DENSITY * sum(k for _, _, k in named):
        return 0
    return sum(size for size, _, _ in named)


def measure(text: str | None) -> tuple[float, float, bool]:
    """(share without clause structure or made to repeat a keyword, repeated cover, stuffed or not)."""
    if not text:
        return (0.0, 0.0, False)
    *made, records = clause_shares(text)
    missing, cover = sum(made) + RECORD * records, character_cover(text)
    return (missing, cover, missing > MOST and cover * missing >= LEAST_SCORE)


def stuffed_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, made, cover of the pages made for search engines."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, *measure(t)) for k, t in zip(batch["key"], batch["text"])]
            found = [(k, made, cover) for k, made, cover, stuffed in found if stuffed]
            if found:
                yield pd.DataFrame(found, columns=["key", "made", "cover"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    return rows.mapInPandas(judge, f"key {kind}, made double, cover double").withColumnRenamed("key", key)
