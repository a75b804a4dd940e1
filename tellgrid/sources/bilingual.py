"""Bilingual editions in XML: transliterated lines with their words, and translated paragraphs."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellgrid.functions.text import entity_map
from tellgrid.session import ship

_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9_]*);")
_LINES = "text_id string, line_id string, ord bigint, number string, paragraph_id string, word_pos bigint, form string, lemma string, pos string, label string, type string, title string, error string"
_PARAGRAPHS = "text_id string, position bigint, para_id string, line_range string, translation string, error string"


def _tree(content: bytes) -> ET.Element:
    known = entity_map()
    return ET.fromstring(_ENTITY.sub(lambda m: known.get(m.group(1), m.group(0)), bytes(content).decode("utf-8", errors="replace")))


def _flat(element: ET.Element) -> str:
    return html.unescape(" ".join("".join(element.itertext()).split()))


def _rows(read, columns: str):
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text_id, content in zip(batch["text_id"], batch["content"]):
                try:
                    found = list(read(text_id, _tree(content)))
                except (ET.ParseError, TypeError) as e:
                    found = [{"text_id": text_id, "error": str(e)}]
                rows += [[row.get(n) for n in names] for row in found]
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return run


def _read_lines(text_id: str, root: ET.Element) -> Iterator[dict]:
    title = root.find(".//titleStmt/title")
    yield {"text_id": text_id, "title": (_flat(title) or None) if title is not None else None}
    body, place = root.find(".//body"), 0
    for line in body.iter("l") if body is not None else ():
        words = [(i, w) for i, w in enumerate(line.iter("w")) if w.get("form")]
        if not line.get("id") or not words:
            continue
        place += 1  # counted for every line with words, also for one that is later found to repeat an id
        own = {"text_id": text_id, "line_id": line.get("id"), "ord": place, "number": line.get("n"), "paragraph_id": line.get("corresp")}
        for i, w in words:
            yield own | {"word_pos": i} | {k: w.get(k) for k in ("form", "lemma", "pos", "label", "type")}


def _read_paragraphs(text_id: str, root: ET.Element) -> Iterator[dict]:
    body = root.find(".//body")
    for position, p in enumerate(body.iter("p") if body is not None else ()):
        if p.get("id") and (text := _flat(p)):
            yield {"text_id": text_id, "position": position, "para_id": p.get("id"), "line_range": p.get("n", ""), "translation": text}


def editions(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text_id, content) of the transliterations and of the translations among archive members, paired by text_id."""
    name = F.regexp_extract("member", r"/transliterations/c\.([^/]+)\.xml$", 1)
    other = F.regexp_extract("member", r"/translations/t\.([^/]+)\.xml$", 1)
    first = members.select(F.concat(F.lit("c."), name).alias("text_id"), "content").filter("text_id <> 'c.'")
    return first, members.select(F.concat(F.lit("c."), other).alias("text_id"), "content").filter("text_id <> 'c.'")


def read_words(members: DataFrame) -> DataFrame:
    """Words of all transliterations, one row each, with a first row per text for its title; unreadable texts have error."""
    ship(members.sparkSession)
    return editions(members)[0].mapInPandas(_rows(_read_lines, _LINES), _LINES)


def read_paragraphs(members: DataFrame) -> DataFrame:
    ship(members.sparkSession)
    return editions(members)[1].mapInPandas(_rows(_read_paragraphs, _PARAGRAPHS), _PARAGRAPHS)
