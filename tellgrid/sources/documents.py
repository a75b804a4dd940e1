"""Documents of the corpus: recursive trees of chunks, lines and words, flattened in reading order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellgrid.session import ship

_NODES = (
    "project string, text_id string, position bigint, node string, type string, ref string, label string, number string, frag string, "
    "lang string, cf string, gw string, pos string, readable boolean"
)
_COLUMNS = [c.split()[0] for c in _NODES.split(", ")]


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def walk(tree: object) -> Iterator[dict]:
    """Nodes of a tree in preorder, without recursion, so that depth is not bounded."""
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            yield node
            children = node.get("cdl")
            if isinstance(children, list):
                waiting.extend(reversed(children))


def flatten(documents: DataFrame) -> DataFrame:
    """One row per node of ``project, text_id, content``; a document that cannot be read gives one row with readable false."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for project, text_id, content in zip(batch["project"], batch["text_id"], batch["content"]):
                try:
                    tree = json.loads(bytes(content).decode("utf-8"))
                except (ValueError, TypeError):
                    rows.append((project, text_id, 0, *[None] * 10, False))
                    continue
                for position, node in enumerate(walk(tree)):
                    f = node.get("f") if isinstance(node.get("f"), dict) else {}
                    own = [_text(node.get(k)) for k in ("node", "type", "ref", "label", "n", "frag")]
                    rows.append((project, text_id, position, *own, *[_text(f.get(k)) for k in ("lang", "cf", "gw", "pos")], True))
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS, dtype=object)

    return documents.select("project", "text_id", "content").mapInPandas(run, _NODES)


def located(members: DataFrame) -> DataFrame:
    """project, text_id, zip_path, member_path, content of the members that are documents of the corpus."""
    pattern = r"^(.+)/corpusjson/([PQ]\d+)\.json$"
    project, text_id = (F.regexp_extract("member", pattern, i) for i in (1, 2))
    rows = members.select(project.alias("project"), text_id.alias("text_id"), F.col("archive").alias("zip_path"), F.col("member").alias("member_path"), "position", "content")
    return rows.filter("text_id <> ''")


def catalogue_entries(members: DataFrame) -> DataFrame:
    """project, text_id, zip_path, position, period, designation from the catalogues among the members; what cannot be read gives nothing."""
    project = F.regexp_extract("member", r"^(.+)/catalogue\.json$", 1)
    parsed = F.from_json(F.col("content").cast("string"), "members map<string,string>")
    rows = members.select(project.alias("project"), F.col("archive").alias("zip_path"), "position", parsed["members"].alias("m")).filter("project <> '' and m is not null")
    each = rows.select("project", "zip_path", "position", F.explode("m").alias("text_id", "meta")).withColumn("meta", F.from_json("meta", "period string, designation string"))
    return each.filter("meta is not null").select("project", "text_id", "zip_path", "position", "meta.period", "meta.designation")
