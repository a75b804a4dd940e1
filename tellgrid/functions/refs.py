"""Composite references of the form project:text.line[.word]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_word_ref(ref: Column) -> Column:
    """struct<project, text_id, line, word>; null if there is no ':', no line, or an empty part before it.

    The text splits on its first ':' and then on dots; word is null for a reference to a whole line.
    """
    project = F.regexp_extract(ref, r"^([^:]*):", 1)
    parts = F.split(F.regexp_replace(ref, r"^[^:]*:", ""), r"\.")
    reads = ref.contains(":") & (F.size(parts) >= 2) & (parts.getItem(0) != "")
    word = F.when(F.size(parts) >= 3, F.get(parts, F.lit(2)))
    return F.when(
        reads,
        F.struct(project.alias("project"), parts.getItem(0).alias("text_id"), F.get(parts, F.lit(1)).alias("line"), word.alias("word")),
    )


def strict_word_ref(ref: Column) -> Column:
    """As parse_word_ref, but only for references that read project:text.line or project:text.line.word exactly."""
    return F.when(ref.rlike(r"^[^:]+:[^:.]+\.[^:.]+(\.[^:.]+)?$"), parse_word_ref(ref))
