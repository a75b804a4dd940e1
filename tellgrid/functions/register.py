"""Functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tellgrid.functions import stem, text
from tellgrid.functions.render import render
from tellgrid.session import ship


#: Functions that SQL itself expresses: parameter and body; they are inlined into the plan and stay in the JVM.
BODIES = {
    "strip_subscripts": f"regexp_replace(t, '[{text.SUBSCRIPTS}]', '')",
    "digits_to_subscripts": f"translate(t, '0123456789', '{text.SUBSCRIPTS}')",
    "ascii_lower": "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    "blank_to_null": r"nullif(regexp_replace(t, '(?U)^\\s+|\\s+$', ''), '')",
    "format_p_id": r"case when regexp_replace(t, '(?U)^\\s+|\\s+$', '') rlike '^[0-9]+$' then format_string('P%06d', try_cast(regexp_replace(t, '(?U)^\\s+|\\s+$', '') as bigint)) end",
    "leading_number": "try_cast(regexp_extract(t, '^([0-9]+)', 1) as bigint)",
}


def register(spark: SparkSession, glyphs: dict[str, str] | None = None) -> list[str]:
    """The functions of ``BODIES``, and casefold, expand_entities, html_unescape, fts_words, fts_stems, porter, and cuneify if a sign dictionary is given."""
    ship(spark)
    for name, body in BODIES.items():
        kind = "bigint" if name == "leading_number" else "string"
        spark.sql(f"create or replace temporary function {name}(t string) returns {kind} return {body}")
    named = {"casefold": text.casefold, "expand_entities": text.expand_entities, "html_unescape": text.html_unescape, "fts_words": stem.fts_words, "fts_stems": stem.fts_stems}
    named["porter"] = pandas_udf(lambda words: words.map(lambda w: None if w is None else stem.porter(w)), T.StringType())
    if glyphs is not None:
        named["cuneify"] = pandas_udf(lambda spellings: spellings.map(lambda s: render(s, glyphs)), T.StringType())
    for name, function in named.items():
        spark.udf.register(name, function)
    return sorted([*named, *BODIES])
