"""The artifact catalogue in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellgrid.functions.text import blank_to_null, format_p_id, has_scan
from tellgrid.operators.dedup import last_wins

#: Columns that are read, and those stored under another name (fixed values).
COLUMNS = (
    "composite_id designation primary_publication publication_history citation period period_remarks accounting_period dates_referenced "
    "provenience provenience_remarks findspot_remarks findspot_square excavation_no collection museum_no accession_no genre subgenre "
    "language material object_type height width thickness condition_description object_remarks"
).split()
RENAMED = {"collection": "museum_collection"}
CONSUMED = ("id_text", "photo_up", "lineart_up")


class HeaderError(ValueError):
    """The file lacks an expected column."""


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per artifact; rows without a number are skipped, and of rows with the same number the last one wins."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False, inferSchema=False)
    if missing := [c for c in (*CONSUMED, *COLUMNS) if c not in raw.columns]:
        raise HeaderError(f"the catalogue lacks the columns {missing}")
    # the position in the file decides which of two rows is the later one
    rows = raw.select(*CONSUMED, *COLUMNS, F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    shown = rows.select(
        format_p_id(F.col("id_text")).alias("p_id"), F.trim("id_text").try_cast("bigint").alias("cdli_id"), has_scan(F.col("photo_up")).alias("has_photo"),
        has_scan(F.col("lineart_up")).alias("has_lineart"), *[blank_to_null(F.col(c)).alias(RENAMED.get(c, c)) for c in COLUMNS], "_file", "_at",
    )
    return last_wins(shown.filter("p_id is not null"), ["p_id"], ["_file", "_at"]).drop("_file", "_at")


def read_signs(spark: SparkSession, path: str) -> DataFrame:
    """sign_name, utf8, uname, hex, values, position of a sign list (a JSON map under "signs"), in file order."""
    items = spark.read.format("json_items").option("path", path).option("field", "signs").option("kind", "pairs").load()
    parsed = F.from_json("value", "utf8 string, uname string, hex string, `values` array<string>")
    return items.select(F.col("key").alias("sign_name"), parsed.alias("s"), "position").select("sign_name", "s.utf8", "s.uname", "s.hex", "s.values", "position")
