"""Problem 3: references of the corpus tables that lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellgrid.functions.refs import strict_word_ref
from tellgrid.operators.orphans import orphan_counts, orphan_references
from tellgrid.session import load


def _reference_sets(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, DataFrame, list[str]]]:
    """(table, references with k1, k2, loaded_at and key columns, targets with the same key columns, keys)."""
    compounds = load(spark, folder, "compounds").select(
        F.col("entry_id").alias("k1"), F.col("xcpd").alias("k2"), "loaded_at", F.col("eref").alias("key")
    )
    entries = load(spark, folder, "entries").filter("removed_at is null").select(F.col("id").alias("key"))
    texts = load(spark, folder, "text_locations")
    located = texts.select(F.col("project").alias("k1"), F.col("text_id").alias("k2"), "loaded_at", F.col("text_id").alias("key"))
    artifacts = load(spark, folder, "artifacts").filter("removed_at is null").select("p_id", "composite_id")
    catalogued = artifacts.select(F.explode(F.array("p_id", "composite_id")).alias("key")).filter("key is not null")
    ref = strict_word_ref(F.col("word_ref"))
    instances = load(spark, folder, "instances").filter("word_ref is not null").select(
        F.col("xis").alias("k1"),
        F.col("word_ref").alias("k2"),
        "loaded_at",
        # a reference that cannot be read gets a key that no text has
        F.coalesce(ref["project"], F.lit("")).alias("project"),
        F.coalesce(ref["text_id"], F.lit("")).alias("text_id"),
    )
    places = texts.filter("project <> '' and text_id <> ''").select("project", "text_id")
    return [
        ("compounds", compounds, entries, ["key"]),
        ("text_locations", located, catalogued, ["key"]),
        ("instances", instances, places, ["project", "text_id"]),
    ]


def orphans_found(spark: SparkSession, folder: str) -> DataFrame:
    """src, k1, k2 of every reference whose target does not exist; a repeated reference is one row."""
    found = None
    for src, refs, targets, keys in _reference_sets(spark, folder):
        part = orphan_references(refs, targets, keys).select(F.lit(src).alias("src"), "k1", "k2").distinct()
        found = part if found is None else found.unionByName(part)
    return found


def orphans_per_month(spark: SparkSession, folder: str) -> DataFrame:
    """src, month (yyyy-MM of loaded_at), refs, orphans; exact repeats of a row count once."""
    found = None
    for src, refs, targets, keys in _reference_sets(spark, folder):
        months = refs.distinct().withColumn("month", F.date_format("loaded_at", "yyyy-MM"))
        part = orphan_counts(months, targets, keys, "month").select(F.lit(src).alias("src"), "month", "refs", "orphans")
        found = part if found is None else found.unionByName(part)
    return found
