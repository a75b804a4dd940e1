"""Optional filters: conjunctions of what was asked, period names, gap buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellgrid.functions.text import contains_ascii_ci


def all_of(df: DataFrame, asked: dict[str, str | None]) -> DataFrame:
    """Rows in which every asked column holds the asked substring (ASCII case ignored); null or blank asks nothing."""
    for column, needle in asked.items():
        if needle is not None and needle.strip():
            df = df.filter(contains_ascii_ci(F.col(column), needle.strip()))
    return df


def period_names(df: DataFrame, period: str, needle: str) -> DataFrame:
    """The distinct period names that hold the needle, case folded: a small dimension to semi-join with."""
    names = df.filter(F.col(period).isNotNull()).select(F.col(period).alias("_name")).distinct()
    return names.filter(F.contains(F.lower("_name"), F.lit(needle.casefold().strip())))


def gap_bucket(local: Column, indexed: Column, alternative: Column) -> Column:
    """have, missing_indexed, missing_alt_only or missing_unreachable."""
    return (
        F.when(local, "have").when(indexed, "missing_indexed").when(alternative, "missing_alt_only").otherwise("missing_unreachable")
    )
