"""One row per key by source order: the first loaded wins, or the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellgrid.session import unused


def _pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    (rank,) = unused(df, "_rank")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) == 1).drop(rank)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that comes first by ``order`` (nulls first); later ones are ignored. Null keys are a key of their own."""
    return _pick(df, keys, [F.col(c).asc_nulls_first() for c in order])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that comes last by ``order`` (nulls first); it replaces earlier ones."""
    return _pick(df, keys, [F.col(c).desc_nulls_last() for c in order])
