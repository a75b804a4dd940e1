"""Windows over groups: capped lists, islands of equal neighbours, shares, first-of-group maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellgrid.session import unused


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group with ``rank`` and the group's ``total``; 0 keeps all. Truncated where total > cap."""
    by = Window.partitionBy(*groups)
    ranked = df.withColumn("rank", F.row_number().over(by.orderBy(*order)))
    if not cap:
        return ranked.withColumn("total", F.count(F.lit(1)).over(by))
    totals = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"))
    kept = ranked.filter(F.col("rank") <= cap)  # Catalyst turns this into a group limit before the shuffle
    match = [kept[g].eqNullSafe(totals[g]) for g in groups]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return kept.join(totals, condition).select(*[kept[c] for c in kept.columns], "total")


def islands(df: DataFrame, groups: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``island``: 1, 2, ... for runs of neighbouring rows of equal ``value`` (nulls equal each other)."""
    by = Window.partitionBy(*groups).orderBy(*order)
    before = F.lag(value).over(by)
    place = F.row_number().over(by)
    changed = F.when((place == 1) | ~F.col(value).eqNullSafe(before), 1).otherwise(0)
    (change,) = unused(df, "_change")
    return df.withColumn(change, changed).withColumn("island", F.sum(change).over(by).cast("bigint")).drop(change)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, 0 where the whole is 0 or null."""
    return F.when(F.coalesce(whole, F.lit(0)) != 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def first_of(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """key, value: the value at the least position of each key (a partial aggregate, no window)."""
    return df.groupBy(key).agg(F.min(F.struct(position, value))[value].alias(value))
