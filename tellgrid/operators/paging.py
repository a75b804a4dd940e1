"""Pages with exact totals: offset pages, keyset pages, numbered pages."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellgrid.session import unused


@dataclass(frozen=True)
class PageInfo:
    total: int
    offset: int
    next_offset: int | None


def clamp(limit: object, cap: int, least: int = 1) -> int:
    return max(least, min(cap, int(limit)))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, cap: int = 50) -> tuple[DataFrame, PageInfo]:
    """The rows of a page and {total, offset, next_offset}; ``order`` must be total. Spark fuses sort, offset and limit."""
    limit, offset = clamp(limit, cap), max(0, int(offset))
    total = df.count()
    after = offset + limit
    return df.orderBy(*order).offset(offset).limit(limit), PageInfo(total, offset, after if after < total else None)


def paged(df: DataFrame, order: list[Column], limit: int, offset: int = 0, cap: int = 50) -> DataFrame:
    """The rows of a page with ``total`` and ``next_offset`` (null at the end) as columns; nothing runs while this is planned."""
    limit, offset = clamp(limit, cap), max(0, int(offset))
    total, following = unused(df, "total", "next_offset")
    rows = df.orderBy(*order).offset(offset).limit(limit).withColumn(total, df.agg(F.count(F.lit(1))).scalar())
    after = F.lit(offset + limit).cast("bigint")
    return rows.withColumn(following, F.when(after < F.col(total), after))


def keyset_page(df: DataFrame, key: str, start: object, limit: int, cap: int = 200) -> tuple[DataFrame, object | None]:
    """Rows with ``key`` >= start, and where the next page starts (None at the end)."""
    limit = clamp(limit, cap)
    rows = df.filter(F.col(key) >= start).orderBy(key).limit(limit + 1)
    bounds = rows.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last")).first()
    return rows.limit(limit), bounds["last"] if bounds["n"] > limit else None


def numbered_page(df: DataFrame, order: list[Column], number: int, per_page: int = 25) -> tuple[DataFrame, int, int]:
    """Rows, number and count of pages; a number out of range becomes the nearest page."""
    pages = max(1, math.ceil(df.count() / per_page))
    number = min(max(1, int(number)), pages)
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page), number, pages
