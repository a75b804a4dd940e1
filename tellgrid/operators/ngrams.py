"""Sequences of a document and their n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines_of(nodes: DataFrame, document: list[str], position: str, is_start: str) -> DataFrame:
    """``nodes`` with ``line_no``: a start node begins a new line; nodes before the first start are line 0."""
    by = Window.partitionBy(*document).orderBy(position)
    return nodes.withColumn("line_no", F.sum(F.col(is_start).cast("int")).over(by).cast("bigint"))


def sequences(df: DataFrame, line: list[str], position: str, item: str, least: int = 2) -> DataFrame:
    """One row per line with ``items`` in order; skipped items (null or empty) do not break the sequence."""
    kept = df.filter(F.col(item).isNotNull() & (F.col(item) != ""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(position, item))), lambda s: s[item])
    return kept.groupBy(*line).agg(ordered.alias("items")).filter(F.size("items") >= least)


def ngram_counts(df: DataFrame, line: list[str], position: str, item: str, n: int, least_count: int = 1, separator: str = " ") -> DataFrame:
    """ngram (items joined by ``separator``), n, count of all runs of ``n`` items; window form, so no line is gathered."""
    kept = df.filter(F.col(item).isNotNull() & (F.col(item) != ""))
    by = Window.partitionBy(*line).orderBy(position)
    columns = [F.col(item), *[F.lead(item, k).over(by) for k in range(1, n)]]
    grams = kept.select(*[c.alias(f"w{i}") for i, c in enumerate(columns)]).filter(F.col(f"w{n - 1}").isNotNull())
    joined = F.concat_ws(separator, *[f"w{i}" for i in range(n)])
    counted = grams.groupBy(joined.alias("ngram")).agg(F.count(F.lit(1)).alias("count"))
    return counted.filter(F.col("count") >= least_count).select(F.lit(n).cast("bigint").alias("n"), "ngram", "count")


def array_ngrams(items: str, n: int):
    """array<array> of the runs of ``n`` items of an array column; empty if it is shorter."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, n))


def encode_slots(slots):
    """Key of a feature-annotated n-gram: fields joined by '|', slots by a tab, null as ''."""
    blank = F.lit("")
    each = F.transform(slots, lambda s: F.concat_ws("|", *[F.coalesce(s[f], blank) for f in ("cf", "gw", "pos", "case")]))
    return F.array_join(each, "\t")
