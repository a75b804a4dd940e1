"""Frequency of every distinct value, term or n-gram by suffix-sorted counting.

Every position of a record's term sequence gives one suffix, cut to the longest n-gram wanted. Equal suffixes are summed
before anything moves. The sums are routed by their first term (a term that starts more than ``HEAVY`` different suffixes is
spread over as many partitions as its weight asks for), sorted in reverse lexicographic order within each partition, and
one pass with a stack no deeper than the longest n-gram adds up all prefixes: when the next suffix no longer shares a prefix
on the stack, that prefix is complete and comes out. What a spread term's partitions have in common is summed at the end.

Records are counted without keeping sets of them: a suffix carries the shortest length from which its prefixes are seen
for the first time in their record ("fresh"), so a prefix adds one record exactly where it first occurs.

Defined results
---------------
* null and empty terms are skipped, and do not break a sequence; a record with no term counts as no record;
* weights must not be null (a null weight counts as 0); an empty table gives no rows;
* counts are bigint; terms compare by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Different suffixes of one first term that a partition holds; the terms that have more are at most one in so many suffixes.
HEAVY = 500_000

_OUT = "gram array<string>, occurrences bigint, records bigint"


def suffixes_of_arrays(df: DataFrame, terms: str, longest: int) -> DataFrame:
    """suffix, fresh, weight of every position of the arrays in ``terms``, each array a record; nothing is shuffled."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            suffixes, fresh = [], []
            for sequence in batch["terms"]:
                own, seen = [t for t in sequence if t], set()
                for at in range(len(own)):
                    suffix = tuple(own[at : at + longest])
                    # prefixes of a prefix that was seen were seen too
                    new = next((n for n in range(1, len(suffix) + 1) if suffix[:n] not in seen), len(suffix) + 1)
                    seen.update(suffix[:n] for n in range(new, len(suffix) + 1))
                    suffixes.append(list(suffix))
                    fresh.append(new)
            if suffixes:
                yield pd.DataFrame({"suffix": suffixes, "fresh": fresh, "weight": 1})

    return df.filter(F.col(terms).isNotNull()).select(F.col(terms).alias("terms")).mapInPandas(cut_up, "suffix array<string>, fresh int, weight bigint")


def suffixes_of_rows(df: DataFrame, record: list[str], term: str, position: str | None = None, longest: int = 1) -> DataFrame:
    """suffix, fresh, weight for a table with one term per row.

    With ``longest`` 1 no record is ever gathered: equal (record, term) rows are summed, and the sum is one fresh suffix.
    Longer runs need the order within a record, which a window sorts (it spills, but one record is one task).
    """
    rows = df.filter(F.col(term).isNotNull() & (F.col(term) != ""))
    if longest == 1:
        summed = rows.groupBy(*record, term).agg(F.count(F.lit(1)).alias("weight"))
        return summed.select(F.array(F.col(term)).alias("suffix"), F.lit(1).alias("fresh"), "weight")
    by = Window.partitionBy(*record).orderBy(position)
    ahead = [F.col(term), *[F.lead(term, k).over(by) for k in range(1, longest)]]
    rows = rows.select(*record, F.col(position).alias("_at"), F.array_compact(F.array(*ahead)).alias("suffix"))
    seen = F.lit(0)
    for length in range(1, longest + 1):
        prefix = F.slice("suffix", 1, length)
        place = F.row_number().over(Window.partitionBy(*record, prefix).orderBy("_at"))
        seen = F.when((F.size("suffix") >= length) & (place > 1), F.lit(length)).otherwise(seen)
    return rows.select("suffix", (seen + 1).alias("fresh"), F.lit(1).cast("bigint").alias("weight"))


def _stack(longest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: list[str] = []  # the prefix on the stack
        occurrences: list[int] = []
        records: list[int] = []
        out: tuple[list, list, list] = ([], [], [])

        def pop(to: int) -> None:
            while len(grams) > to:
                out[0].append(list(grams))
                out[1].append(occurrences[-1])
                out[2].append(records[-1])
                carried = occurrences.pop()
                records.pop()
                grams.pop()
                if occurrences:
                    occurrences[-1] += carried

        for batch in batches:
            for suffix, fresh, weight, rows in zip(batch["suffix"], batch["fresh"], batch["weight"], batch["n"]):
                common, top = 0, min(len(suffix), len(grams))
                while common < top and suffix[common] == grams[common]:
                    common += 1
                pop(common)
                for term in suffix[common:]:
                    grams.append(term)
                    occurrences.append(0)
                    records.append(0)
                occurrences[-1] += weight
                for depth in range(fresh - 1, len(suffix)):
                    records[depth] += rows
            if len(out[0]) >= 10_000:
                yield pd.DataFrame({"gram": out[0], "occurrences": out[1], "records": out[2]})
                out = ([], [], [])
        pop(0)
        if out[0]:
            yield pd.DataFrame({"gram": out[0], "occurrences": out[1], "records": out[2]})

    return run


def count_prefixes(suffixes: DataFrame, longest: int) -> DataFrame:
    """gram, occurrences, records for every n-gram of 1 to ``longest`` terms, from ``suffix, fresh, weight`` rows."""
    summed = suffixes.groupBy("suffix", "fresh").agg(
        F.sum(F.coalesce("weight", F.lit(0))).cast("bigint").alias("weight"), F.count(F.lit(1)).alias("n")
    )
    first = summed.withColumn("_first", F.get("suffix", F.lit(0)))
    if longest > 1:
        heavy = first.groupBy("_first").agg(F.count(F.lit(1)).alias("_all")).filter(F.col("_all") > HEAVY)
        # at most one row in HEAVY suffixes, so it may be broadcast
        heavy = heavy.select(F.col("_first").alias("_heavy"), F.ceil(2 * F.col("_all") / HEAVY).alias("_parts"))
        first = first.join(F.broadcast(heavy), F.col("_first") == F.col("_heavy"), "left")
        first = first.withColumn("_spread", F.pmod(F.xxhash64("suffix"), F.coalesce("_parts", F.lit(1).cast("bigint")))).drop("_heavy", "_parts")
    by = ["_first"] if longest == 1 else ["_first", "_spread"]
    routed = first.repartition(*by).sortWithinPartitions(F.col("suffix").desc()).select("suffix", "fresh", "weight", "n")
    counted = routed.mapInPandas(_stack(longest), _OUT)
    if longest == 1:
        return counted
    # the prefixes of a spread first term come out once per partition
    return counted.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
