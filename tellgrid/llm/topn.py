"""Top N items within every group, by partition lower bounds.

Each partition's local N-th best item of a group bounds the group from below: whatever ranks behind it has at least N
better items already in that partition. The best of these bounds is joined to every group, rows behind it are filtered
out, and only the survivors (at most N per group and partition) are shuffled to be ranked. A group of millions of rows
thus never meets in one task.

Defined results
---------------
* the order is total: score descending, then the tie columns ascending, so equal scores always give the same N;
* a null score or a null group is no item; repeated rows are one item each (deduplicate first if they should not be);
* a group with fewer than N items keeps all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tellgrid.session import ship, unused


def _local_bounds(df: DataFrame, group: str, score: str, ties: list[str], n: int) -> DataFrame:
    """group, score and ties of the N-th best row of every group in every partition that has N rows of it."""
    order = [False, *[True] * len(ties)]
    columns = [group, score, *ties]
    schema = T.StructType([df.schema[c] for c in columns])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, waiting_rows = None, [], 0

        def top(frames: list[pd.DataFrame]) -> pd.DataFrame:
            both = pd.concat(frames, ignore_index=True).sort_values([score, *ties], ascending=order, kind="stable")
            return both[both.groupby(group, sort=False).cumcount() < n]

        for batch in batches:
            waiting.append(batch)
            waiting_rows += len(batch)
            # merging whenever as many rows wait as are held keeps the work linear
            if held is None or waiting_rows >= len(held):
                held, waiting, waiting_rows = top([*waiting] if held is None else [held, *waiting]), [], 0
        if waiting:
            held = top([held, *waiting])
        if held is not None:
            last = held[held.groupby(group, sort=False).cumcount() == n - 1]
            yield pd.DataFrame({c: last[c].to_numpy() for c in columns})

    return df.select(*columns).mapInPandas(best, schema)


def top_n_per_group(df: DataFrame, group: str, score: str, ties: list[str], n: int, rank: str = "_rank") -> DataFrame:
    """The first ``n`` rows of every ``group`` by ``score`` descending, then ``ties`` ascending, with their ``rank``.

    ``score`` must be numeric; ``ties`` should make the order total.
    """
    ship(df.sparkSession)
    items = df.filter(F.col(group).isNotNull() & F.col(score).isNotNull())
    own, bound = unused(items, "_group", "_bound")
    # ascending in this struct is the wanted order; the bound of a group is the least of its local N-th rows
    key = F.struct((-F.col(score)).alias("s"), *[F.col(t) for t in ties])
    bounds = _local_bounds(items, group, score, ties, n).groupBy(F.col(group).alias(own)).agg(F.min(key).alias(bound))
    within = items.join(bounds, items[group] == bounds[own], "left").filter(F.col(bound).isNull() | (key <= F.col(bound)))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), *[F.col(t).asc() for t in ties]))
    return within.drop(own, bound).withColumn(rank, place).filter(F.col(rank) <= n)


def latest_valid(df: DataFrame, keys: list[str], at: str, prefer: list[str]) -> DataFrame:
    """One row per ``keys``: the one with the latest ``at`` (nulls first loaded); ties by ``prefer`` descending, nulls last."""
    order = [F.col(at).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in prefer]]
    (place,) = unused(df, "_place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) == 1).drop(place)
