"""Filling containers of fixed capacity with items of varying length: best-two-fit over the distribution of sizes.

Items of one size are interchangeable, so the packing is planned on the counts per size (at most ``capacity`` numbers,
whatever the number of items): a bin is opened with the largest size left and filled greedily with the largest that still
fits; then its smallest item is given back as long as two unpacked items fit the gap it leaves more tightly. The bin found
is repeated as often as the counts allow, which uses up at least one size. Items then find their place by their rank
within their size, which is taken in hash buckets, as many as the number of items of the size asks for, so that one size
may hold any share of all items.

Defined results
---------------
* an item of size 0 or null takes no room: its container is null;
* an item larger than the capacity is split into full containers of its own and a remainder that is packed like an item;
* keys should be unique (repeated keys are items of their own, in an order that is not fixed); an empty table gives no rows;
* the result is the same for the same items, however they are partitioned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellgrid.session import cut

#: Items of one size that are ranked in one bucket, on average.
BUCKET = 100_000


def _best_pair(counts: np.ndarray, used: dict[int, int], most: int) -> tuple[int, int] | None:
    """The two unpacked sizes with the largest sum up to ``most``."""
    left = counts[: most + 1].copy()
    for size, times in used.items():
        if size <= most:
            left[size] -= times
    sizes = np.flatnonzero(left > 0)
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return None
    # for each size the largest partner that still fits (itself only if there are two of it)
    at = np.searchsorted(sizes, most - sizes, side="right") - 1
    same = (at >= 0) & (sizes[np.maximum(at, 0)] == sizes) & (left[sizes] < 2)
    at = at - same
    good = at >= 0
    if not good.any():
        return None
    sums = np.where(good, sizes + sizes[np.maximum(at, 0)], -1)
    best = int(sums.argmax())
    return int(sizes[best]), int(sizes[at[best]])


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(sizes with their number in the bin, how many such bins), in the order they are filled."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, number in histogram.items():
        counts[size] += number
    bins: list[tuple[dict[int, int], int]] = []
    while True:
        there = np.flatnonzero(counts)
        if not len(there):
            return bins
        used: dict[int, int] = {}
        gap = capacity
        while gap:
            fits = there[there <= gap][::-1]
            size = next((int(s) for s in fits if counts[s] > used.get(int(s), 0)), 0)
            if not size:
                break
            used[size] = used.get(size, 0) + 1
            gap -= size
        while gap and sum(used.values()) > 1:
            smallest = min(used)
            pair = _best_pair(counts, used, gap + smallest)
            if pair is None or sum(pair) <= smallest:
                break
            used[smallest] -= 1
            if not used[smallest]:
                del used[smallest]
            for size in pair:
                used[size] = used.get(size, 0) + 1
            gap += smallest - sum(pair)
        times = int(min(counts[size] // number for size, number in used.items()))
        for size, number in used.items():
            counts[size] -= number * times
        bins.append((used, times))


def pack(items: DataFrame, key: str, size: str, capacity: int, bucket: int = BUCKET) -> DataFrame:
    """key, piece, size, container: no container holds more than ``capacity``."""
    kind = items.schema[key].dataType
    sized = cut(items.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("_size")))
    full = F.floor(F.col("_size") / capacity).cast("int")
    whole = F.when(F.col("_size") > capacity, full).otherwise(0)
    pieces = sized.withColumn("_whole", whole).withColumn("_rest", F.col("_size") - F.col("_whole") * capacity)

    # at most ``capacity`` + 1 rows come to the driver
    counted = pieces.groupBy("_rest").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_whole") > 0).cast("bigint")).alias("over")).collect()
    histogram = {int(r["_rest"]): int(r["n"]) for r in counted if r["_rest"] > 0}
    bins = plan(histogram, capacity)
    spread = {size: -(-n // bucket) for size, n in histogram.items() if n > bucket}

    def by_hash(buckets: Column) -> Column:
        return F.pmod(F.xxhash64("_key"), buckets.cast("bigint")).cast("int")

    buckets = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in spread.items() for x in pair]), F.col("_rest")), F.lit(1)) if spread else F.lit(1)
    placed = pieces.filter("_rest > 0").withColumn("_b", by_hash(buckets))
    per_bucket = placed.groupBy("_rest", "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("_rest").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_bucket.select(F.col("_rest").alias("_r"), F.col("_b").alias("_bb"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for used, times in bins:
        for s, number in used.items():
            slots.setdefault(s, []).append((taken.get(s, 0), number, base))
            taken[s] = taken.get(s, 0) + number * times
        base += times
    tables = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in slots.items()}

    @F.pandas_udf("bigint")
    def container(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.empty(len(sizes), dtype=np.int64)
        values, ordinal = sizes.to_numpy(), ranks.to_numpy()
        for s in np.unique(values):
            here = values == s
            starts, numbers, bases = tables[int(s)]
            at = np.searchsorted(starts, ordinal[here], side="right") - 1
            out[here] = bases[at] + (ordinal[here] - starts[at]) // numbers[at]
        return pd.Series(out)

    within = F.row_number().over(Window.partitionBy("_rest", "_b").orderBy("_key")) - 1
    ranked = placed.withColumn("_w", within).join(offsets, (F.col("_rest") == F.col("_r")) & (F.col("_b") == F.col("_bb")))
    packed = ranked.select(
        "_key", F.col("_whole").alias("piece"), F.col("_rest").alias("size"), container("_rest", (F.col("_w") + F.col("_ahead")).cast("bigint")).alias("container")
    )

    # full containers of over-long items come after the packed ones, numbered by bucket like the ranks above
    over = pieces.filter("_whole > 0").withColumn("_b", by_hash(F.lit(max(1, -(-sum(int(r["over"]) for r in counted) // bucket)))))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # a row per bucket
    starts = over.groupBy("_b").agg(F.sum("_whole").alias("_n")).select(F.col("_b").alias("_bb"), F.coalesce(before, F.lit(0)).alias("_ahead"))
    own = F.coalesce(F.sum("_whole").over(Window.partitionBy("_b").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = over.withColumn("_own", own).join(F.broadcast(starts), F.col("_b") == F.col("_bb"))
    split = split.select("_key", "_ahead", "_own", F.explode(F.sequence(F.lit(0), F.col("_whole") - 1)).alias("piece"))
    alone = split.select("_key", "piece", F.lit(capacity).alias("size"), (F.lit(base) + F.col("_ahead") + F.col("_own") + F.col("piece")).cast("bigint").alias("container"))
    nothing = pieces.filter("_size = 0").select("_key", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("bigint").alias("container"))
    return packed.unionByName(alone).unionByName(nothing).withColumn("_key", F.col("_key").cast(kind)).withColumnRenamed("_key", key)
