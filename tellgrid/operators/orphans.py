"""References to records that do not exist.

Skew-aware split. References are pre-aggregated per key, so however often a key is named it travels as one row per task. Keys
that are named by at least one in ``heavy_keys`` of all references (so there are at most so many) are checked by
broadcasting *them* to the target; all other keys are shuffled for the anti-join, one row each. The lost keys of both then
find their references: by broadcast if they are few (they are counted first), else the heavy ones by broadcast and the rest
by a shuffle that no hot key takes part in.

Defined results
---------------
* a null reference is no reference and never an orphan;
* a null target key matches nothing; repeated targets count once;
* an empty reference table gives no rows; an empty target table makes every reference an orphan;
* repeated references stay as often as they come in: callers decide what "one case" is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellgrid.session import cut, unused

#: A key is heavy if at least one in so many references names it; the bound of what is broadcast in rows.
HEAVY_KEYS = 1000
#: Lost keys up to which they are broadcast to the references, in rows.
FEW_KEYS = 100_000


def _match(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[a] == right[b] for a, b in pairs))


def lost_keys(counted: DataFrame, wanted: DataFrame, keys: list[str], number: str, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """Rows of ``counted`` (keys and how often each is named) whose keys are not in ``wanted``, with ``_heavy``: whether the key is.

    ``wanted`` has one column per key, in their order.
    """
    held = wanted.columns
    counted = counted.withColumn("_heavy", F.col(number) * heavy_keys >= counted.agg(F.coalesce(F.sum(number), F.lit(0))).scalar())
    heavy, light = counted.filter("_heavy"), counted.filter("not _heavy")
    sought = F.broadcast(heavy.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]))
    there = wanted.join(sought, _match(wanted, sought, [(h, f"_h{i}") for i, h in enumerate(held)]), "left_semi").distinct()
    heavy_lost = heavy.join(F.broadcast(there), _match(heavy, there, list(zip(keys, held))), "left_anti")
    return heavy_lost.unionByName(light.join(wanted, _match(light, wanted, list(zip(keys, held))), "left_anti"))


def orphan_references(
    refs: DataFrame, targets: DataFrame, keys: list[str], target_keys: list[str] | None = None, heavy_keys: int = HEAVY_KEYS, few_keys: int = FEW_KEYS
) -> DataFrame:
    """Rows of ``refs`` whose ``keys`` are all given and name no row of ``targets``.

    All columns of ``refs`` are kept, whatever their names.
    """
    target_keys = target_keys or keys
    own = [f"_k{i}" for i in range(len(keys))]
    refs = refs.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    wanted = targets.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(target_keys)]).dropna()
    counted = cut(refs.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)]).agg(F.count(F.lit(1)).alias("_n")))
    lost = cut(lost_keys(counted, wanted, own, "_n", heavy_keys))
    names = unused(refs, *own)
    lost = lost.select(*[F.col(o).alias(n) for o, n in zip(own, names)], "_heavy")

    def of(some: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        some = some.drop("_heavy")
        return rows.join(some, _match(rows, some, list(zip(keys, names))), how)

    if lost.limit(few_keys + 1).count() <= few_keys:
        return of(F.broadcast(lost), refs, "left_semi")
    heavy = F.broadcast(lost.filter("_heavy"))  # at most heavy_keys rows
    return of(heavy, refs, "left_semi").unionByName(of(lost.filter("not _heavy"), of(heavy, refs, "left_anti"), "left_semi"))


def orphan_counts(refs: DataFrame, targets: DataFrame, keys: list[str], period: str, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """Orphan and total references per period: ``period, refs, orphans``.

    References are summed per key and period before anything is shuffled for the anti-join, so a key with a third of all
    references travels as one row per period. References with a null period are counted under a null period.
    """
    given = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    summed = cut(refs.filter(given).groupBy(*keys, F.col(period).alias("_period")).agg(F.count(F.lit(1)).alias("_refs")))
    counted = summed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("_refs").alias("_n"))
    wanted = targets.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]).dropna()
    lost = lost_keys(counted, wanted, [f"_k{i}" for i in range(len(keys))], "_n", heavy_keys).withColumn("_lost", F.lit(True))
    # one row per key and period on one side, one per lost key on the other
    both = summed.join(lost, _match(summed, lost, [(k, f"_k{i}") for i, k in enumerate(keys)]), "left")
    orphans = F.coalesce(F.sum(F.when(F.col("_lost"), F.col("_refs"))), F.lit(0))
    return both.groupBy(F.col("_period").alias(period)).agg(F.sum("_refs").alias("refs"), orphans.alias("orphans"))
