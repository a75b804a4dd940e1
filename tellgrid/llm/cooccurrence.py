"""Items that appear together, with large baskets cut into blocks.

A basket of up to ``chunk`` items gives its pairs in one row. A larger one is split by hash into blocks of about ``chunk``
items, and each pair of blocks becomes a row of its own that any task can take, so a basket with a third of all rows is
spread over the cluster and is never gathered. The pairs of both are counted together with map-side sums.

Two exact bounds keep pairs from being formed that cannot qualify (they lose no result): a pair with lift L needs
N >= L * records(a), since it is together in no more records than its commoner item has. Of such too common items there
are at most L times the mean basket size, so they may be broadcast.

Defined results
---------------
* null and empty items are skipped; an item counts once per basket; a basket without items is no basket;
* pairs are ordered by code point (a < b), so each comes out once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a block; a block pair gives at most about its square in pairs.
CHUNK = 64


def _pairs_within(items: str) -> Column:
    """array<struct<a,b>> of the ordered pairs of a sorted array."""
    return F.flatten(
        F.transform(
            items,
            lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b"))),
        )
    )


def _pairs_across(left: str, right: str) -> Column:
    return F.flatten(
        F.transform(left, lambda a: F.transform(right, lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))
    )


def basket_pairs(rows: DataFrame, basket: str, item: str, chunk: int = CHUNK) -> DataFrame:
    """a, b, once per basket that holds both; ``rows`` has distinct (basket, item) with neither null."""
    sizes = rows.groupBy(basket).agg(F.count(F.lit(1)).alias("_size"))
    large = sizes.filter(F.col("_size") > chunk).select(F.col(basket).alias("_b"), F.ceil(F.col("_size") / chunk).cast("int").alias("_k"))
    tagged = rows.join(large, rows[basket] == large["_b"], "left").select(basket, item, F.coalesce("_k", F.lit(1)).alias("_k"))
    small = tagged.filter("_k = 1").groupBy(basket).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    ordinary = small.filter(F.size("_items") > 1).select(F.explode(_pairs_within("_items")).alias("_p"))

    blocks = (
        tagged.filter("_k > 1")
        .withColumn("_c", F.pmod(F.xxhash64(item), F.col("_k")).cast("int"))
        .groupBy(basket, "_k", "_c")
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
    )
    # each block goes to every pair of blocks it is part of; a pair has at most two rows
    spread = blocks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    meet = spread.groupBy(basket, F.least("_c", "_o").alias("_lo"), F.greatest("_c", "_o").alias("_hi")).agg(
        F.max(F.when(F.col("_c") <= F.col("_o"), F.col("_items"))).alias("_left"),
        F.max(F.when(F.col("_c") >= F.col("_o"), F.col("_items"))).alias("_right"),
    )
    inside = meet.filter("_lo = _hi").select(F.explode(_pairs_within("_left")).alias("_p"))
    across = meet.filter("_lo < _hi and _left is not null and _right is not null").select(
        F.explode(_pairs_across("_left", "_right")).alias("_p")
    )
    return ordinary.unionByName(inside).unionByName(across).select("_p.a", "_p.b")


def associated_pairs(rows: DataFrame, basket: list[str], item: str, least_together: int, least_lift: int, chunk: int = CHUNK) -> DataFrame:
    """a, b, together, records_a, records_b, baskets, lift of the pairs that keep company.

    A pair qualifies with ``together >= least_together`` and ``together * baskets >= least_lift * records_a * records_b``.
    """
    spark = rows.sparkSession
    given = rows.filter(F.col(item).isNotNull() & (F.col(item) != ""))
    once = given.select(F.struct(*basket).alias("_basket"), F.col(item).alias("_item")).distinct()
    baskets = once.select("_basket").distinct().count()
    records = once.groupBy("_item").agg(F.count(F.lit(1)).alias("_n"))
    # fewer than least_lift times the mean basket size of items are so common
    common = F.broadcast(records.filter(F.col("_n") * least_lift > baskets).select(F.col("_item").alias("_x")))
    kept = once.join(common, once["_item"] == common["_x"], "left_anti")
    together = basket_pairs(kept, "_basket", "_item", chunk).groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))
    together = together.filter(F.col("together") >= least_together)
    of_a = records.select(F.col("_item").alias("a"), F.col("_n").alias("records_a"))
    of_b = records.select(F.col("_item").alias("b"), F.col("_n").alias("records_b"))
    scored = together.join(of_a, "a").join(of_b, "b").withColumn("baskets", F.lit(baskets).cast("bigint"))
    lift = F.col("together") * F.col("baskets") / (F.col("records_a") * F.col("records_b"))
    exact = F.col("together").cast("decimal(38,0)") * F.col("baskets") >= F.col("records_a").cast("decimal(38,0)") * F.col("records_b") * least_lift
    return scored.filter(exact).withColumn("lift", lift)


def adjacent_pairs(rows: DataFrame, first: str, second: str, count: str, least_together: int, least_lift: int) -> DataFrame:
    """The same for pairs that come already counted: a, b, together, of_a, of_b, total, lift.

    ``together`` sums both orders; ``of`` sums the counts of the rows with the item on either side; rows with a null item
    or count or two equal items are left out.
    """
    pairs = rows.filter(F.col(count).isNotNull() & (F.col(first) != F.col(second)))
    both = pairs.select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), F.col(count).alias("_c"))
    summed = both.groupBy("a", "b").agg(F.sum("_c").cast("bigint").alias("together"))
    of = summed.select(F.explode(F.array("a", "b")).alias("_item"), "together").groupBy("_item").agg(F.sum("together").alias("_of"))
    total = pairs.agg(F.sum(count)).first()[0] or 0
    scored = (
        summed.filter(F.col("together") >= least_together)
        .join(of.select(F.col("_item").alias("a"), F.col("_of").alias("of_a")), "a")
        .join(of.select(F.col("_item").alias("b"), F.col("_of").alias("of_b")), "b")
        .withColumn("total", F.lit(total).cast("bigint"))
    )
    exact = F.col("together").cast("decimal(38,0)") * F.col("total") >= F.col("of_a").cast("decimal(38,0)") * F.col("of_b") * least_lift
    return scored.filter(exact).withColumn("lift", F.col("together") * F.col("total") / (F.col("of_a") * F.col("of_b")))
