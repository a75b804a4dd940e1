"""Co-occurrence, term counting and top-N against brute force, with nulls, ties, repeats, hot keys and clashing columns."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tellgrid.llm import cooccurrence, suffix_counts, topn


def baskets(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for b in range(n):
        size = 60 if b == 0 else rng.randint(0, 6)  # one basket is far larger than a block
        items = [rng.choice(["a", "b", "c"]) if rng.random() < 0.3 else f"i{rng.randint(0, 40)}" for _ in range(size)]
        rows += [(None if b == 1 else f"b{b}", i, "x") for i in items + [None, ""]]
    return rows + rows[:50]


@pytest.mark.parametrize("chunk", [4, 64])
def test_basket_pairs(spark, chunk):
    rows = baskets(1)
    want = Counter()
    by = defaultdict(set)
    for b, i, _ in rows:
        if i:
            by[b].add(i)
    for items in by.values():
        want.update(combinations(sorted(items), 2))
    # extra columns with names the operator uses itself
    df = spark.createDataFrame(rows, "basket string, item string, _k string").withColumn("a", F.lit(1)).withColumn("_size", F.lit(2))
    once = df.filter("item <> ''").select(F.struct("basket").alias("_basket"), F.col("item").alias("_item")).distinct()
    got = {(r.a, r.b): r["count"] for r in cooccurrence.basket_pairs(once, "_basket", "_item", chunk).groupBy("a", "b").count().collect()}
    assert got == dict(want)
    found = cooccurrence.associated_pairs(df, ["basket"], "item", 2, 2, chunk)
    n, of = len(by), Counter(i for items in by.values() for i in items)
    assert {(r.a, r.b, r.together) for r in found.collect()} == {(a, b, c) for (a, b), c in want.items() if c >= 2 and c * n >= 2 * of[a] * of[b]}


def test_no_baskets(spark):
    empty = spark.createDataFrame([], "basket string, item string")
    assert cooccurrence.associated_pairs(empty, ["basket"], "item", 1, 1).count() == 0
    assert cooccurrence.adjacent_pairs(spark.createDataFrame([], "x string, y string, n long"), "x", "y", "n", 1, 1).count() == 0


def test_adjacent_pairs(spark):
    rows = [("a", "b", 10), ("b", "a", 15), ("a", "c", None), ("c", "d", 3), ("a", "a", 99), (None, "a", 50), ("e", "f", 30), ("x", "y", 900)]
    df = spark.createDataFrame(rows, "x string, y string, n long")
    got = {(r.a, r.b): (r.together, r.of_a, r.of_b, r.total) for r in cooccurrence.adjacent_pairs(df, "x", "y", "n", 20, 4).collect()}
    assert got == {("a", "b"): (25, 25, 25, 958), ("e", "f"): (30, 30, 30, 958)}


def brute_grams(records, longest):
    occurrences, where = Counter(), defaultdict(set)
    for key, seq in records.items():
        seq = [t for t in seq if t]
        for i in range(len(seq)):
            for n in range(1, longest + 1):
                if i + n <= len(seq):
                    occurrences[tuple(seq[i : i + n])] += 1
                    where[tuple(seq[i : i + n])].add(key)
    return {g: (c, len(where[g])) for g, c in occurrences.items()}


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_suffix_counts(spark, longest):
    rng = random.Random(3)
    # "h" starts a third of everything
    records = {(f"r{i}", None if i % 7 == 0 else i): [rng.choice(["h", "h", "a", "b", "c", None, ""]) for _ in range(rng.randint(0, 12))] for i in range(150)}
    rows = [(a, b, at, t) for (a, b), seq in records.items() for at, t in enumerate(seq)]
    df = spark.createDataFrame(rows, "r string, k int, at int, term string").withColumn("weight", F.lit(5)).withColumn("fresh", F.lit("x"))
    suffixes = suffix_counts.suffixes_of_rows(df, ["r", "k"], "term", "at", longest)
    got = {tuple(x.gram): (x.occurrences, x.records) for x in suffix_counts.count_prefixes(suffixes, longest).collect()}
    assert got == brute_grams(records, longest)


def test_suffix_counts_of_arrays(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["b", None, "a"]), (3, []), (4, None)], "id int, t array<string>")
    got = {tuple(x.gram): (x.occurrences, x.records) for x in suffix_counts.count_prefixes(suffix_counts.suffixes_of_arrays(df, "t", 2), 2).collect()}
    assert got == brute_grams({1: ["a", "b", "a", "b"], 2: ["b", "a"]}, 2)
    assert suffix_counts.count_prefixes(suffix_counts.suffixes_of_arrays(df.limit(0), "t", 2), 2).count() == 0


def test_a_first_term_of_any_weight(spark, monkeypatch):
    """However many suffixes a first term starts, and over however many partitions they are spread, the counts are the same."""
    rng = random.Random(9)
    records = {i: ["h" if rng.random() < 0.6 else rng.choice("abcd") for _ in range(rng.randint(0, 9))] for i in range(200)}
    df = spark.createDataFrame([(i, t) for i, t in records.items()], "id int, t array<string>")
    for heavy in (1, 7, 10_000):
        monkeypatch.setattr(suffix_counts, "HEAVY", heavy)
        got = {tuple(x.gram): (x.occurrences, x.records) for x in suffix_counts.count_prefixes(suffix_counts.suffixes_of_arrays(df, "t", 4), 4).collect()}
        assert got == brute_grams(records, 4)


@pytest.mark.parametrize("n", [1, 3])
def test_top_n(spark, n):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None, "c"]), rng.choice([None, 1, 2, 3, 3, 3]), rng.randint(0, 3), f"t{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "g string, s long, x int, t string").withColumn("_bound", F.lit(1)).withColumn("_group", F.lit("z")).repartition(7)
    got = sorted((r.g, r["rank"], r.t) for r in topn.top_n_per_group(df, "g", "s", ["x", "t"], n, "rank").collect())
    want = []
    for g in ("hot", "b", "c"):
        own = sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (-r[1], r[2], r[3]))
        want += [(g, i + 1, r[3]) for i, r in enumerate(own[:n])]
    assert got == sorted(want)
    assert topn.top_n_per_group(df.limit(0), "g", "s", ["x", "t"], n).count() == 0


def test_bounds_cut_the_shuffle(spark):
    """Each partition's N-th best is a bound: of one hot group at most N rows a partition are ranked."""
    df = spark.range(0, 10_000, numPartitions=8).select(F.lit("g").alias("g"), F.col("id").alias("s"), F.col("id").alias("t"))
    bounds = topn._local_bounds(df, "g", "s", ["t"], 5).collect()
    assert len(bounds) == 8 and max(b.s for b in bounds) == 9995


def test_latest(spark):
    rows = [("a", 1, 5), ("a", 2, None), ("b", None, 7), ("b", 1, 3), ("b", 1, 4)]
    df = spark.createDataFrame(rows, "k string, at int, c int").withColumn("_place", F.lit(0))
    assert sorted((r.k, r.c) for r in topn.latest_valid(df, ["k"], "at", ["c"]).collect()) == [("a", None), ("b", 4)]
