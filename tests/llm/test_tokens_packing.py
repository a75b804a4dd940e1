"""Encoding, exact joins and packing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tellgrid.llm import packing, tokens

PATH = os.path.join(tokens.FOLDER, tokens.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="public vocabulary files are missing")


def test_joins_are_exact():
    enc = tokens.encoder(PATH)
    joiner, rng = tokens.Joiner(enc), random.Random(5)
    for _ in range(1500):
        letters = rng.choice(["ab", "aeinst", "abcdefghijklmnopqrstuvwxyz", " aetn", "𒀭é", "-=", "0123456789"])
        data = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70))).encode()
        step = rng.randint(1, 9)
        leaves = [enc._encode_single_piece(data[i : i + step]) for i in range(0, len(data), step)]
        assert joiner.tree(leaves) == (enc._encode_single_piece(data) if data else [])


TEXTS = [
    None, "", "  \n ", "a" * 500 + " x " + "the" * 300, "𒀭𒈗" * 400 + " foo  bar\n\n" + "-" * 300, "hello 'sx world <|endoftext|>", " " * 300 + "x", "\n" * 200 + "y" * 200 + "\n\n",
    "word " * 2000, "é" * 64, "1" * 64 + "a", "\r\n" * 100 + "a b",
]


@pytest.mark.parametrize("leaf", [32, tokens.LEAF])
def test_corpus(spark, leaf):
    enc = tokens.encoder(PATH)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, key string").withColumn("ids", F.lit(1))
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, "doc_id", "text", leaf=leaf).collect()}
    assert got == {i: enc.encode(t, disallowed_special=()) if t else [] for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.ids for r in tokens.encode_corpus(df, "doc_id", "text", leaf=leaf, count_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    back = {i: enc.decode(x) for i, x in got.items()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("leaf", [32, tokens.LEAF])
def test_repeated_keys(spark, leaf):
    """Rows of one key all come out, also those of long texts."""
    enc = tokens.encoder(PATH)
    rows = [(1, "a" * 400), (1, "a" * 400), (1, "b" * 400), (2, "c"), (2, "c"), (None, "-" * 400), (None, "-" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, tuple(r.ids)) for r in tokens.encode_corpus(df, "doc_id", "text", leaf=leaf).collect())
    assert got == sorted((k or 0, tuple(enc.encode(t))) for k, t in rows)
    sizes = sorted((r.doc_id or 0, r.ids) for r in tokens.encode_corpus(df, "doc_id", "text", leaf=leaf, count_only=True).collect())
    assert sizes == sorted((k, len(x)) for k, x in got)


def test_other_library_agrees(spark):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(os.path.join(tokens.FOLDER, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in tokens.encode_corpus(df, "doc_id", "text", leaf=32).collect():
        assert list(r.ids) == (other.encode(TEXTS[r.doc_id], add_special_tokens=False).ids if TEXTS[r.doc_id] else [])


def check(rows, items, capacity):
    """Every item whole in one container, over-long ones in full containers and a remainder; no container too full."""
    load, seen = {}, {}
    for key, piece, size, container in rows:
        seen.setdefault(key, []).append((piece, size, container))
        if container is not None:
            load[container] = load.get(container, 0) + size
    assert all(v <= capacity for v in load.values()) and sorted(load) == list(range(len(load)))
    for key, size in items:
        pieces = sorted(seen[key])
        assert sum(p[1] for p in pieces) == (size or 0)
        if not size:
            assert pieces == [(0, 0, None)]
        else:
            assert [p[1] for p in pieces] == [capacity] * (size // capacity) + ([size % capacity] if size % capacity else []) or size <= capacity and len(pieces) == 1
    return load


def first_fit(sizes, capacity):
    """Containers that first-fit decreasing needs, over-long items split alike."""
    gaps, whole = [], 0
    for size in sorted((s - s // capacity * capacity if s > capacity else s for s in sizes if s), reverse=True):
        at = next((i for i, gap in enumerate(gaps) if gap >= size), None)
        if at is None:
            gaps.append(capacity - size)
        else:
            gaps[at] -= size
    whole = sum(s // capacity for s in sizes if s and s > capacity)
    return len(gaps) + whole


@pytest.mark.parametrize("sizes", ["mixed", "hot", "large", "small"])
def test_packing(spark, sizes):
    rng = random.Random(sizes)
    draw = {
        "mixed": lambda: rng.choice([None, 0, rng.randint(1, 100), rng.randint(1, 30), rng.randint(101, 450)]),
        "hot": lambda: 37 if rng.random() < 0.6 else rng.randint(1, 60),
        "large": lambda: rng.randint(51, 100),
        "small": lambda: rng.randint(1, 5),
    }[sizes]
    items = [(i, draw()) for i in range(1500)]
    df = spark.createDataFrame(items, "id long, n int").withColumn("size", F.lit("x")).withColumn("container", F.lit(3))
    rows = [tuple(r) for r in packing.pack(df, "id", "n", 100).select("id", "piece", "size", "container").collect()]
    load = check(rows, items, 100)
    assert len(load) <= first_fit([n for _, n in items], 100)
    if sizes in ("mixed", "small"):
        assert sum(load.values()) / 100 / len(load) > 0.985
    spread = [tuple(r) for r in packing.pack(df, "id", "n", 100, bucket=7).select("id", "piece", "size", "container").collect()]
    assert len(check(spread, items, 100)) == len(load)
    other = {tuple(r) for r in packing.pack(df.repartition(3), "id", "n", 100).select("id", "piece", "size", "container").collect()}
    assert other == set(rows)  # the same for any partitioning


def test_packing_nothing(spark):
    df = spark.createDataFrame([], "id long, n int")
    assert packing.pack(df, "id", "n", 10).count() == 0
    assert packing.plan({}, 10) == []
    assert packing.plan({10: 3}, 10) == [({10: 1}, 3)]


def test_two_fit():
    """Greedy filling puts 6 and 3 into the bin; two unpacked items of 2 fill it better than the 3."""
    bins = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert bins[0] == ({6: 1, 2: 2}, 1)
