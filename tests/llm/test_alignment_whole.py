"""Sentence alignment does the whole job: places far off, frequent sentences, paragraphs without a place."""

import random
from itertools import combinations

import pyarrow as pa

from tellgrid.llm import alignment
from tests.llm.test_alignment_stuffing import aligned, bilingual


def test_far_from_its_place(spark):
    """A paragraph whose range points to the wrong end of its text is paired all the same."""
    lines, words, paragraphs, truth = bilingual(40, seed=3)
    lines += [("far", f"f{i}", i, str(i), None) for i in range(1, 41)]
    rng, said = random.Random(5), []
    here, there = "temple canal reed palm stone gate barley wool".split(), "silver bread field boat lamp sheep moon honey goat salt".split()
    pairs = [rng.sample(list(combinations(nouns, 2)), n) for nouns, n in ((here, 16), (there, 24))]
    for i, (a, b) in enumerate(pairs[0] + pairs[1], 1):
        words += [("far", f"f{i}", n, f"{g}x", f"{g}x", g) for n, g in enumerate((a, b, "build"))]
        said.append(f"The {a} built the {b}")
    paragraphs = paragraphs + [("far", "far.p1", "1-6", ". ".join(said[33:39]) + ".")]
    found = {r for r in aligned(spark, lines, words, paragraphs) if r[0] == "far"}
    wanted = {("far", f"f{34 + i}", "far.p1", 1 + i) for i in range(6)}
    assert len(found & wanted) >= 5


def test_frequent_sentences(spark):
    """A refrain translated in every text is paired in every text; a remark that stands in as many is paired with nothing."""
    lines, words, paragraphs, _ = bilingual(40, seed=4)
    wanted, numbers = set(), {}
    for n, (text, para, where, said) in enumerate(paragraphs):
        last = max(place for t, _, place, _, _ in lines if t == text)
        lines.append((text, "refrain", last + 1, str(last + 1), para))
        words += [(text, "refrain", i, f"{g}x", f"{g}x", g) for i, g in enumerate(("shepherd", "garden", "praise"))]
        paragraphs[n] = (text, para, f"1-{last + 1}" if where else "", said + " The shepherd praised the garden.")
        wanted.add((text, "refrain", para, said.count(".") + 1))
        numbers[text] = [i for i, s in enumerate(said.split(". "), 1) if s.strip(".").lower() == "two lines are lost"]
    found = aligned(spark, lines, words, paragraphs)
    assert len(found & wanted) >= 38
    assert sum(sent in numbers[text] for text, _, _, sent in found) <= 2


def test_paragraphs_without_a_place(spark):
    """Texts whose ranges are empty, whose lines name no paragraph and whose paragraphs have no number are paired too."""
    lines, words, paragraphs, truth = bilingual(40, seed=6)
    bare = {f"t{t}" for t in range(20)}
    lines = [(*line[:4], None) if line[0] in bare else line for line in lines]
    paragraphs = [(t, "main", "", said) if t in bare else (t, para, where, said) for t, para, where, said in paragraphs]
    wanted = {(t, line, "main", sent) for t, line, _, sent in truth if t in bare}
    found = {r for r in aligned(spark, lines, words, paragraphs) if r[0] in bare}
    right = len(found & wanted)
    assert right / len(wanted) > 0.85 and right / len(found) > 0.9


def test_order_of_rows_and_ties(spark):
    """Rows in any order give the same pairs, also where lines and paragraphs share a place."""
    lines, words, paragraphs, _ = bilingual(30, seed=8)
    lines = [(t, line, place - place % 2, label, para) for t, line, place, label, para in lines]
    paragraphs += [(t, t + ".p2", where, said) for t, _, where, said in paragraphs[:10]]
    first = aligned(spark, lines, words, paragraphs)
    rng = random.Random(1)
    for rows in (lines, words, paragraphs):
        rng.shuffle(rows)
    assert first and aligned(spark, lines, words, paragraphs) == first


def test_small_and_large_corpus(spark):
    """A text is aligned alike in a small corpus and in one four times as large."""
    lines, words, paragraphs, truth = bilingual(100, seed=9)
    few = {f"t{i}" for i in range(25)}
    small = aligned(spark, *[[r for r in rows if r[0] in few] for rows in (lines, words, paragraphs)])
    large = {r for r in aligned(spark, lines, words, paragraphs) if r[0] in few}
    truth = {r for r in truth if r[0] in few}
    assert len(small & large) >= 0.93 * max(len(small), len(large))
    assert len(large & truth) >= 0.9 * len(truth) and len(small & truth) >= 0.88 * len(truth)


def test_candidates_of_estimation():
    """A line four places before or five after a clause is a candidate in expectation-maximization."""
    rows = [(1, 0, 1, 10.0, [7]), (1, 0, 0, 6.0, [101]), (1, 0, 0, 15.0, [102])]
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int8(), pa.float64(), pa.list_(pa.int64())))]
    held = pa.Table.from_arrays(columns, names=["segment", "seg", "kind", "place", "tokens"])
    counts = alignment._expect(None)(held, held.slice(0, 0))
    assert {101, 102} <= set(counts.column("key").to_pylist())
