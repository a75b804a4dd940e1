"""Sentence alignment in bilingual documents.

Translation tables are estimated by distributed expectation-maximization (a word-to-word model with an empty word): the
texts are cut into segments of bounded length, segments are spread over groups, and in every round each group gets the
segments it holds and just the rows of the table for their words, sums the expected counts, and the sums of all groups
give the next table. Words travel as 64-bit hashes, a source word's row as packed arrays, and the expectation is array
arithmetic; neither the corpus nor the table is ever in one place.

With the final table competitive linking pairs spans: the strongest compatible pair is accepted first, wherever it
stands, then the next that does not contradict it, so order is free. A sentence is read in its clauses (which undoes
merges); a clause that says what is left of a neighbour's line is a second link of that line (a split); what remains
competes once more, with less to show, for the lines its linked neighbours leave open. Pairs below the thresholds stay
unlinked (omissions and additions).

Linking goes over the text twice: first each clause with the lines up to ``REACH`` places from where it is expected, then
the clauses without a firm link with the lines without one, however far apart in the text. The second pass finds its pairs
by the rarest words of a clause: as many of them as a pair of sufficient score cannot do without, so none is missed. It
competes by rounds of pairs that are the best of both their clause and their line, which gives what accepting the best
pair first gives, without a text in one task.

A sentence ends with . ! or ? before white space or the end. Where a paragraph stands in the document comes from its line
range, else from the lines that name it, else from its neighbours, else from its order in the text, and only guides the
search. A sentence may recur in any number of documents: a remark stays unlinked because no line accounts for its words.

Defined results
---------------
* null or empty translations and lines without words give no pairs; a word without a gloss counts under its own form;
* repeated rows count once; empty tables give no rows; a line or paragraph of another document is never paired;
* a word said any number of times in a line counts so often, though the line travels as its distinct words;
* nothing depends on the order of rows; ties go to the nearer, then the earlier clause and line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellgrid.session import cut, ship, width

#: Rounds of expectation-maximization, how far before and after a clause a line may be to be its candidate in them, and the
#: least probability that a pair of words keeps.
ROUNDS, BEFORE, AFTER, KEPT = 5, 4, 5, 1e-4
#: Share of a word's expectation below which a pair of words gets nothing of it.
LEAST_EXPECTED = 1e-3
#: Places of a segment, and how far from its expected place a clause is compared in the first pass.
SEGMENT, REACH = 256, 8
#: Least quality of a pair that stands far from where it is expected.
FAR_QUALITY = 0.7
#: Clauses a group holds, on average.
GROUP = 32_000
#: Cells up to which a group keeps its pairs of words in a dense array, and word pairs worked on at once.
DENSE, CHUNK = 1 << 24, 1 << 21
#: A word says something if one source word accounts for at least this share of its uses; others (people, someone, it) do not.
CONCENTRATION = 0.1
#: A line translates a clause only if it accounts for this share of all its words, telling or not, by their rarity (fixed value).
LEAST_SHARE = 0.2
#: Weight of a source word of which no translation is known, and probability of a pair of words that is not in the table.
UNKNOWN, UNSEEN = 5.0, 1e-7

_SENTENCE_END = r"(?<=[.!?])\s+"
_CLAUSE = r";\s+|,\s+(?:while|and)\s+"
_WORDS = r"[\p{L}\p{N}\p{M}]+"
#: Kinds of rows (fixed values): source words and lines, target words and clauses.
SOURCE, TARGET = 0, 1


def source_tokens(words: DataFrame, text: str, line: str, position: str, lemma: str, form: str, gloss: str, hashed: bool = False) -> DataFrame:
    """text, line, tokens, times: the distinct gloss words of each line and how often; a lemma's commonest gloss stands in where a word has none.

    With ``hashed`` the tokens are the 64-bit hashes that alignment works with.
    """
    rows = words.select(
        F.col(text).alias("text"), F.col(line).alias("line"), F.col(position).alias("at"),
        F.when(F.col(lemma) != "", F.col(lemma)).alias("lemma"), F.col(form).alias("form"), F.when(F.col(gloss) != "", F.col(gloss)).alias("gloss"),
    ).distinct()
    rows = cut(rows) if hashed else rows
    counted = rows.filter("lemma is not null and gloss is not null").groupBy("lemma", "gloss").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(F.col("lemma").alias("l")).agg(F.max(F.struct("n", "gloss")).alias("b")).select("l", F.col("b.gloss").alias("own"))
    bare = rows.filter("gloss is null").join(best, F.col("lemma") == F.col("l"), "left")
    token = F.coalesce(F.col("own"), F.concat(F.lit("#"), F.coalesce("lemma", "form", F.lit(""))))
    filled = rows.filter("gloss is not null").select("text", "line", "gloss").unionByName(bare.select("text", "line", token.alias("gloss")))
    each = filled.select("text", "line", F.explode(F.split(F.lower("gloss"), r"\s+")).alias("token")).filter("token <> ''")
    each = each.select("text", "line", F.xxhash64("token").alias("token")) if hashed else each
    # counted before they are listed: the list of a line is bounded by the vocabulary
    counted = each.groupBy("text", "line", "token").agg(F.count(F.lit(1)).cast("int").alias("n"))
    listed = counted.groupBy("text", "line").agg(F.array_sort(F.collect_list(F.struct("token", "n"))).alias("all"))
    return listed.select("text", "line", F.col("all.token").alias("tokens"), F.col("all.n").alias("times"))


def _spans(paragraphs: DataFrame, lines: DataFrame) -> DataFrame:
    """text, para, first, last place of every paragraph of a text with lines."""
    labels = lines.filter("label is not null").groupBy(F.col("text").alias("lt"), F.col("label").alias("ll")).agg(F.min("place").alias("at"))
    ends = paragraphs.select(
        "text", "para", F.regexp_extract("range", r"^\s*(\S+?)\s*-\s*(\S+)\s*$", 1).alias("a"), F.regexp_extract("range", r"^\s*(\S+?)\s*-\s*(\S+)\s*$", 2).alias("b")
    )
    first = labels.select("lt", "ll", F.col("at").alias("first"))
    last = labels.select(F.col("lt").alias("mt"), F.col("ll").alias("ml"), F.col("at").alias("last"))
    ranged = ends.join(first, (F.col("text") == F.col("lt")) & (F.col("a") == F.col("ll"))).join(last, (F.col("text") == F.col("mt")) & (F.col("b") == F.col("ml")))
    ranged = ranged.groupBy("text", "para").agg(F.min("first").alias("r1"), F.max("last").alias("r2")).filter("r1 <= r2")
    named = lines.filter("para is not null").groupBy("text", "para").agg(F.percentile_approx("place", 0.5).alias("mid"), F.count(F.lit(1)).alias("n"))
    named = named.select("text", "para", (F.col("mid") - (F.col("n") - 1) / 2).alias("n1"), (F.col("mid") + (F.col("n") - 1) / 2).alias("n2"))
    number = F.try_to_number(F.regexp_extract("para", r"(\d{1,9})$", 1), F.lit("999999999")).cast("bigint")
    size = F.max(F.length(F.coalesce("translation", F.lit(""))) + 1).cast("double").alias("size")
    placed = (
        paragraphs.groupBy("text", "para").agg(size).withColumn("number", number).join(ranged, ["text", "para"], "left").join(named, ["text", "para"], "left")
        .select("text", "para", "number", "size", F.coalesce("r1", "n1").alias("first"), F.coalesce("r2", "n2").alias("last"))
    )
    placed = cut(placed)
    known = placed.filter("first is not null and number is not null")
    after = known.select(F.col("text").alias("at"), (F.col("number") + 1).alias("an"), (F.col("last") + 1).alias("left"))
    before = known.select(F.col("text").alias("bt"), (F.col("number") - 1).alias("bn"), (F.col("first") - 1).alias("right"))
    open_ones = placed.filter("first is null").drop("first", "last", "size")
    open_ones = open_ones.join(after, (F.col("text") == F.col("at")) & (F.col("number") == F.col("an")), "left").join(
        before, (F.col("text") == F.col("bt")) & (F.col("number") == F.col("bn")), "left"
    )
    guessed = open_ones.select(
        "text", "para", F.coalesce("left", F.col("right") - 3).alias("first"), F.greatest(F.coalesce("right", F.col("left") + 3), F.coalesce("left", F.col("right") - 3)).alias("last")
    )
    found = placed.filter("first is not null").select("text", "para", "first", "last").unionByName(guessed.filter("first is not null"))
    found = found.groupBy("text", "para").agg(F.min("first").cast("double").alias("first"), F.max("last").cast("double").alias("last"))
    # the others share what lies between the placed ones before and after them (or the ends of the text), by their length
    whole = lines.filter("place is not null").groupBy("text").agg(F.min("place").cast("double").alias("low"), F.max("place").cast("double").alias("high"))
    every = placed.select("text", "para", "number", "size").join(found, ["text", "para"], "left").join(whole, "text")
    order = Window.partitionBy("text").orderBy(F.col("number").asc_nulls_last(), "para")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    every = every.withColumn("from", F.coalesce(F.max("last").over(before) + 1, "low")).withColumn("to", F.coalesce(F.min("first").over(after) - 1, "high"))
    every = every.withColumn("to", F.greatest("from", "to")).withColumn("gap", F.count("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gap = Window.partitionBy("text", "gap", F.col("first").isNull())
    end = F.sum("size").over(gap.orderBy(F.col("number").asc_nulls_last(), "para").rowsBetween(Window.unboundedPreceding, 0))
    every = every.withColumn("end", end / F.sum("size").over(gap)).withColumn("part", F.col("size") / F.sum("size").over(gap))
    room = F.col("to") - F.col("from") + 1
    begin = F.col("from") + (F.col("end") - F.col("part")) * room
    return every.select("text", "para", F.coalesce("first", begin).alias("first"), F.coalesce("last", begin + F.col("part") * room - 1).alias("last"))


def _clauses(paragraphs: DataFrame, spans: DataFrame) -> DataFrame:
    """text, para, sent, sub, k (its number in the paragraph), place, tokens of every clause."""
    sentences = F.filter(F.split(F.trim("translation"), _SENTENCE_END), lambda s: s != "")
    numbered = F.transform(sentences, lambda s, i: F.transform(F.split(s, _CLAUSE), lambda c, j: F.struct((i + 1).alias("sent"), j.alias("sub"), c.alias("clause"))))
    clauses = paragraphs.select("text", "para", F.flatten(numbered).alias("all")).select("text", "para", F.size("all").alias("n"), F.posexplode("all").alias("k", "c"))
    placed = clauses.join(spans, ["text", "para"])
    place = F.col("first") + (F.col("k") + 0.5) / F.col("n") * (F.col("last") - F.col("first") + 1) - 0.5
    tokens = F.regexp_extract_all(F.lower("c.clause"), F.lit(_WORDS), F.lit(0))
    return placed.select("text", "para", "c.sent", "c.sub", "k", place.alias("place"), tokens.alias("tokens")).filter(F.size("tokens") > 0)


def _hashed(rows: DataFrame) -> Column:
    """The tokens of the rows as hashes, if they are not already."""
    given = F.col("tokens")
    return given if rows.schema["tokens"].dataType.elementType.typeName() == "long" else F.transform(given, lambda t: F.xxhash64(t))


def _segmented(rows: DataFrame, place: Column, margin: int) -> DataFrame:
    """A row in its own segment (core) and, near its edges, in the neighbouring one too."""
    own = F.floor(place / SEGMENT).cast("int")
    within = place - own * SEGMENT
    segs = F.array_compact(F.array(own, F.when(within < margin, own - 1), F.when(within >= SEGMENT - margin, own + 1)))
    return rows.withColumn("own", own).withColumn("seg", F.explode(segs)).withColumn("core", F.col("seg") == F.col("own")).drop("own")


def _lists(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the list of each row begins (and the last ends), and all values."""
    lists = rows.column(column).combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    begin = lists.offsets.to_numpy().astype(np.int64)
    return begin - begin[0], lists.flatten().to_numpy(zero_copy_only=False)


def _packed(begin: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values, kind))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each low to its high, and to which range they belong."""
    sizes = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes - low, sizes)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _codes(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted array, and which of them are there."""
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


class _Pairs:
    """Numbers of pairs of words by key, dense where the vocabulary of the group allows it."""

    def __init__(self, size: int, keys: np.ndarray, values: np.ndarray, default: float) -> None:
        self.dense = None
        if size <= DENSE:
            self.dense = np.full(size, default, np.float32)
            self.dense[keys] = values
            return
        order = np.argsort(keys, kind="stable")
        self.keys, self.values, self.default = keys[order], values[order], default

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[keys]
        at, there = _codes(keys, self.keys)
        return np.where(there, self.values[at] if len(self.values) else self.default, self.default)


class _Sums:
    """Sums by pair of words."""

    def __init__(self, size: int) -> None:
        self.size, self.keys, self.sums = size, np.empty(0, np.int64), np.zeros(size if size <= DENSE else 0)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if self.size <= DENSE:
            self.sums += np.bincount(keys, values, self.size)
            return
        self.keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.sums = np.bincount(at, np.concatenate([self.sums, values]), len(self.keys))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.size <= DENSE:
            keys = np.flatnonzero(self.sums)
            return keys, self.sums[keys]
        return self.keys, self.sums


#: Key of a segment's places: segments lie this far apart on one axis.
_APART = 4.0 * SEGMENT
#: Slack of comparisons of places.
_SLACK = 1e-6
_COUNTS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("e", pa.list_(pa.int64())), ("c", pa.list_(pa.float32()))])
_TABLE = pa.schema([*list(_COUNTS)[:3], ("c", pa.list_(pa.float64())), ("p", pa.list_(pa.float32()))])


def _by_place(rows: pa.Table, segment: np.ndarray, kind: int, ties: tuple[np.ndarray, ...] = ()) -> tuple[pa.Table, np.ndarray]:
    """The rows of a kind in the order of segment and place (then of ``ties``, the last first), and their places on one axis."""
    own = np.flatnonzero(_column(rows, "kind") == kind)
    place = _column(rows, "place")[own] - SEGMENT * _column(rows, "seg")[own].astype(float) + _APART * segment[own]
    order = np.lexsort((*(t[own] for t in ties), place))
    return rows.take(pa.array(own[order])), place[order]


def _expect(total: float | None):
    """Expected counts of a group; ``total`` is the sum of the empty word's counts, None in the first round."""

    def run(rows: pa.Table, given: pa.Table) -> pa.Table:
        _, segment = np.unique(_column(rows, "segment"), return_inverse=True)
        clauses, place = _by_place(rows, segment, TARGET)
        lines, at = _by_place(rows, segment, SOURCE)
        begin, words = _lists(clauses, "tokens")
        held, own = _lists(lines, "tokens")
        es, e_of = np.unique(words, return_inverse=True)
        fs, f_of = np.unique(own, return_inverse=True)
        size = len(fs) * len(es)
        said = np.bincount(e_of, minlength=len(es))
        # distinct words of each clause
        once = np.unique(np.repeat(np.arange(len(place)), np.diff(begin)) * max(1, len(es)) + e_of)
        clause_of, e_of = once // max(1, len(es)), once % max(1, len(es))
        inside = np.bincount(e_of, minlength=len(es))

        if total is None:
            empty = np.ones(len(es))
            same, there = _codes(fs, es)
            table = _Pairs(size, np.flatnonzero(there) * len(es) + same[there], np.full(there.sum(), 20.0), 1.0)
        else:
            kind, key = _column(given, "kind"), _column(given, "key")
            spans, e = _lists(given, "e")
            _, p = _lists(given, "p")
            empty = np.full(len(es), UNSEEN)
            target = given.filter(pa.array(kind == TARGET))
            at_e, there = _codes(_column(target, "key"), es)
            first, c = _lists(target, "c")
            empty[at_e[there]] = c[first[:-1]][there] / total
            source = np.repeat(kind == SOURCE, np.diff(spans))
            f = np.repeat(np.searchsorted(fs, key), np.diff(spans))[source]
            e, there = _codes(e[source], es)
            table = _Pairs(size, (f * len(es) + e)[there], p[there].astype(float), UNSEEN)

        # words of the lines near each clause, by clause
        c_of, l_of = _ranges(np.searchsorted(at, place - BEFORE - _SLACK), np.searchsorted(at, place + AFTER + _SLACK, "right"))
        near = np.exp(-np.abs(at[l_of] - place[c_of]) / 1.5)
        by, word = _ranges(held[l_of], held[l_of + 1])
        weight, f_near, starts = near[by], f_of[word] * len(es), np.searchsorted(c_of[by], np.arange(len(place) + 1))
        low, high = starts[clause_of], starts[clause_of + 1]
        known = high > low
        clause_of, e_of, low, high = clause_of[known], e_of[known], low[known], high[known]
        counts, none, done = _Sums(size), np.zeros(len(es)), np.cumsum(high - low)
        begin = 0
        while begin < len(e_of):
            end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + CHUNK)))
            part, e = slice(begin, end), e_of[begin:end]
            by, word = _ranges(low[part], high[part])
            keys = f_near[word] + e[by]
            p = table(keys) * weight[word]
            nothing = 2.0 * empty[e]
            whole = np.add.reduceat(p, np.concatenate([[0], np.cumsum(high[part] - low[part])[:-1]])) + nothing
            none += np.bincount(e, nothing / whole, len(es))
            p /= whole[by]
            good = p > LEAST_EXPECTED
            counts.add(keys[good], p[good])
            begin = end
        keys, sums = counts.all()
        f, e = keys // max(1, len(es)), keys % max(1, len(es))
        different, first = np.unique(f, return_index=True)
        ends = np.concatenate([first, [len(f)], len(f) + 1 + np.arange(len(es))]) if len(es) else np.concatenate([first, [len(f)]])
        lists = [pa.array(np.repeat([SOURCE, TARGET], [len(different), len(es)]), pa.int8()), pa.array(np.concatenate([fs[different], es]), pa.int64())]
        targets = np.stack([none, said, inside], 1).ravel()
        c_ends = np.concatenate([first, len(f) + 3 * np.arange(len(es) + 1)])
        lists += [_packed(ends, np.concatenate([es[e], es]), pa.int64()), _packed(c_ends, np.concatenate([sums, targets]), pa.float32())]
        return pa.Table.from_arrays(lists, schema=_COUNTS)

    return run


def _maximize(rows: pa.Table) -> pa.Table:
    """The rows of the next table for a bucket of words: summed counts and probabilities of at least ``KEPT``."""
    kind = _column(rows, "kind")
    source, target = rows.filter(pa.array(kind == SOURCE)), rows.filter(pa.array(kind == TARGET))
    fs, f_of = np.unique(_column(source, "key"), return_inverse=True)
    begin, e = _lists(source, "e")
    es, e_of = np.unique(e, return_inverse=True)
    keys, at = np.unique(np.repeat(f_of, np.diff(begin)) * max(1, len(es)) + e_of, return_inverse=True)
    c = np.bincount(at, _lists(source, "c")[1].astype(float), len(keys))
    f = keys // max(1, len(es))
    p = c / np.bincount(f, c, len(fs))[f]
    kept = p > KEPT
    keys, f, c, p = keys[kept], f[kept], c[kept], p[kept]
    begin = np.searchsorted(f, np.arange(len(fs) + 1))
    words, at = np.unique(_column(target, "key"), return_inverse=True)
    three = _lists(target, "c")[1].astype(float)
    sums = np.stack([np.bincount(at, three[i::3], len(words)) for i in range(3)], 1).ravel()
    steps = np.arange(1, len(words) + 1)
    return pa.Table.from_arrays(
        [
            pa.array(np.repeat([SOURCE, TARGET], [len(fs), len(words)]), pa.int8()),
            pa.array(np.concatenate([fs, words]), pa.int64()),
            _packed(np.concatenate([begin, begin[-1] + steps]), np.concatenate([es[keys % max(1, len(es))], words]), pa.int64()),
            _packed(np.concatenate([begin, begin[-1] + 3 * steps]), np.concatenate([c, sums]), pa.float64()),
            _packed(np.concatenate([begin, np.full(len(words), begin[-1])]), p, pa.float32()),
        ],
        schema=_TABLE,
    )


def _one_to_one(pair: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray, times: np.ndarray, number: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Total value of each pair's one-to-one matches of words a with words b (which are there ``times``), best first; and the b of the pairs with hits."""
    order = np.lexsort((b, a, -value, pair))
    pair, a, b, value = pair[order], a[order], b[order], value[order]
    total = np.bincount(pair, value, number)
    # pairs in which a word matches twice are settled one by one
    twice = np.zeros(number, bool)
    for side in (a, b):
        by = np.lexsort((side, pair))
        again = (pair[by][1:] == pair[by][:-1]) & (side[by][1:] == side[by][:-1])
        twice[pair[by][1:][again]] = True
    begin = np.searchsorted(pair, np.arange(number + 1))
    used: dict[int, list[int]] = {}
    words, sides, values = a.tolist(), b.tolist(), value.tolist()
    for k in np.flatnonzero(np.diff(begin)).tolist():
        low, high = int(begin[k]), int(begin[k + 1])
        if not twice[k]:
            used[k] = sides[low:high]
            continue
        left, right, sum_, own = set(), {}, 0.0, []
        for n in range(low, high):
            if words[n] not in left and right.get(sides[n], 0) < times[sides[n]]:
                left.add(words[n])
                right[sides[n]] = right.get(sides[n], 0) + 1
                sum_ += values[n]
                own.append(sides[n])
        total[k], used[k] = sum_, own
    return total, used


def _gain(used: list[int], taken: list[int], weights: np.ndarray) -> float:
    """Weight of the words used that are not taken."""
    rest = list(taken)
    total = 0.0
    for b in used:
        if b in rest:
            rest.remove(b)
        else:
            total += weights[b]
    return total


def _fits(gain: float, covered: float, beside: bool) -> bool:
    """It says words of the line that are not said yet, or right beside it only what the line says."""
    return (gain > 1.5 and covered >= (0.6 if beside else 0.75)) or (beside and covered >= 0.8)


_LINKS = pa.schema(
    [("what", pa.int8()), ("text", pa.string()), ("line", pa.string()), ("sentence", pa.string()), ("sub", pa.int32()), ("k", pa.int32()), ("score", pa.float64()), ("place", pa.float64())]
    + [("said", pa.float64()), ("least", pa.float64()), ("words", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("slots", pa.list_(pa.int32())), ("rare", pa.list_(pa.int64()))]
    + [("weights", pa.list_(pa.float64())), ("times", pa.list_(pa.int32()))]
)
#: What a row of the first pass says (fixed values): a link by the words of its own, one of a split, one of the places left open, or an open clause or line.
DIRECT, SPLIT, LOOSE, CLAUSE, LINE = range(5)


def _link(rows: pa.Table, given: pa.Table) -> pa.Table:
    """Links of a group's segments, and what the second pass needs of its open clauses and lines."""
    keys = rows.select(["text", "seg"]).to_pandas()
    segment = keys.groupby(["text", "seg"], sort=True).ngroup().to_numpy()
    # what stands at one place goes by its name, whatever the order of the rows
    ties = _column(rows, "sub"), pd.factorize(rows.column("id").to_pandas(), sort=True)[0]
    clauses, place = _by_place(rows, segment, TARGET, ties)
    lines, at = _by_place(rows, segment, SOURCE, ties)
    begin, words = _lists(clauses, "tokens")
    held, own = _lists(lines, "tokens")
    times = _lists(lines, "times")[1]
    es, e_of = np.unique(words, return_inverse=True)
    fs, f_of = np.unique(own, return_inverse=True)
    kind, key, x, y = (_column(given, c) for c in ("kind", "key", "x", "y"))
    target = kind == TARGET
    idf, rarity = np.zeros(len(es)), np.zeros(len(es))
    at_e, there = _codes(key[target], es)
    idf[at_e[there]], rarity[at_e[there]] = np.nan_to_num(x[target])[there], y[target][there]
    heavy = np.full(len(fs), UNKNOWN)
    at_f, there = _codes(key[~target], fs)
    heavy[at_f[there]] = x[~target][there]
    spans, e = _lists(given, "e")
    _, s = _lists(given, "s")
    row_f = np.repeat(np.searchsorted(fs, key), np.diff(spans))
    same, there = _codes(fs, es)
    here = np.flatnonzero(there)
    local, known = _codes(e, es)
    known &= e != fs[row_f] if len(row_f) else known
    pair_keys = np.concatenate([(row_f * len(es) + local)[known], here * len(es) + same[here]])
    match = _Pairs(len(fs) * len(es), pair_keys, np.concatenate([s[known], np.ones(len(here))]), 0.0)

    number = len(place)
    owner = np.repeat(np.arange(number), np.diff(begin))
    least = LEAST_SHARE * np.bincount(owner, rarity[e_of], number)
    telling = idf[e_of] > 0
    owner, e_of = owner[telling], e_of[telling]
    said = np.bincount(owner, idf[e_of], number)
    content = np.searchsorted(owner, np.arange(number + 1))
    weights = heavy[f_of]
    line_of = np.repeat(np.arange(len(at)), np.diff(held))
    whole = np.bincount(line_of, weights * times, len(at))

    # pairs within reach, and the matches of their words
    j_of, i_of = _ranges(np.searchsorted(at, place - REACH - 0.5 - _SLACK), np.searchsorted(at, place + REACH + 0.5 + _SLACK, "right"))
    cost = np.cumsum((content[j_of + 1] - content[j_of]) * (held[i_of + 1] - held[i_of]))
    hits: list[tuple[np.ndarray, ...]] = []
    low = 0
    while low < len(j_of):
        high = max(low + 1, int(np.searchsorted(cost, (cost[low - 1] if low else 0) + CHUNK)))
        by, slot = _ranges(held[i_of[low:high]], held[i_of[low:high] + 1])
        again, word = _ranges(content[j_of[low:high]][by], content[j_of[low:high] + 1][by])
        strength = match(f_of[slot[again]] * len(es) + e_of[word])
        good = np.flatnonzero(strength)
        hits.append((low + by[again[good]], word[good], slot[again[good]], strength[good] * idf[e_of[word[good]]]))
        low = high
    pair, a, b, value = (np.concatenate(h) if hits else np.empty(0, np.int64) for h in (zip(*hits) if hits else ((),) * 4))
    pair = pair.astype(np.int64)
    enough = np.bincount(pair, value, len(j_of)) >= least[j_of] if len(pair) else np.zeros(len(j_of), bool)
    mask = enough[pair]
    pair, a, b, value = pair[mask], a[mask], b[mask], value[mask]
    total, used = _one_to_one(pair, a, b, value, times, len(j_of))
    there = np.flatnonzero((total > 0) & (total >= least[j_of]))
    j, i, total = j_of[there], i_of[there], total[there]
    used = [used[k] for k in there.tolist()]
    far = np.maximum(0.0, np.abs(at[i] - place[j]) - 0.5)
    covered = total / said[j]
    quality = np.sqrt(covered * np.minimum(1.0, total / whole[i]))
    fit = (quality >= np.where(far < 3, 0.5, FAR_QUALITY)) | ((covered >= 0.8) & (far < 3) & (total > 1))
    score = total * np.exp(-far / 6) * (0.5 + quality)
    js, is_, covers, totals, scores = (v.tolist() for v in (j, i, covered, total, score))

    found = dict(zip(zip(js, is_), range(len(js))))
    best = np.flatnonzero(fit)
    link: dict[int, int] = {}
    taken: dict[int, list[int]] = {}
    what: dict[int, int] = {}
    worth: dict[int, float] = {}
    for n in best[np.lexsort((i[best], j[best], far[best], -score[best]))].tolist():
        if js[n] not in link and is_[n] not in taken:
            link[js[n]], taken[is_[n]], what[js[n]], worth[js[n]] = is_[n], used[n], DIRECT, scores[n]
    direct, side = dict(link), np.floor((place + (_APART - SEGMENT) / 2) / _APART).tolist()
    for c in np.flatnonzero(said > 0).tolist():  # splits
        if c in direct:
            continue
        better = None
        for n in (c - 1, c + 1, c - 2, c + 2, c - 3, c + 3, c - 4, c + 4):
            if n in direct and side[n] == side[c] and (c, direct[n]) in found:
                k = found[c, direct[n]]
                gain = _gain(used[k], taken[direct[n]], weights)
                if _fits(gain, covers[k], abs(n - c) == 1) and (better is None or gain > better[0]):
                    better = gain, direct[n], scores[k]
        if better:
            link[c], what[c], worth[c] = better[1], SPLIT, better[2]
    # what is left competes for the lines that the links of its neighbours leave open
    firm, rest = dict(link), []

    def bounds(c: int) -> tuple[int | None, int | None]:
        low = [firm[n] for n in range(c - 3, c) if n in firm and side[n] == side[c]]
        high = [firm[n] for n in range(c + 1, c + 4) if n in firm and side[n] == side[c]]
        return max(low, default=None), min(high, default=None)

    for n, (c, line) in enumerate(zip(js, is_)):
        if c in firm or line in taken:
            continue
        low, high = bounds(c)
        if low is not None and high is not None and low < high:
            open_ = low < line < high
        elif low is not None:
            open_ = low < line < low + 3
        elif high is not None:
            open_ = high - 3 < line < high
        else:
            open_ = abs(at[line] - place[c]) < 1
        if open_:
            rest.append((-totals[n], abs(at[line] - place[c]), c, line))
    for more, _, c, line in sorted(rest):
        if c not in link and line not in taken:
            link[c], taken[line], what[c], worth[c] = line, [], LOOSE, -more
    return _answer(clauses, lines, place, at, link, what, worth, firm, (content, said, least, es, e_of, idf, held, fs, f_of, weights, times, spans, e, s, row_f))


def _answer(
    clauses: pa.Table, lines: pa.Table, place: np.ndarray, at: np.ndarray, link: dict[int, int], what: dict[int, int], worth: dict[int, float], firm: dict[int, int], known: tuple
) -> pa.Table:
    """The links of the core clauses, and the clauses and lines without a firm one with all that the second pass compares."""
    content, said, least, es, e_of, idf, held, fs, f_of, weights, times, spans, e, s, row_f = known
    core, sub, number = _column(clauses, "core"), _column(clauses, "sub"), _column(clauses, "k")
    texts, names = clauses.column("text").to_pylist(), clauses.column("id").to_pylist()
    line_names, line_texts, line_core = lines.column("id").to_pylist(), lines.column("text").to_pylist(), _column(lines, "core")
    out: list[tuple] = []
    within = at - _APART * np.floor((at + (_APART - SEGMENT) / 2) / _APART)
    edge = (within < REACH + 1) | (within >= SEGMENT - REACH - 1)
    where = _column(clauses, "place")
    for c in np.flatnonzero(core).tolist():
        if c in link:
            out.append((what[c], texts[c], line_names[link[c]], names[c], int(sub[c]), int(number[c]), worth[c], where[c], 0.0, 0.0, None, None, None, None, None, None))
        # a line that clauses of the next segment reach too may go to one of them, so its own stays in view
        if said[c] > 0 and (c not in firm or edge[firm[c]]):
            own = e_of[content[c] : content[c + 1]]
            values = idf[own]
            order = np.argsort(values, kind="stable")
            # quality q asks for a covered share of q * q; what the commoner words hold together may fall short of it
            rare = own[order[np.cumsum(values[order]) >= (FAR_QUALITY**2 - 1e-9) * said[c]]]
            out.append((CLAUSE, texts[c], None, names[c], int(sub[c]), int(number[c]), 0.0, where[c], said[c], least[c], es[own].tolist(), values.tolist(), None, np.unique(es[rare]).tolist(), None, None))
    busy = {firm[c] for c in firm}
    by_f = np.argsort(row_f, kind="stable")
    starts = np.searchsorted(row_f[by_f], np.arange(len(fs) + 1))
    where = _column(lines, "place")
    for n in np.flatnonzero(line_core).tolist():
        if n in busy:
            continue
        heard, strengths, slots = [], [], []
        for slot in range(int(held[n]), int(held[n + 1])):
            f = f_of[slot]
            rendered = by_f[starts[f] : starts[f + 1]]
            rendered = rendered[e[rendered] != fs[f]]
            heard += [int(fs[f]), *e[rendered].tolist()]
            strengths += [1.0, *s[rendered].tolist()]
            slots += [slot - int(held[n])] * (1 + len(rendered))
        own = slice(int(held[n]), int(held[n + 1]))
        out.append((LINE, line_texts[n], line_names[n], None, 0, 0, 0.0, where[n], 0.0, 0.0, heard, strengths, slots, None, weights[own].tolist(), times[own].tolist()))
    columns = list(zip(*out)) if out else [[]] * len(_LINKS)
    return pa.Table.from_arrays([pa.array(list(values), field.type) for values, field in zip(columns, _LINKS)], schema=_LINKS)


_SCORED = "text string, sentence string, sub int, k int, line string, far double, covered double, quality double, score double, used array<int>, weights array<double>"


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scores of candidates of the second pass; pairs that fall short of the least share or are too weak for any link drop out."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            heard: dict[int, list] = {}
            for e, strength, slot in zip(row.heard, row.strengths, row.slots):
                heard.setdefault(e, []).append((strength, slot))
            hits = sorted((-strength * value, a, slot) for a, (e, value) in enumerate(zip(row.words, row.values)) for strength, slot in heard.get(e, ()))
            left, right, total, used = set(), {}, 0.0, []
            for value, a, slot in hits:
                if a not in left and right.get(slot, 0) < row.times[slot]:
                    left.add(a)
                    right[slot] = right.get(slot, 0) + 1
                    used.append(slot)
                    total -= value
            whole, covered = float(np.dot(row.weights, row.times)), total / row.said
            if total >= row.least and covered >= FAR_QUALITY**2 - 1e-9:
                quality = float(np.sqrt(covered * min(1.0, total / whole)))
                out.append((row.text, row.sentence, row.sub, row.k, row.line, abs(row.place - row.at), covered, quality, total * (0.5 + quality), used, list(row.weights)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCORED.split(", ")])


def _compete(pairs: DataFrame, one: list[str], other: list[str], order: list[Column]) -> DataFrame:
    """The pairs that accepting the best compatible pair first gives, by rounds of pairs that are the best of both their sides.

    No side is gathered: the best of each is a maximum. ``order`` must tell all pairs apart. Every round accepts at least the best pair left.
    """
    names = [f"_o{n}" for n in range(len(order))]
    pairs = pairs.withColumn("_best", F.struct(*[o.alias(n) for o, n in zip(order, names)]))
    chosen = None
    while True:
        pairs = cut(pairs)
        if pairs.isEmpty():
            return pairs.drop("_best") if chosen is None else chosen.drop("_best")
        first = pairs.groupBy(*one).agg(F.min("_best").alias("_best"))
        second = pairs.groupBy(*other).agg(F.min("_best").alias("_best"))
        winners = cut(pairs.join(first, [*one, "_best"], "left_semi").join(second, [*other, "_best"], "left_semi"))
        chosen = winners if chosen is None else chosen.unionByName(winners)
        pairs = pairs.join(winners.select(*one), one, "left_anti").join(winners.select(*other), other, "left_anti")


def _second_pass(first: DataFrame, firm: DataFrame) -> DataFrame:
    """text, line, sentence, sub of the clauses and lines without a firm link that pair by their words anywhere in their text."""
    clause, line = ["text", "sentence", "sub"], ["text", "line"]
    clauses = first.filter(F.col("what") == CLAUSE).join(firm.select(*clause), clause, "left_anti")
    lines = first.filter(F.col("what") == LINE).join(firm.select(*line).distinct(), line, "left_anti")
    clauses = clauses.select(*clause, "k", "place", "said", "least", "words", "values", "rare")
    lines = lines.select(*line, F.col("place").alias("at"), F.col("words").alias("heard"), F.col("values").alias("strengths"), "slots", "weights", "times")
    said = clauses.select(*clause, F.explode("rare").alias("e"))
    heard = lines.select(*line, F.explode(F.array_distinct("heard")).alias("e"))
    candidates = said.join(heard, ["text", "e"]).select(*clause, "line").distinct()
    scored = cut(candidates.join(clauses, clause).join(lines, line).mapInPandas(_score, _SCORED))
    order = [-F.col("score"), F.col("far"), F.col("text"), F.col("sentence"), F.col("sub"), F.col("line")]
    direct = _compete(scored.filter(F.col("quality") >= FAR_QUALITY), clause, line, order)
    # splits, as in the first pass: a clause near one that has the line says what is left of it
    para = F.split("sentence", "\u0001")[0]
    near = direct.select("text", "line", para.alias("para"), F.col("k").alias("n"), F.col("used").alias("taken"))
    left = scored.join(direct.select(*clause), clause, "left_anti").withColumn("para", para).join(near, ["text", "line", "para"])
    left = left.withColumn("apart", F.abs(F.col("n") - F.col("k"))).filter("apart between 1 and 4")

    @F.pandas_udf("double")
    def gain(used: pd.Series, taken: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([_gain(list(u), list(t), w) for u, t, w in zip(used, taken, weights)], dtype=float)

    left = left.withColumn("gain", gain("used", "taken", "weights"))
    beside = F.col("apart") == 1
    fits = ((F.col("gain") > 1.5) & (F.col("covered") >= F.when(beside, 0.6).otherwise(0.75))) | (beside & (F.col("covered") >= 0.8))
    best = left.filter(fits).groupBy(*clause).agg(F.max_by("line", F.struct("gain", -F.col("apart"), "line")).alias("line"))
    return direct.select(*line, "sentence", "sub").unionByName(best.select(*line, "sentence", "sub"))


def align(lines: DataFrame, tokens: DataFrame, paragraphs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """text, line, para, sent of the pairs.

    ``lines`` has text, line, place (number), label, para; ``tokens`` text, line, tokens (words or their hashes), times; ``paragraphs`` text, para,
    range, translation.
    """
    spark = lines.sparkSession
    ship(spark)
    lines, paragraphs = lines.distinct(), paragraphs.distinct()
    clauses = cut(_clauses(paragraphs, _spans(paragraphs, lines)))
    count = clauses.count()
    placed = lines.filter("place is not null").groupBy("text", "line").agg(F.min("place").cast("double").alias("place"))
    source = placed.join(paragraphs.select("text").distinct(), "text", "left_semi").join(tokens, ["text", "line"])
    as_rows = [F.col(c) for c in ("text", "seg", "core")]
    sentence_id = F.concat_ws("\u0001", "para", F.col("sent").cast("string"))
    none = F.lit(0)
    rows = (
        _segmented(clauses, F.col("place"), REACH)
        .select(*as_rows, F.lit(TARGET).cast("tinyint").alias("kind"), sentence_id.alias("id"), "sub", "k", "place", _hashed(clauses).alias("tokens"), F.array().cast("array<int>").alias("times"))
        .unionByName(
            _segmented(source, F.col("place"), 2 * REACH + 1)
            .select(*as_rows, F.lit(SOURCE).cast("tinyint").alias("kind"), F.col("line").alias("id"), none.alias("sub"), none.alias("k"), "place", _hashed(tokens).alias("tokens"), "times")
        )
    )
    groups = max(width(spark), -(-count // GROUP))
    held = cut(rows.withColumn("segment", F.xxhash64("text", "seg")).withColumn("grp", F.pmod("segment", F.lit(groups)).cast("int")).repartition(groups, "grp"))
    # columns of its own, which the two sides of a cogroup must have
    words = cut(held.select(F.col("grp").alias("grp"), F.col("kind").alias("kind"), F.explode("tokens").alias("key")).distinct())
    near = held.filter(f"kind = {SOURCE} or core").select("grp", "segment", "seg", "kind", "place", "tokens").groupBy("grp")
    counts, packed = "kind tinyint, key bigint, e array<bigint>, c array<float>", "kind tinyint, key bigint, e array<bigint>, c array<double>, p array<float>"

    table, totals = None, (None, None)
    for _ in range(rounds):
        if table is None:
            given = words.limit(0).select("grp", "kind", "key", *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("e", "bigint"), ("c", "double"), ("p", "float"))])
        else:
            # of a source word's row the probabilities travel, of a target word's the counts
            counted = F.when(F.col("kind") == TARGET, F.col("c")).otherwise(F.array().cast("array<double>")).alias("c")
            given = words.join(table.select("kind", "key", "e", "p", counted), ["kind", "key"]).select("grp", "kind", "key", "e", "c", "p")
        expected = near.cogroup(given.groupBy("grp")).applyInArrow(_expect(totals[0]), counts)
        table = cut(expected.groupBy(F.pmod("key", F.lit(groups)).alias("bucket")).applyInArrow(_maximize, packed))
        totals = table.filter(f"kind = {TARGET}").agg(F.sum(F.col("c")[0]), F.sum(F.col("c")[1])).first()

    pairs = table.filter(f"kind = {SOURCE}").select(F.col("key").alias("f"), F.explode(F.arrays_zip("e", "p", "c")).alias("x")).select("f", "x.e", "x.p", "x.c")
    strongest = pairs.groupBy("e").agg(F.max("c").alias("most"))
    rarity = F.log(F.lit(float(max(1, count))) / F.col("c")[2])
    said = F.col("c")[1]
    stats = table.filter(f"kind = {TARGET}").select(F.col("key").alias("e"), rarity.alias("rarity"), said.alias("n"), (said / max(1.0, totals[1] or 1.0)).alias("share")).join(strongest, "e", "left")
    stats = cut(stats.select("e", "rarity", "share", F.when(F.col("most") >= CONCENTRATION * F.col("n"), F.col("rarity")).alias("idf")))
    useful = pairs.filter("p > 0.03 and c >= 2").join(stats, "e").withColumn("s", 1 - 3 * F.col("share") / F.col("p")).filter("s > 0.2")
    weight = F.sum(F.when(F.col("idf").isNotNull(), F.col("p") * F.col("idf"))) / F.sum(F.when(F.col("idf").isNotNull(), F.col("p")))
    known = useful.groupBy(F.col("f").alias("key")).agg(F.array_sort(F.collect_list(F.struct("e", "s"))).alias("all"), F.coalesce(weight, F.lit(UNKNOWN)).alias("x"))
    known = known.select(F.lit(SOURCE).cast("tinyint").alias("kind"), "key", F.col("all.e").alias("e"), F.col("all.s").alias("s"), "x", F.lit(0.0).alias("y"))
    nothing = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("e", "bigint"), ("s", "double"))]
    own = stats.select(F.lit(TARGET).cast("tinyint").alias("kind"), F.col("e").alias("key"), *nothing, F.coalesce("idf", F.lit(0.0)).alias("x"), F.col("rarity").alias("y"))
    given = words.join(known.unionByName(own), ["kind", "key"]).select("grp", "kind", "key", "e", "s", "x", "y")
    answer = "what tinyint, text string, line string, sentence string, sub int, k int, score double, place double, said double, least double, words array<bigint>, values array<double>, slots array<int>, rare array<bigint>, weights array<double>, times array<int>"
    first = cut(held.groupBy("grp").cogroup(given.groupBy("grp")).applyInArrow(_link, answer))

    links = first.filter(F.col("what") <= LOOSE).select("what", "text", "line", "sentence", "sub", "score")
    # a line near the edge of a segment may be taken by clauses of two segments: the better one keeps it
    rank = F.struct(-F.col("score"), "sentence", "sub")
    best = links.filter(F.col("what") == DIRECT).groupBy("text", "line").agg(F.min(rank).alias("best"))
    firm = links.filter(F.col("what") < LOOSE).join(best, ["text", "line"], "left")
    firm = cut(firm.filter((F.col("what") == SPLIT) | (rank == F.col("best"))).select("text", "line", "sentence", "sub"))
    far = cut(_second_pass(first, firm))
    # a link of little weight gives way to what the words say
    clause, line = ["text", "sentence", "sub"], ["text", "line"]
    loose = links.filter(F.col("what") == LOOSE).select("text", "line", "sentence", "sub")
    strong = firm.unionByName(far)
    loose = loose.join(strong.select(*clause), clause, "left_anti").join(strong.select(*line), line, "left_anti")
    parts = F.split("sentence", "\u0001")
    return strong.unionByName(loose).select("text", "line", parts[0].alias("para"), parts[1].cast("int").alias("sent")).distinct()
