"""Full-text search: an inverted index with positions, boolean, phrase and prefix queries, ranked by BM25.

The index is a table of postings (term, doc, tf, positions) and a table of document lengths; both are plain DataFrames
that can be written to Parquet (sorted by term, so a query reads few row groups). A query is parsed on the driver into a
tree; its leaves become filters on ``term`` and its nodes semi, anti and union steps on document ids, so Catalyst plans
the rest. Only postings of the query's own terms are ever joined.

Ranking: k1 = 1.2, b = 0.75, idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6, summed over the phrases of the query that
are not under NOT; larger is better. Ties go to the smaller document id. The phrases of a NEAR group count wherever they
stand in a matching document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellgrid.functions.stem import fts_stems, fts_tokens, fts_words
from tellgrid.session import ship

K1, B = 1.2, 0.75


class QuerySyntaxError(ValueError):
    """A query that cannot be read: empty, a bare operator, an open quotation, an unquoted hyphen or other sign."""


@dataclass
class Phrase:
    terms: list[str]
    prefix: bool = False
    first: bool = False  # must stand at the start of the text
    near: int | None = None  # with ``group``: all phrases within so many tokens
    group: list[Phrase] = field(default_factory=list)


@dataclass
class Node:
    kind: str  # phrase, and, or, not, near
    left: Node | Phrase
    right: Node | None = None


_LEX = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<sign>[()*+^,:])|(?P<word>[^\s"()*+^,:]+))')


class _Parser:
    """Recursive descent: OR binds least, then AND (also implicit), then NOT (between two operands)."""

    def __init__(self, query: str, stemmed: bool) -> None:
        self.stemmed, self.items, at = stemmed, [], 0
        text = query.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise QuerySyntaxError(f"cannot read the query at {text[at:]!r}")
            kind = m.lastgroup
            value = m.group(kind)
            if kind == "word" and not re.fullmatch(r"[^\W]+", value) and any(c.isascii() and not (c.isalnum() or c == "_") for c in value):
                raise QuerySyntaxError(f"put {value!r} in double quotes")
            self.items.append((kind, value))
            at = m.end()
        if not self.items:
            raise QuerySyntaxError("the query is empty")
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        item = self.peek()
        self.at += 1
        return item

    def parse(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise QuerySyntaxError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.peek() == ("word", "OR"):
            self.take()
            node = Node("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.without()
        while self.peek()[0] != "end" and self.peek() not in (("word", "OR"), ("sign", ")")):
            if self.peek() == ("word", "AND"):
                self.take()
            node = Node("and", node, self.without())
        return node

    def without(self) -> Node:
        node = self.operand()
        while self.peek() == ("word", "NOT"):
            self.take()
            node = Node("not", node, self.operand())
        return node

    def operand(self) -> Node:
        kind, value = self.peek()
        if (kind, value) == ("sign", "("):
            self.take()
            node = self.either()
            if self.take() != ("sign", ")"):
                raise QuerySyntaxError("a bracket is not closed")
            return node
        if kind == "word" and value == "NEAR" and self.at + 1 < len(self.items) and self.items[self.at + 1] == ("sign", "("):
            return self.near()
        return Node("phrase", self.phrase())

    def near(self) -> Node:
        self.at += 2
        phrases, within = [], 10
        while self.peek() not in (("sign", ")"), ("sign", ","), ("end", "")):
            phrases.append(self.phrase())
        if self.peek() == ("sign", ","):
            self.take()
            kind, value = self.take()
            if not value.isdigit():
                raise QuerySyntaxError("NEAR needs a number")
            within = int(value)
        if self.take() != ("sign", ")") or not phrases:
            raise QuerySyntaxError("NEAR is not closed")
        return Node("phrase", phrases[0]) if len(phrases) == 1 else Node("near", Phrase([], near=within, group=phrases))

    def phrase(self) -> Phrase:
        first = False
        if self.peek() == ("sign", "^"):
            self.take()
            first = True
        terms: list[str] = []
        while True:
            kind, value = self.take()
            if kind not in ("word", "quoted") or (kind == "word" and value in ("AND", "OR", "NOT")):
                raise QuerySyntaxError(f"a word or phrase is missing before {value!r}" if value else "the query breaks off")
            if self.peek() == ("sign", ":"):
                raise QuerySyntaxError(f"there is no column {value!r}")
            text = value[1:-1].replace('""', '"') if kind == "quoted" else value
            terms += fts_tokens(text, self.stemmed)
            if self.peek() != ("sign", "+"):
                break
            self.take()
        prefix = False
        if self.peek() == ("sign", "*"):
            self.take()
            prefix = True
        return Phrase(terms, prefix, first)


def parse(query: str, stemmed: bool = False) -> Node:
    return _Parser(query, stemmed).parse()


@dataclass
class Index:
    """Postings (term, doc, tf, positions) and lengths (doc, length) of a text column."""

    postings: DataFrame
    lengths: DataFrame
    stemmed: bool = False

    def write(self, path: str) -> None:
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").option(
            "parquet.bloom.filter.enabled#term", "true"
        ).parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def read(cls, spark, path: str, stemmed: bool = False) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), stemmed)


def build_index(df: DataFrame, doc: str, text: str, stemmed: bool = False) -> Index:
    """Index of the rows whose text is not null; ``doc`` must be unique. An empty text is a document of length 0."""
    ship(df.sparkSession)
    tokenize = fts_stems if stemmed else fts_words
    docs = df.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), tokenize(F.col(text)).alias("_t"))
    lengths = docs.select("doc", F.size("_t").cast("bigint").alias("length"))
    each = docs.select("doc", F.posexplode("_t").alias("at", "term"))
    postings = each.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))
    return Index(postings, lengths, stemmed)


def _shifted(column: str, by: int) -> Column:
    return F.transform(column, lambda p: p - by)


def _close(column: str, a: Column, before: int, after: int, within: int) -> Column:
    """Some start in ``column`` is within so many tokens of a phrase of ``before`` tokens that starts at ``a``."""
    return F.exists(column, lambda b: F.greatest(b - a - before, a - b - after) <= within)


def _phrase_hits(index: Index, phrase: Phrase) -> DataFrame:
    """doc, tf, starts, span of the documents that hold the phrase."""
    if not phrase.terms:
        return index.postings.filter(F.lit(False)).select("doc", "tf", F.col("positions").alias("starts"))
    parts: list[DataFrame] = []
    for i, term in enumerate(phrase.terms):
        last = phrase.prefix and i == len(phrase.terms) - 1
        test: Column = F.col("term").startswith(term) if last else F.col("term") == term
        found = index.postings.filter(test).select("doc", _shifted("positions", i).alias(f"_p{i}"))
        if last:  # several terms may share the prefix
            found = found.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list(f"_p{i}"))).alias(f"_p{i}"))
        parts.append(found)
    joined = reduce(lambda a, b: a.join(b, "doc"), parts)
    starts = reduce(lambda a, b: F.array_intersect(a, b), [F.col(f"_p{i}") for i in range(1, len(parts))], F.col("_p0"))
    if phrase.first:
        starts = F.filter(starts, lambda p: p == 0)
    hits = joined.select("doc", starts.alias("starts")).filter(F.size("starts") > 0)
    return hits.select("doc", F.size("starts").cast("bigint").alias("tf"), "starts")


def _near_hits(index: Index, group: Phrase) -> tuple[DataFrame, list[DataFrame]]:
    """Documents where all phrases of the group come within its distance, and each phrase's own hits there."""
    hits = [_phrase_hits(index, p) for p in group.group]
    joined = reduce(lambda a, b: a.join(b, "doc"), [h.select("doc", F.col("starts").alias(f"_s{i}")) for i, h in enumerate(hits)])
    sizes = [len(p.terms) for p in group.group]
    # some start of the first phrase has every other phrase near enough
    ok = F.exists("_s0", lambda a: reduce(lambda x, y: x & y, [_close(f"_s{i}", a, sizes[0], sizes[i], group.near) for i in range(1, len(hits))]))
    docs = joined.filter(ok).select("doc")
    return docs, [h.join(docs, "doc", "left_semi") for h in hits]


def _evaluate(index: Index, node: Node) -> tuple[DataFrame, list[DataFrame]]:
    """Matching documents and the hits of each phrase that ranks them."""
    if node.kind == "phrase":
        hits = _phrase_hits(index, node.left)
        return hits.select("doc"), [hits]
    if node.kind == "near":
        return _near_hits(index, node.left)
    left, left_hits = _evaluate(index, node.left)
    right, right_hits = _evaluate(index, node.right)
    if node.kind == "and":
        return left.join(right, "doc", "left_semi"), left_hits + right_hits
    if node.kind == "or":
        return left.union(right).distinct(), left_hits + right_hits
    return left.join(right, "doc", "left_anti"), left_hits


def search(index: Index, query: str) -> DataFrame:
    """doc, score of every matching document; order by score descending, then doc. No job runs while this is planned."""
    ship(index.postings.sparkSession)
    docs, phrases = _evaluate(index, parse(query, index.stemmed))
    hits = reduce(DataFrame.unionByName, [h.select(F.lit(i).alias("phrase"), "doc", "tf") for i, h in enumerate(phrases)])
    total, mean = index.lengths.agg(F.count(F.lit(1))).scalar(), index.lengths.agg(F.avg("length")).scalar()
    found = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("found")).withColumn("n", total).withColumn("mean", mean)
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("found") + 0.5) / (F.col("found") + 0.5)))
    # a row per phrase of the query
    found = F.broadcast(found.select("phrase", idf.alias("idf"), "mean"))
    length = F.col("length") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    summed = hits.join(index.lengths, "doc").join(found, "phrase").groupBy("doc").agg(F.sum(score).alias("score"))
    return docs.join(summed, "doc", "left").select("doc", F.coalesce("score", F.lit(0.0)).alias("score"))
