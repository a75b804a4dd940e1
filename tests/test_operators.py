"""Core operators against small tables, brute force and SQLite's full-text search."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tellgrid.operators import dedup, filters, fts, groups, ngrams, orphans, paging, pattern


def test_dedup(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), ("b", 5, "w"), (None, 1, "n")], "k string, o int, v string")
    assert sorted(r.v for r in dedup.first_wins(df, ["k"], ["o"]).collect()) == ["n", "y", "z"]
    assert sorted(r.v for r in dedup.last_wins(df, ["k"], ["o"]).collect()) == ["n", "w", "x"]
    assert dedup.first_wins(df.limit(0), ["k"], ["o"]).count() == 0


def test_pages_cover_everything(spark):
    df = spark.range(25)
    seen, offset = [], 0
    while offset is not None:
        rows, info = paging.page(df, [F.col("id").desc()], 10, offset)
        seen += [r.id for r in rows.collect()]
        offset = info.next_offset
    assert seen == list(range(24, -1, -1))
    assert paging.page(df, [F.col("id")], 999)[1].next_offset is None
    rows, following = paging.keyset_page(df, "id", 5, 10)
    assert [r.id for r in rows.collect()] == list(range(5, 15)) and following == 15
    assert paging.keyset_page(df, "id", 20, 10)[1] is None
    assert paging.numbered_page(df, [F.col("id")], 99)[1:] == (1, 1)


def test_groups(spark):
    df = spark.createDataFrame([("a", 3), ("a", None), ("a", 5), (None, 1), (None, 2)], "g string, v int")
    top = groups.top_per_group(df, ["g"], [F.col("v").desc_nulls_last()], 2)
    assert sorted((r.g or "", r.v, r["rank"], r.total) for r in top.collect()) == [("", 1, 2, 2), ("", 2, 1, 2), ("a", 3, 2, 3), ("a", 5, 1, 3)]
    assert groups.top_per_group(df, ["g"], [F.col("v")], 0).count() == 5
    runs = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, None), (2, 1, "a")], "t int, o int, p string")
    assert [r.island for r in groups.islands(runs, ["t"], ["o"], "p").orderBy("t", "o").collect()] == [1, 1, 2, 3, 1]
    shares = spark.createDataFrame([(1, 3), (1, 0), (1, None)], "a int, b int").select(groups.share(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in shares.collect()] == [33.33, 0.0, 0.0]


def test_ngrams_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(line, at, rng.choice(["a", "b", "c", None, ""])) for line in range(20) for at in range(rng.randint(0, 9))]
    df = spark.createDataFrame(rows, "line int, at int, w string")
    for n in (2, 3):
        want: dict[str, int] = {}
        for line in range(20):
            seq = [w for x, at, w in sorted(rows, key=lambda r: r[:2]) if x == line and w]
            for i in range(len(seq) - n + 1):
                key = " ".join(seq[i : i + n])
                want[key] = want.get(key, 0) + 1
        assert {r["ngram"]: r["count"] for r in ngrams.ngram_counts(df, ["line"], "at", "w", n).collect()} == want
        listed = ngrams.sequences(df, ["line"], "at", "w").select(F.explode(ngrams.array_ngrams("items", n)).alias("g")).groupBy(F.array_join("g", " ").alias("g")).count()
        assert {r["g"]: r["count"] for r in listed.collect()} == want


@pytest.mark.parametrize("slots,want", [
    (["lugal", "*"], {1, 2, 3}), (["lugal[king]", "*"], {1}), (["lugal[!king]", "*"], {2}), (["N:ergative", "*"], {1}), (["N:!ergative", "*"], {2, 3}),
    (["*:absolutive", "*"], {3}), (["*:!none", "*"], {1, 2, 4}), (["*", "V*"], {1, 4}), (["*", "V/t"], {1}), (["*", "v*"], {1, 4}),
])
def test_pattern_truth_table(spark, slots, want):
    rows = [
        (1, 2, "lugal", "du", "king", "build", "N", "V/t", "ergative", None), (2, 2, "lugal", "e", "owner", None, "N", None, "dative", None),
        (3, 2, "lugal", "e", None, None, "N", "N", None, None), (4, 2, "ŋen", "du", "go", "x", "V/i", "V/i", "locative", "ergative"),
        (5, 3, "lugal", "du", "king", None, "N", "V/t", "ergative", None),
    ]
    df = spark.createDataFrame(rows, "id int, n int, cf1 string, cf2 string, gw1 string, gw2 string, pos1 string, pos2 string, case1 string, case2 string")
    assert {r.id for r in pattern.match_pattern(df, slots).collect()} == want


def test_pattern_grammar():
    assert pattern.parse_slot("lugal[!king]:!ergative") == pattern.Slot("cf", "lugal", "king", True, "ergative", True)
    assert pattern.parse_slot("V*").kind == "family" and pattern.parse_slot("V/t").kind == "pos" and pattern.parse_slot("LUGAL").kind == "cf"
    for bad in ("", "a[b", "a:b:c", "[x]"):
        with pytest.raises(pattern.PatternError):
            pattern.parse_slot(bad)
    with pytest.raises(pattern.PatternError):
        pattern.parse_pattern(["a"])


def test_plain_pattern(spark):
    grams = spark.createDataFrame([(2, "a b", "a", "b"), (2, "b a", "b", "a")], "n int, ngram string, cf1 string, cf2 string")
    entries = spark.createDataFrame([("a", "N"), ("a", "V/t"), ("b", None)], "cf string, pos string")
    assert [r.ngram for r in pattern.match_pattern_plain(grams, entries, ["V*", "*"]).collect()] == ["a b"]
    with pytest.raises(pattern.PatternError):
        pattern.match_pattern_plain(grams, entries, ["a[x]", "b"])


def test_filters(spark):
    df = spark.createDataFrame([("Ur III", "Admin"), ("Old", "admin"), (None, "Admin")], "period string, genre string")
    assert filters.all_of(df, {"period": None, "genre": " "}).count() == 3
    assert filters.all_of(df, {"period": "ur", "genre": "ADM"}).count() == 1
    assert [r._name for r in filters.period_names(df, "period", "UR").collect()] == ["Ur III"]


@pytest.mark.parametrize("heavy,few", [(3, 0), (1000, 0), (3, 100_000), (1, 2)])
def test_orphans_by_brute_force(spark, heavy, few):
    rng = random.Random(2)
    refs = [(rng.choice([None, "hot", "cold", *map(str, range(30))]), rng.choice(["jan", None]), i) for i in range(400)]
    targets = [(rng.choice([None, "hot", *map(str, range(20))]),) for _ in range(40)]
    have = {t[0] for t in targets} - {None}
    r = spark.createDataFrame(refs, "key string, month string, _there int")  # an odd column name may clash
    r = r.withColumnRenamed("_there", "name")
    t = spark.createDataFrame(targets, "id string")
    lost = orphans.orphan_references(r, t, ["key"], ["id"], heavy_keys=heavy, few_keys=few)
    assert sorted(x.name for x in lost.collect()) == sorted(i for k, _, i in refs if k and k not in have)
    counts = orphans.orphan_counts(r, t.withColumnRenamed("id", "key"), ["key"], "month", heavy_keys=heavy)
    counted = {x.month: (x.refs, x.orphans) for x in counts.collect()}
    for month in ("jan", None):
        own = [k for k, m, _ in refs if m == month and k]
        assert counted[month] == (len(own), sum(k not in have for k in own))
    assert orphans.orphan_references(r.limit(0), t, ["key"], ["id"]).count() == 0
    assert orphans.orphan_references(r, t.limit(0), ["key"], ["id"]).count() == sum(k is not None for k, _, _ in refs)


QUERIES = [
    "king", "king temple", "king OR house", '"king temple"', "ho*", "kings NOT temple", "(king OR ses) AND house", '"en ki"', "^king", "temple + house",
    '"temple ho"*', "running OR relational", "king AND (house OR temple) NOT ses", "absent",
]


@pytest.mark.parametrize("stemmed", [False, True])
def test_full_text_against_sqlite(spark, stemmed):
    rng = random.Random(4)
    vocabulary = "king kings kingship šeš ses lu₂ lu2 temple temples relational running runs hopping house houses {d}en-ki generalizations".split()
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))) for i in range(80)] + [(500, None), (501, "")]
    con = sqlite3.connect(":memory:")
    try:
        con.execute(f"create virtual table t using fts5(x, tokenize='{'porter ' if stemmed else ''}unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    con.executemany("insert into t(rowid, x) values (?, ?)", [(i + 1, t) for i, t in docs if t is not None])
    index = fts.build_index(spark.createDataFrame(docs, "id long, x string"), "id", "x", stemmed)
    index.postings.cache()
    for query in QUERIES:
        want = dict(con.execute("select rowid - 1, -bm25(t) from t where t match ?", (query,)).fetchall())
        got = {r.doc: r.score for r in fts.search(index, query).collect()}
        assert set(got) == set(want), query
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want), query
    near = {r[0] for r in con.execute("select rowid - 1 from t where t match 'NEAR(king house, 2)'")}
    assert {r.doc for r in fts.search(index, "NEAR(king house, 2)").collect()} == near


@pytest.mark.parametrize("query", ["", "lugal-bi", "x AND NOT y", "f:a", "'a'", "AND", '"a', "(a", "a )", "NEAR(a b"])
def test_query_errors(query):
    with pytest.raises(fts.QuerySyntaxError):
        fts.parse(query)


def test_index_on_disk(spark, tmp_path):
    index = fts.build_index(spark.createDataFrame([(1, "a b"), (2, "b")], "id long, x string"), "id", "x")
    index.write(str(tmp_path))
    assert [r.doc for r in fts.search(fts.Index.read(spark, str(tmp_path)), "b NOT a").collect()] == [2]
