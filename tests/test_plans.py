"""Plans on small tables, against what is worked out by hand."""

import os

import pytest

from tellgrid.plans import corpus as texts
from tellgrid.plans import lexicon
from tellgrid.plans.tables import Corpus


@pytest.fixture(scope="module")
def corpus(spark):
    make = spark.createDataFrame
    entries = make(
        [("o1", "lugal", "lugal", "king", "N", 49942, "x1"), ("o2", "egal", "egal", "palace", "N", 900, None), ("o3", "du", "du", "build", "V/t", 500, None),
         ("o4", "gal", "gal", "big", "AJ", None, None), ("o5", "lugal gal", "lugal gal", "great king", "N", 10, None), ("o6", "a", "a", "water", None, 700, None),
         ("o7", "gin", "za-gin₃", "lapis", "N", 50, None)],
        "id string, headword string, cf string, gw string, pos string, icount long, xis string",
    )
    forms = make(
        [("f1", "o1", "lugal-e", 60), ("f2", "o2", "e₂-gal", 80), ("f3", "o2", "egal", None), ("f4", "o3", "mu-na-du₃", 30), ("f5", "o4", "gal", 5), ("f6", "o1", "lugal", 90)],
        "id string, entry_id string, n string, icount long",
    ).selectExpr("*", "1 as ipct", "'' as xis")
    senses = make([("s1", "o1", "king", 49818), ("s2", "o1", "kingly", None), ("s3", "o2", "house of a king", 5)], "id string, entry_id string, mng string, icount long").selectExpr("*", "100 as ipct")
    morphology = make(
        [("o3", "base", "du₃", 400), ("o3", "morph", "mu.na:~", 473), ("o3", "morph", "mu.n:~;a", 56), ("o3", "morph", "nu.mu:~", 3), ("o3", "morph", "~;e", None), ("o6", "form-sans", "a", 2)],
        "entry_id string, kind string, n string, icount long",
    )
    grams = make(
        [(2, "lugal egal", "lugal", "egal", None, None, 9), (3, "lugal egal du", "lugal", "egal", "du", None, None), (2, "a du", "a", "du", None, None, 4)],
        "n int, ngram string, cf1 string, cf2 string, cf3 string, cf4 string, count long",
    )
    return Corpus({
        "entries": entries, "forms": forms, "senses": senses, "morphology": morphology, "collocations": grams, "unigrams": make([("lugal", 9)], "cf string, count long"),
        "periods": make([("o1", 1, "Ur III", 3, 5)], "entry_id string, ord int, p string, icount long, ipct int"),
        "compounds": make([("o1", "lugal gal", "o5")], "entry_id string, xcpd string, eref string"),
        "instances": make([("x1", "p:P99.1.1"), ("x1", "p:P1.10.1"), ("x1", "p:P1.10.2"), ("x1", "p:P2.1.1"), ("x1", "bad")], "xis string, word_ref string"),
        "text_locations": make([("p", "P1", "Ur III", "T 1"), ("p", "P2", "Old Ur", None), ("p", "P99", None, None)], "project string, text_id string, period string, designation string"),
        "artifacts": make([("P1", "BM", "1")], "p_id string, museum_collection string, museum_no string"),
    })


def test_by_meaning(corpus):
    found = lexicon.by_meaning(corpus, " King ").orderBy(*lexicon.meaning_order())
    assert [(r.oid, r.sense, r.sense_count, r.sense_pct) for r in found.collect()] == [("o1", "king", 49818, 100), ("o5", "great king", 10, 100), ("o2", "house of a king", 5, 100)]


def test_compounds(corpus):
    found = {(r.oid, r.branch, r.spelling) for r in lexicon.compounds_of(corpus, "a").collect()}
    assert ("o2", "B", "e₂-gal") in found and not any(oid == "o1" for oid, *_ in found)  # lugal-e begins with the word itself
    assert ("o5", "A", None) in {(r.oid, r.branch, r.spelling) for r in lexicon.compounds_of(corpus, "king").collect()}


def test_profiles(corpus):
    row = lexicon.entry_profiles(corpus, ["o1"]).first()
    assert [s.mng for s in row.senses] == ["king", "kingly"] and [s.n for s in row.spellings] == ["lugal", "lugal-e"]
    assert [p.p for p in row.periods] == ["Ur III"] and [c.eref for c in row.compounds] == ["o5"]
    assert lexicon.entry_profiles(corpus).count() == 7


def test_inflections(corpus):
    rows = {(r.kind, r.n): (r["count"], r["rank"], r.total) for r in lexicon.inflections(corpus, 0, 2).collect() if r.entry_id == "o3"}
    assert rows == {("base", "du₃"): (400, 1, 1), ("morph", "mu.na:~"): (473, 1, 4), ("morph", "mu.n:~;a"): (56, 2, 4)}


def test_glosses(corpus, spark):
    lines = spark.createDataFrame([(1, "lugal-e x {d}e₂-gal foo lugal-foo")], "id int, t string")
    rows = lexicon.gloss_tokens(corpus, lines, ["id"], "t").orderBy("position", "part", "rank").collect()
    assert [(r.token, r.match_kind, r.from_word, r.cf) for r in rows] == [
        ("lugal-e", "whole", None, "lugal"), ("e₂-gal", "whole", None, "egal"), ("foo", "unmatched", None, None),
        ("lugal", "split_fallback", "lugal-foo", "lugal"), ("foo", "split_fallback", "lugal-foo", None),
    ]


def test_gloss_parts(corpus, spark):
    """Parts of a split word are cleaned; a word of which one part is left is unmatched; whole words show their suffix chain."""
    lines = spark.createDataFrame([(1, "qqq-x-[zz] ⸢qqq⸣-{d}x lugal-e")], "id int, t string")
    rows = lexicon.gloss_tokens(corpus, lines, ["id"], "t").orderBy("position", "part").collect()
    assert [(r.token, r.match_kind) for r in rows] == [("qqq", "split_fallback"), ("zz", "split_fallback"), ("qqq⸣-x", "unmatched"), ("lugal-e", "whole")]
    assert rows[3].base == "lugal" and [x.role for x in rows[3].suffixes] == ["ergative"] and rows[0].base is None


def test_analysis_total(corpus, spark):
    asked = spark.createDataFrame([("LUGAL",), ("a",), ("zz",)], "s string")
    rows = {(r.spelling, r.matched_in): r.total for r in lexicon.analyze(corpus, asked, "s").collect()}
    assert rows == {("LUGAL", "forms"): 1, ("a", "morphology.form-sans"): 1}


def test_glossary_page(corpus):
    page = lexicon.glossary_page(corpus, lexicon.with_collation(corpus["entries"]), 99, 3)
    rows = page.orderBy("id").collect()
    assert {(r.total, r.pages, r.page) for r in rows} == {(7, 3, 3)} and len(rows) == 1
    first = lexicon.glossary_page(corpus, lexicon.entries_under(corpus, "L"), 1).orderBy("id").collect()
    assert [(r.id, r.spellings, r.senses, r.periods) for r in first] == [("o1", ["lugal", "lugal-e"], ["king", "kingly"], ["Ur III"]), ("o5", None, None, None)]


def test_entry_detail(corpus, spark):
    more = Corpus(corpus.tables | {
        "norms": spark.createDataFrame([("o1", "lugale", 3, 1), ("o1", "lugal", 9, 2)], "entry_id string, n string, icount long, ipct int"),
        "sense_sigs": spark.createDataFrame([("s1", "lugal[king//king]N", 5), ("s1", "other", None), ("s3", "not here", 1)], "sense_id string, sig string, icount long"),
    })
    row = lexicon.entry_detail(more, "o1").first()
    assert [n.n for n in row.norms] == ["lugal", "lugale"] and row.attestations == 5
    assert {k: [x.sig for x in v] for k, v in row.sense_sigs.items()} == {"s1": ["lugal[king//king]N", "other"]}
    assert lexicon.entry_detail(more, "o3").first().attestations == 0 and lexicon.entry_detail(more, "none").count() == 0


def test_references_back_and_unresolved(corpus, spark):
    refs = spark.createDataFrame([("p:P1.10.1",), ("p:P9.9.9",), (None,)], "r string")
    assert [(r.word_ref, r.oid) for r in lexicon.entries_of_refs(corpus, refs, "r").collect()] == [("p:P1.10.1", "o1")]
    assert texts.unresolved(corpus).count() == 0
    lost = Corpus(corpus.tables | {"text_locations": corpus["text_locations"].limit(0)})
    assert [tuple(r) for r in texts.unresolved(lost).collect()] == [("o1", 4, 4, 0, "p (4)")]


def test_examples(corpus, spark):
    words = [("p", "P1", "10", 1, "lugal-e", "P1.10.1"), ("p", "P1", "10", 2, "e₂", "P1.10.2"), ("p", "P2", "1", 1, "x", None)]
    more = Corpus(corpus.tables | {
        "corpus_words": spark.createDataFrame(words, "project string, text_id string, line string, position int, frag string, ref string"),
        "artifacts": spark.createDataFrame([("P1", "BM", "1", 7, 1, 0)], "p_id string, museum_collection string, museum_no string, cdli_id long, has_photo int, has_lineart int"),
    })
    rows = texts.examples(more, 2, base="http://c.test", citations=("D", "C")).orderBy("rank").collect()
    assert [(r.transliteration, r.target, r.target_position, r.photo_url) for r in rows] == [("lugal-e e₂", "lugal-e", 0, "http://c.test/dl/photo/P1.jpg"), ("x", None, None, None)]
    assert rows[0].markdown == "> lugal-e e₂\n> — [P1](http://c.test/artifacts/7) 10 · T 1 · Ur III · BM · 1\n<sub>— line & lemma: D; tablet metadata: C</sub>"
    assert rows[1].markdown == "> x\n> — P2 1 · Old Ur\n<sub>— line & lemma: D</sub>"


def test_forms_with_examples_and_glyphs(corpus, spark):
    more = Corpus(corpus.tables | {
        "morphology": spark.createDataFrame([("o3", "base", "du₃", 400, None), ("o3", "morph", "mu.na:~", 473, "x1")], "entry_id string, kind string, n string, icount long, xis string"),
        "corpus_words": spark.createDataFrame([("p", "P2", "1", 1, "mu-na-du₃", "P2.1.1")], "project string, text_id string, line string, position int, frag string, ref string"),
        "artifacts": spark.createDataFrame([("P1", "BM", "1", 7, 1, 0)], "p_id string, museum_collection string, museum_no string, cdli_id long, has_photo int, has_lineart int"),
    })
    forms = lexicon.verb_forms(more, cf="du", glyphs={"mu": "M", "na": "N"})
    row = texts.form_examples(more, forms).first()
    assert (row.spelling, row.glyphs, row.forms_count) == ("mu-na-du₃", "MN□", 30)
    assert (row.word_ref, row.transliteration, row.target, row.period) == ("p:P2.1.1", "mu-na-du₃", "mu-na-du₃", "Old Ur")
    assert [x.glyphs for x in lexicon.entry_profiles(more, ["o2"], glyphs={"e₂": "E", "gal": "G"}).first().spellings] == ["EG", "□"]


def test_search_with_documents(spark):
    make = spark.createDataFrame
    found = Corpus({
        "paragraphs": make([("t1", "p1", "1-2", "The king built a temple."), ("t1", "p2", "", "A king."), ("t2", "p1", None, None)], "text_id string, para_id string, line_range string, translation string"),
        "lines": make([("t1", "l1", 1, "1", "lugal-e", "p1"), ("t1", "l2", 2, "2", "e₂ mu-du₃", "p1"), ("t2", "l1", 1, "1", "lugal", None)], "text_id string, line_id string, ord int, line_label string, transliteration string, paragraph_id string"),
        "texts": make([("t1", "A song")], "text_id string, title string"),
    })
    rows = texts.search_translations(found, "kings", 1, 0, source="S").collect()
    assert [(r.para_id, r.title, r.total, r.next_offset) for r in rows] == [("p2", "A song", 2, 1)]
    row = texts.search_translations(found, "temples", source="S").first()
    assert [x.transliteration for x in row.lines] == ["lugal-e", "e₂ mu-du₃"] and row.next_offset is None
    assert row.markdown == '> lugal-e\n> e₂ mu-du₃\n> "The king built a temple."\n> — A song (t1, line 1-2)\n<sub>— S</sub>'
    lines = {(r.text_id, r.line, r.title, r.translation) for r in texts.search_lines(found, "lugal").collect()}
    assert lines == {("t1", "1", "A song", "The king built a temple."), ("t2", "1", None, None)}


def test_gap_report(spark):
    rows = spark.createDataFrame([("a", True, 404, 200), ("b", False, 200, 200), ("c", False, 404, 200), ("d", None, None, 500)], "project string, local boolean, index_status int, alt_status int")
    assert [r.bucket for r in texts.gap_report(rows).orderBy("project").collect()] == ["have", "missing_indexed", "missing_alt_only", "missing_unreachable"]


def test_built_once_and_anew(spark, tmp_path):
    """A built corpus is written once; a changed file of the folder builds it anew."""
    from tellgrid.plans.tables import built

    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("test tables are missing")
    for name in os.listdir(source):
        (tmp_path / name).symlink_to(f"{source}/{name}")
    one = built(spark, str(tmp_path))
    assert built(spark, str(tmp_path)) is one and one["forms"] is one["forms"]
    assert "n_cf" in one["forms"].columns and lexicon.readings(one) is lexicon.readings(one)
    assert one.without("forms").tables.keys() == one.tables.keys() - {"forms"}
    (tmp_path / "period_list.parquet").unlink()
    assert built(spark, str(tmp_path)) is not one


def test_phrases(corpus, spark):
    lines = spark.createDataFrame([(1, "lugal-e gal egal mu-na-du₃"), (2, "za-gin₃-gin₇ bar"), (3, "[x]"), (4, " ")], "id int, t string")
    rows = {r.id: r for r in lexicon.parse_phrases(corpus, lines, ["id"], "t").collect()}
    assert rows[1].skeleton == "[NP lugal-ERG +ADJ:gal] [NP egal-ABS] [V du (mu-na-)]"
    assert rows[1].notes[0].startswith("ergative subject + absolutive object")
    assert any("'-e'" in n for n in rows[1].notes)
    assert rows[2].skeleton == "[NP za-gin₃-EQUATIVE] [? bar]" and any("equative" in n for n in rows[2].notes)
    assert rows[3].skeleton == "[? x]" and 4 not in rows
    assert [c.role for c in rows[1].chunks] == ["subject_ergative", "adjective_modifier", "noun_head_unmarked", "verb_head"]
    assert rows[1].chunks[3].verbal_prefixes == "mu-na" and rows[1].chunks[3].base == "du₃"


def test_verb_forms(corpus):
    rows = lexicon.verb_forms(corpus, cf="du", prefix="mu").collect()
    assert [(r.morph, r.spelling, r.verified_in_forms, r.share_pct) for r in rows] == [("mu.na:~", "mu-na-du₃", True, 94.6), ("mu.n:~;a", "mu-n-du₃-a", False, 11.2)]
    assert [r.morph for r in lexicon.verb_forms(corpus, cf="du", suffix_a=True).collect()] == ["mu.n:~;a"]
    assert len(lexicon.verb_forms(corpus, cf="du").collect()) == 3  # nu is not excluded, a null count is
    with pytest.raises(ValueError):
        lexicon.verb_forms(corpus, prefix="zu")


def test_attestations(corpus):
    rows = texts.attestations(corpus, 2).orderBy("rank").collect()
    assert [(r.word_ref, r.period, r.museum_no) for r in rows] == [("p:P1.10.1", "Ur III", "1"), ("p:P2.1.1", "Old Ur", None)]
    assert [r.word_ref for r in texts.attestations(corpus, 5, "ur").orderBy("rank").collect()] == ["p:P1.10.1", "p:P2.1.1"]
    assert texts.attestations(corpus, 5, "none of these").count() == 0


def test_collocations(corpus):
    assert {r.ngram for r in texts.collocations_of(corpus, "egal").collect()} == {"lugal egal", "lugal egal du"}
    assert {r.ngram for r in texts.collocations_of(corpus, "egal", 2).collect()} == {"lugal egal"}
    rows = texts.collocations_of(corpus, "E₂-gal").collect()  # a spelling is resolved to its citation forms
    assert {r.ngram for r in rows} == {"lugal egal", "lugal egal du"} and {r.resolved_from for r in rows} == {"E₂-gal"}
    assert texts.collocations_of(corpus, "zzz").count() == 0


def test_plain_pattern_annotation(corpus):
    rows = texts.phrase_pattern(corpus, ["N", "*"]).collect()
    assert [(r.ngram, r.tokens[0].gw, r.tokens[1].pos) for r in rows] == [("lugal egal", "king", "N")]


def test_search_entries(corpus):
    assert {r.id for r in lexicon.search_entries(corpus, "gal").collect()} == {"o1", "o2", "o4", "o5"}
