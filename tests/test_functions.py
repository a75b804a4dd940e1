"""Golden values of the text, collation, morphology and rendering functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tellgrid.functions import collate, morph, refs, render, text
from tellgrid.functions.register import register
from tellgrid.functions.stem import porter, words


@pytest.fixture
def values(spark):
    def run(expression, *given):
        df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, x string")
        return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def test_spellings(values):
    assert values(text.normalize_translit, "gal-ce3", "ju10", "a105-b2", "12", "2a", None) == ["gal-še₃", "ŋu₁₀", "a₁₀₅-b₂", "12", "2a", None]
    # only digits right behind a letter are index digits, however many there are
    assert values(text.normalize_translit, "a₂3", "gal12345678901234", "3a4b 5", "a-3", "") == ["a₂3", "ŋal₁₂₃₄₅₆₇₈₉₀₁₂₃₄".replace("ŋ", "g"), "3a₄b 5", "a-3", ""]
    assert values(text.normalize_query, " a2", "szu", "s,a t,a j'", None) == ["a₂", "šu", "ṣa ṭa ŋʾ", None]
    assert values(text.strip_subscripts, "e₂-gal₁₀", None) == ["e-gal", None]
    assert values(text.digits_to_subscripts, "SAR2") == ["SAR₂"]
    assert values(text.casefold, "Straße", "ŠÀ", None) == ["strasse", "šà", None]
    assert values(text.tokens, "{d}en-ki  [lugal] x", "  ", None) == [["en-ki", "lugal", "x"], [], None]
    assert values(lambda x: text.tokens(x, True), "x lugal X") == [["lugal"]]
    assert values(text.pieces, "e₂-gal.la", "a") == [["e₂", "gal", "la"], ["a"]]


def test_labels_and_ids(values):
    assert values(lambda x: text.line_label(x, F.lit("7")), "c141.1", "c24216.A.5", "zz", None) == ["1", "A.5", "7", "7"]
    assert values(lambda x: text.line_label(x, F.lit("")), "zz") == ["?"]
    assert values(text.format_p_id, "347", " 1234567 ", "", "x1", None) == ["P000347", "P1234567", None, None, None]
    assert values(text.normalize_p_id, "PP347", "p1234567", "Q1", None) == ["P000347", "P1234567", None, None]
    assert values(text.leading_number, "1-7", "B.1-5", "", None) == [1, None, None, None]
    assert values(text.has_scan, " ", "600ppi", None) == [0, 1, 0]
    assert values(text.blank_to_null, "\t a ", " ", None) == ["a", None, None]
    ref = values(refs.parse_word_ref, "a/b:P1.10.3", "p:T.1", "nothing", "p:.1.2", "p:T", None)
    assert [tuple(r) if r else None for r in ref] == [("a/b", "P1", "10", "3"), ("p", "T", "1", None), None, None, None, None]
    strict = values(refs.strict_word_ref, "p:T.1.2.3", "p:T.1", ":T.1")
    assert [bool(r) for r in strict] == [False, True, False]


def test_markup(values):
    assert values(text.expand_entities, "&d;en &jic; &zz; &eacute;", None) == ["{d}en {ŋeš} &zz; é", None]
    assert values(text.strip_markup, "<p>a <b>b</b>\n c</p>", None) == ["a b c", None]
    assert values(text.html_unescape, "&#x2014;", None) == ["—", None]


def test_like(values):
    assert values(lambda x: text.contains_like(x, "a_c"), "abc", "a_c", "ac") == [True, True, False]
    assert values(lambda x: text.contains_like(x, "a\\"), "a\\b", "ab") == [True, False]
    assert values(lambda x: text.contains_ascii_ci(x, "UR Š"), "ur Š", "UR š", None) == [True, False, None]


def test_collation(values):
    given = ["A.AL", "a aŋ", "ab", "aaba", "A.A", "a"]
    keys = dict(zip(given, values(collate.sort_key, *given)))
    assert sorted(given, key=keys.get) == ["a", "a aŋ", "aaba", "ab", "A.A", "A.AL"]
    assert values(collate.first_letter, "ŋa", "", "fa", None) == ["Ŋ", "?", "?", "?"]


def test_morphology(values):
    peeled = values(morph.peel_suffixes, "lugal-e", "e₂-a-ni-še₃", "x-bi-ne-ne", "ama", "lugal-ene", None)
    assert [(p.base, [s.role for s in p.suffixes]) if p else None for p in peeled] == [
        ("lugal", ["ergative"]),
        ("e₂", ["locative", "3sg_h_possessive", "terminative"]),
        ("x", ["3sg_nh_possessive_or_anaphoric", "3pl_h_possessive"]),
        ("ama", []),
        ("lugal", ["plural"]),
        None,
    ]
    case = lambda x: morph.outermost_case(morph.peel_suffixes(x)["suffixes"])
    assert values(case, "lugal-e", "e₂-ŋu₁₀", "e₂-a-ni-še₃") == ["ergative", None, "terminative"]
    assert values(morph.verbal_prefixes, "mu-na-du₃", "mu-un-du₃", "lugal-e", "mu", None) == ["mu-na", "mu", None, None, None]
    slots = values(morph.morph_slots, "mu.na.n:~;a", "~", "~;a", "~mu.n:~;en", "~,bi.a", None)
    assert [(s.pre, s.suf) if s else None for s in slots] == [(["mu", "na", "n"], ["a"]), ([], []), ([], ["a"]), (["~mu", "n"], ["en"]), ([], ["bi.a"]), None]
    assert values(lambda x: morph.synthesize(x, F.lit("du₃")), "mu.na:~", "mu.n:~", "~~") == ["mu-na-du₃", "mu-n-du₃", "du₃-du₃"]


def test_features(values):
    match = lambda **k: (lambda x: morph.matches_features(x, **k))
    assert values(match(), "nu.mu:~", "~", None) == [True, True, False]  # affirm without a prefix keeps nu
    assert values(match(polarity="neg"), "nu.mu:~", "mu:~", "~") == [True, False, False]
    assert values(match(prefix="imp"), "~", "mu:~") == [True, False]
    assert values(match(prefix="imp", dimensional=["dat"]), "~") == [False]
    given = ("mu.na.n:~", "mu.n.na:~", "mu.ni.na.n:~", "mu.na.ni:~", "ba.na.n:~")
    assert values(match(prefix="mu", dimensional=["dat"], object_person="3sg.h"), *given) == [True, False, True, False, False]
    assert values(match(dimensional=["loc", "dat"]), "mu.na.ni:~", "mu.ni.na:~") == [True, False]


def test_skeleton(spark):
    rows = [([("[NP lugal-ERG]", False), ("gal", True), ("[V du]", False)],), ([("gal", True)],), ([],)]
    df = spark.createDataFrame(rows, "c array<struct<text:string,adjective:boolean>>")
    assert [r.s for r in df.select(morph.skeleton(F.col("c")).alias("s")).collect()] == ["[NP lugal-ERG +ADJ:gal] [V du]", "[ADJ gal]", "(empty input)"]


def test_rendering(values, spark):
    signs = spark.createDataFrame(
        [("LUGAL", "𒈗", ["lugal"], 0), ("LU₂", "𒇽", ["lu₂"], 1), ("GAL", "𒃲", ["gal"], 2), ("AN", "𒀭", ["d", "an"], 3), ("HU", "𒄷", ["mušen"], 4), ("X2", "?", ["lugal"], 5), ("NO", None, ["no"], 6)],
        "sign_name string, utf8 string, values array<string>, position int",
    )
    glyphs = render.sign_dictionary(signs)
    assert glyphs["lugal"] == "𒈗" and "no" not in glyphs
    shown = values(lambda x: render.cuneify(x, glyphs), "lugal", "lu₂-gal", "{d}lugal", "lugal{mušen}", "foo", "lu₂{d", None, "muₓ(GAL)", "lugal!", "x lugal\\l")
    assert shown == ["𒈗", "𒇽𒃲", "𒀭𒈗", "𒈗𒄷", "□", "𒇽□", "", "𒃲", "𒈗", "□ 𒈗"]
    assert values(lambda x: render.placeholder_count(render.cuneify(x, glyphs)), "foo-lugal-bar") == [2]


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi", "generalizations": "gener", "kingship": "kingship", "sky": "sky"}
    assert {w: porter(w) for w in pairs} == pairs
    assert words("{d}En-ki lu₂ ŠEŠ ŋa") == ["d", "en", "ki", "lu₂", "ses", unicodedata.normalize("NFC", "ŋa")]
    assert words(None) == []


def test_sql_names(spark):
    assert "casefold" in register(spark, {"lugal": "𒈗"})
    row = spark.sql("select casefold('ẞ') a, porter('kings') b, cuneify('lugal') c, fts_words('A-b') d").first()
    assert tuple(row) == ("ss", "king", "𒈗", ["a", "b"])
    row = spark.sql("select strip_subscripts('e₂-gal₁₀') a, digits_to_subscripts('a12') b, ascii_lower('ÀAB') c, blank_to_null('  ') d, blank_to_null(' x ') e, format_p_id(' 347 ') f, format_p_id('x1') g, leading_number('12-14') h").first()
    assert tuple(row) == ("e-gal", "a₁₂", "Àab", None, "x", "P000347", None, 12)
    shown = spark.createDataFrame([("lugal-lugal",), ("lugal-foo",), ("",)], "x string").select(render.cuneified(F.col("x"), {"lugal": "𒈗"}).alias("c"))
    assert [tuple(r.c) for r in shown.collect()] == [("𒈗𒈗", 0, True), ("𒈗□", 1, False), ("", 0, False)]
