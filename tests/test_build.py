"""Ingest of small source files shaped like the real ones."""

import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tellgrid.plans import build
from tellgrid.plans.corpus import resolve_lines, signs_of
from tellgrid.plans.tables import Corpus
from tellgrid.sources.archives import JsonStream
from tellgrid.sources.catalogue import COLUMNS, CONSUMED, HeaderError, read_catalogue


def line(ref, *words):
    start = {"node": "d", "type": "line-start", "ref": ref, "label": f"o {ref.split('.')[1]}"}
    return [start, *[{"node": "l", "ref": f"{ref}.{i}", "frag": frag, "f": f} for i, (frag, f) in enumerate(words, 1)]]


LUGAL = ("lugal-e", {"lang": "sux", "cf": "lugal", "gw": "king", "pos": "N"})
EGAL = ("e₂-gal", {"lang": "sux", "cf": "egal", "gw": "palace", "pos": "N"})
AKK = ("šar-rum", {"lang": "akk", "cf": "šarrum", "gw": "king", "pos": "N"})
DU = ("mu-na-du₃", {"lang": "sux", "cf": "du", "gw": "", "pos": "V/t"})
DOC = {
    "cdl": [
        {"node": "c", "cdl": [{"node": "c", "cdl": line("P1.1", LUGAL, AKK, EGAL, DU)}]},
        *line("P1.10", LUGAL, EGAL, DU),
        {"node": "d", "ref": "P1.10.9", "frag": "(blank)"},
        *line("P1.2", LUGAL),
        {"node": "l", "ref": "P1.2.2", "frag": "x", "f": "none"},
        *line("P1.3", LUGAL, EGAL, DU),
    ]
}
GLOSSARY = {
    "type": {"nested": [1, {"entries": "no"}], "text": 'a "quoted" } one'},
    "entries": [
        {
            "id": "o1", "headword": "lugal[king]N", "cf": "lugal", "gw": "king", "pos": "N", "icount": "49942", "ipct": "100", "xis": "x1",
            "periods": [{"p": "Old", "icount": "5"}, "Bare", {"icount": "1"}], "see-compounds": [{"xcpd": "lugal gal", "eref": "o2"}, {"eref": "o9"}],
            "forms": [{"id": "f1", "n": "lugal-e", "icount": "7"}, {"id": "f2", "icount": ""}, {"n": "lost"}], "norms": None,
            "senses": [{"id": "s1", "mng": "king", "icount": "x", "sigs": [{"id": "g1", "icount": "3"}]}],
            "bases": [{"cbd_id": "b1", "n": "lugal"}, {"n": "no id"}, {"cbd_id": "b2"}], "morphs": [{"cbd_id": "m1", "n": "~", "icount": 4}],
        },
        {"headword": "no id"},
        {"id": "o1", "headword": "later", "forms": [{"id": "f3", "n": "lugal"}, {"id": "f1", "n": "again"}]},
    ],
    "instances": {"x1": ["p/q:P1.10.1", "p/q:P1.1.1", "p/q:P1.10.1"], "x2": []},
}
TEI = """<TEI><teiHeader><titleStmt><title>Song of &jic;&dame;</title></titleStmt></teiHeader><text><body>
<l id="c141.1" n="1" corresp="t141.p1"><w form="gal-ce3" lemma="gal" pos="AJ" label="big"/><w/><w form="&d;en-ki" lemma="en-ki" pos="DN"/></l>
<l id="c141.2" n="2"></l><l id="c141.1" n="1"><w form="ju10" lemma="ju"/></l><l id="c141.A.5" n="x" corresp="t141.p1"><w form="lugal" lemma="lugal"/></l>
</body></text></TEI>"""
TRANSLATION = '<TEI><body><p id="t141.p1" n="1-2">The <w type="DN">god</w>\n &#x2014; speaks.</p><p id="t141.p2" n="B.1-5">Again.</p><p n="3">none</p></body></TEI>'


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    with zipfile.ZipFile(root / "gloss.zip", "w") as z:
        z.writestr("p/gloss-sux.json", json.dumps(GLOSSARY))
    (root / "texts").mkdir()
    with zipfile.ZipFile(root / "texts" / "a.zip", "w") as z:
        z.writestr("p/q/corpusjson/P000001.json", json.dumps(DOC))
        z.writestr("p/q/corpusjson/Q000002.json", "{broken")
        z.writestr("p/q/corpusjson/P000003.json", "")
        z.writestr("p/q/catalogue.json", json.dumps({"members": {"P000001": {"period": "Old", "designation": "X 1"}, "P9": "odd"}}))
        z.writestr("p/q/readme.txt", "")
    with zipfile.ZipFile(root / "texts" / "b.zip", "w") as z:
        z.writestr("r/corpusjson/P000001.json", json.dumps(DOC))
        z.writestr("r/catalogue.json", "{")
    (root / "texts" / "c.zip").write_text("not an archive")
    with zipfile.ZipFile(root / "tei.zip", "w") as z:
        z.writestr("e/transliterations/c.1.4.1.xml", TEI)
        z.writestr("e/transliterations/c.1.4.2.xml", "<TEI>&zz;</TEI>")
        z.writestr("e/transliterations/c.1.4.3.xml", "<TEI><text/></TEI>")
        z.writestr("e/translations/t.1.4.1.xml", TRANSLATION)
    names = [*CONSUMED, *COLUMNS]
    rows = [{"id_text": "347", "designation": 'a "b", c\nd', "photo_up": "600ppi", "period": " Ur "}, {"id_text": "x1"}, {"id_text": "1234567"}, {"id_text": "347", "lineart_up": " ", "genre": "later"}]
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    text = ",".join(names) + "\n" + "".join(",".join(quote(r.get(n, "")) for n in names) + "\n" for r in rows)
    (root / "cat.csv").write_text(text)
    (root / "bad.csv").write_text(text.replace("genre", "kind", 1))
    signs = {"signs": {"LUGAL": {"utf8": "𒈗", "values": ["lugal", "šar₂"]}, "ŠAR₂": {"utf8": "𒊹", "values": ["šar₂"]}, "NO": {"values": ["no"]}}}
    (root / "signs.json").write_text(json.dumps(signs))
    out = str(root / "out")
    kwargs = dict(glossary=(str(root / "gloss.zip"), "p/gloss-sux.json"), archives=str(root / "texts"), bilingual_archive=str(root / "tei.zip"), catalogue_csv=str(root / "cat.csv"), signs=str(root / "signs.json"), least=2)
    rows = build.build_all(spark, out, **kwargs)
    assert build.build_all(spark, out, **kwargs) == rows  # the version gate
    return root, Corpus.read(spark, out, list(rows))


def test_glossary(built):
    _, c = built
    assert [tuple(r) for r in c["entries"].select("id", "headword", "icount", "cf_cf", "letter").collect()] == [("o1", "lugal[king]N", 49942, "lugal", "L")]
    assert sorted(tuple(r) for r in c["periods"].select("ord", "p", "icount").collect()) == [(0, "Old", 5), (1, "Bare", None)]
    assert [tuple(r) for r in c["compounds"].select("xcpd", "eref").collect()] == [("lugal gal", "o2")]
    assert sorted(tuple(r) for r in c["forms"].select("id", "n", "icount").collect()) == [("f1", "lugal-e", 7), ("f2", "", None), ("f3", "lugal", None)]
    assert c["norms"].count() == 0
    assert [tuple(r) for r in c["senses"].select("id", "mng", "icount").collect()] == [("s1", "king", None)]
    assert [tuple(r) for r in c["sense_sigs"].select("id", "sense_id", "sig", "icount").collect()] == [("g1", "s1", "", 3)]
    assert sorted(tuple(r) for r in c["morphology"].select("cbd_id", "kind", "n", "icount").collect()) == [("b1", "base", "lugal", None), ("m1", "morph", "~", 4)]
    assert sorted(r.word_ref for r in c["instances"].collect()) == ["p/q:P1.1.1", "p/q:P1.10.1"]


def test_text_index_and_nodes(built):
    _, c = built
    found = sorted(tuple(r) for r in c["text_locations"].select("project", "text_id", "period", "designation").collect())
    assert found == [("p/q", "P000001", "Old", "X 1"), ("p/q", "P000003", None, None), ("p/q", "Q000002", None, None), ("r", "P000001", None, None)]
    lost = sorted((r.text_id or "", r.project.rsplit("/")[-1]) for r in c["unreadable"].collect())
    assert lost == [("", "c.zip"), ("P000003", "q"), ("Q000002", "q")]  # the third archive is none


def test_build_state(built, spark):
    root, _ = built
    state = build.built_state(spark, str(root / "out"))
    assert state["texts_scanned"] == "4" and state["parse_failures"] == "3" and state["source.archives"].endswith("texts") and state["rows.signs"] == "3"
    assert build.built_state(spark, str(root / "nowhere")) == {}


def test_documents_that_break_off(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [1, 2, {"a"')
    read = spark.read.format("json_items").option("path", f"file://{tmp_path}/a.json").option("field", "items").option("tolerant", "true").load()
    assert [(r.position, r.value) for r in read.orderBy("position").collect()] == [(0, "1"), (1, "2"), (2, None)]
    assert spark.read.format("zip_members").option("path", str(tmp_path / "*.zip")).load().count() == 0


def test_ngrams(built):
    _, c = built
    # the document counts in both projects; the single-lemma line gives nothing; other languages break no sequence
    assert {r["cf"]: r["count"] for r in c["unigrams"].collect()} == {"lugal": 6, "šarrum": 2, "egal": 6, "du": 6}
    pairs = {r["ngram"]: r["count"] for r in c["collocations"].filter("n = 2").collect()}
    assert pairs == {"lugal šarrum": 2, "šarrum egal": 2, "egal du": 6, "lugal egal": 4}
    rich = {r["ngram"]: r["count"] for r in c["inflected_ngrams"].filter("n = 3").collect()}
    assert rich == {"lugal|king|N|ergative\tegal|palace|N|\tdu||V/t|": 6}


def test_resolve_lines(built, spark):
    _, c = built
    parts = F.split("ref", r"\.")
    words = c["corpus_words"].filter("frag is not null").select("project", parts[0].alias("text_id"), parts[1].alias("line"), "position", "frag", "ref")
    asked = spark.createDataFrame([("p/q:P1.1.4",), ("p/q:P1.1.2",), ("p/q:P1.10.1",), ("nothing",), ("p/q:P7.1",)], "ref_asked string")
    found = {r.line: (r.transliteration, r.target_position) for r in resolve_lines(words, asked, "ref_asked").collect()}
    assert found == {"1": ("lugal-e šar-rum e₂-gal mu-na-du₃", 1), "10": ("lugal-e e₂-gal mu-na-du₃ (blank)", 0)}


def test_bilingual(built):
    _, c = built
    assert sorted(tuple(r) for r in c["texts"].collect()) == [("c.1.4.1", "Song of {ŋeš}⸣", True), ("c.1.4.3", None, False)]
    lines = sorted(tuple(r) for r in c["lines"].select("line_id", "ord", "line_label", "transliteration", "paragraph_id").collect())
    assert lines == [("c141.1", 1, "1", "gal-še₃ {d}en-ki", "t141.p1"), ("c141.A.5", 3, "A.5", "lugal", "t141.p1")]
    words = sorted(tuple(r) for r in c["words"].select("line_id", "word_pos", "form", "lemma").collect())
    assert words == [("c141.1", 0, "gal-še₃", "gal"), ("c141.1", 2, "{d}en-ki", "en-ki"), ("c141.A.5", 0, "lugal", "lugal")]
    assert sorted(tuple(r)[1:] for r in c["paragraphs"].collect()) == [("t141.p1", "1-2", 1, "The god — speaks."), ("t141.p2", "B.1-5", None, "Again.")]


def test_catalogue(built, spark):
    root, c = built
    rows = {r.p_id: r for r in c["artifacts"].collect()}
    assert set(rows) == {"P000347", "P1234567"}
    assert rows["P000347"]["genre"] == "later" and rows["P000347"]["designation"] is None and rows["P000347"]["has_photo"] == 0
    with pytest.raises(HeaderError):
        read_catalogue(spark, str(root / "bad.csv"))


def test_signs(built):
    _, c = built
    assert [r.sign_name for r in signs_of(c["signs"], "šar2").collect()].count("LUGAL") == 1
    assert sorted((r.sign_name, r.matched_by) for r in signs_of(c["signs"], "ŠAR2").collect()) == [("LUGAL", "value"), ("ŠAR₂", "sign_name")]


def test_publish(built, spark):
    root, _ = built
    build.publish(spark, str(root / "out"), ["entries", "instances"], "tellgrid_test")
    assert spark.sql("select e.cf from tellgrid_test.entries e join tellgrid_test.instances i on i.xis = e.xis").count() == 2
    stats = spark.sql("describe extended tellgrid_test.entries").filter("col_name = 'Statistics'").first()
    assert "rows" in stats.data_type
    spark.sql("drop database tellgrid_test cascade")


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_json_stream_any_value(value, step):
    class Drip:
        def __init__(self, text):
            self.text, self.at = text, 0

        def read(self, _):
            self.at += step
            return self.text[self.at - step : self.at]

    document = json.dumps({"before": value, "items": [value, value], "pairs": {"k": value}})
    assert [v for _, v in JsonStream(Drip(document)).field("items", False)] == [value, value]
    assert list(JsonStream(Drip(document)).field("pairs", True)) == [("k", value)]


def test_json_stream_small_steps():
    class Drip:
        def __init__(self, text):
            self.text, self.at = text, 0

        def read(self, _):
            self.at += 1
            return self.text[self.at - 1 : self.at]

    text = json.dumps(GLOSSARY, ensure_ascii=False)
    assert [v for _, v in JsonStream(Drip(text)).field("entries", False)] == GLOSSARY["entries"]
    assert dict(JsonStream(Drip(text)).field("instances", True)) == GLOSSARY["instances"]
    assert list(JsonStream(Drip(text)).field("missing", True)) == []
