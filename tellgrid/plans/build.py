"""Building the corpus: sources to tables, tables to Parquet, with build metadata and a version gate.

Tables are rebuilt as a whole (drop and write). Layout replaces secondary indexes: tables are split into ranges of their
lookup key and sorted by it within files, so that file and row-group statistics prune. ``publish`` makes them tables of a
catalog with statistics for the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellgrid import SCHEMA_VERSION
from tellgrid.functions import collate, morph
from tellgrid.functions.text import casefold, leading_number, line_label, normalize_translit, strip
from tellgrid.operators import fts, ngrams
from tellgrid.operators.dedup import first_wins
from tellgrid.sources import bilingual, catalogue, documents
from tellgrid.sources import register as register_sources

#: Kinds of morphology by their name in the source (fixed values).
MORPHOLOGY = {"morphs": "morph", "morph2s": "morph2", "stems": "stem", "bases": "base", "prefixs": "prefix", "form-sanss": "form-sans"}
#: Columns that get a case-folded mirror when tables are written (fixed values).
MIRRORED = {
    "entries": ("cf", "gw"), "senses": ("mng",), "forms": ("n",), "norms": ("n",), "compounds": ("xcpd",), "morphology": ("n",),
}
#: Sort key of each table's files.
SORTED = {
    "entries": ["id"], "periods": ["entry_id", "ord"], "compounds": ["entry_id", "xcpd"], "morphology": ["kind", "n"], "forms": ["n"], "norms": ["n"],
    "senses": ["entry_id"], "sense_sigs": ["sense_id"], "instances": ["xis", "word_ref"], "text_locations": ["text_id"], "unigrams": ["cf"],
    "collocations": ["n", "cf1"], "inflected_ngrams": ["n", "cf1"], "texts": ["text_id"], "lines": ["text_id", "ord"], "words": ["lemma"],
    "paragraphs": ["text_id"], "artifacts": ["p_id"], "corpus_words": ["project", "text_id", "position"],
}

_ITEM = "struct<id:string,cbd_id:string,n:string,mng:string,pos:string,icount:string,ipct:string,xis:string>"
_SIG = "struct<id:string,sig:string,icount:string,ipct:string,xis:string>"
_SENSE = _ITEM[:-1] + f",sigs:array<{_SIG}>>"
_ENTRY = ", ".join(
    [
        *[f"{c} string" for c in ("id", "headword", "cf", "gw", "pos", "icount", "ipct", "xis")],
        "periods array<string>, `see-compounds` array<struct<xcpd:string,eref:string>>",
        *[f"`{c}` array<{_ITEM}>" for c in ("forms", "norms", *MORPHOLOGY)],
        f"senses array<{_SENSE}>",
    ]
)


def _number(value: Column) -> Column:
    """Whole number of a text; '' and anything else give null."""
    return strip(value).try_cast("bigint")


def glossary_tables(entries: DataFrame, instances: DataFrame) -> dict[str, DataFrame]:
    """The tables of a glossary from its streamed ``position, value`` entries and ``position, key, value`` instances.

    Of rows with the same key the first in the file is kept; children of a repeated entry are kept under their own keys.
    """
    parsed = entries.select("position", F.from_json("value", _ENTRY).alias("e")).select("position", "e.*").filter("id is not null and id <> ''")
    count = [_number(F.col("x.icount")).alias("icount"), _number(F.col("x.ipct")).alias("ipct"), F.col("x.xis").alias("xis")]

    def children(column: str) -> DataFrame:
        return parsed.select("position", F.col("id").alias("entry_id"), F.posexplode(F.col(f"`{column}`")).alias("at", "x"))

    def first(df: DataFrame, keys: list[str]) -> DataFrame:
        return first_wins(df, keys, ["position", "at"]).drop("position", "at")

    head = parsed.select("position", F.lit(0).alias("at"), "id", F.coalesce("headword", F.lit("")).alias("headword"), "cf", "gw", "pos", _number(F.col("icount")).alias("icount"), _number(F.col("ipct")).alias("ipct"), "xis")
    period = F.when(F.col("x").startswith("{"), F.from_json("x", "p string, icount string, ipct string, xis string"))
    periods = parsed.select("position", F.col("id").alias("entry_id"), F.posexplode("periods").alias("ord", "x")).withColumn("s", period)
    periods = periods.select("position", F.lit(0).alias("at"), "entry_id", "ord", F.when(F.col("x").startswith("{"), F.col("s.p")).otherwise(F.col("x")).alias("p"), _number(F.col("s.icount")).alias("icount"), _number(F.col("s.ipct")).alias("ipct"), F.col("s.xis").alias("xis"))
    compounds = children("see-compounds").select("position", "at", "entry_id", "x.xcpd", "x.eref")
    morphology = None
    for i, (column, kind) in enumerate(MORPHOLOGY.items()):
        part = children(column).select("position", (F.col("at") + i * 1_000_000).alias("at"), "x.cbd_id", "entry_id", F.lit(kind).alias("kind"), "x.n", *count)
        morphology = part if morphology is None else morphology.unionByName(part)
    named = {c: children(c).select("position", "at", "x.id", "entry_id", F.coalesce("x.n", F.lit("")).alias("n"), *count) for c in ("forms", "norms")}
    senses = children("senses")
    sigs = senses.select("position", (F.col("at") * 1_000_000).alias("base"), F.col("x.id").alias("sense_id"), F.posexplode("x.sigs").alias("i", "y"))
    sigs = sigs.filter("sense_id is not null and sense_id <> ''").select(
        "position", (F.col("base") + F.col("i")).alias("at"), "y.id", "sense_id", F.coalesce("y.sig", F.lit("")).alias("sig"),
        _number(F.col("y.icount")).alias("icount"), _number(F.col("y.ipct")).alias("ipct"), "y.xis",
    )
    senses = senses.select("position", "at", "x.id", "entry_id", "x.n", "x.mng", "x.pos", *count)
    refs = instances.select("position", F.col("key").alias("xis"), F.posexplode(F.from_json("value", "array<string>")).alias("at", "word_ref"))
    given = lambda df, c: df.filter(F.col(c).isNotNull() & (F.col(c) != ""))
    return {
        "entries": first(head, ["id"]),
        "periods": first(given(periods, "p"), ["entry_id", "ord"]),
        "compounds": first(given(compounds, "xcpd"), ["entry_id", "xcpd"]),
        "morphology": first(given(morphology, "cbd_id").filter("n is not null"), ["cbd_id"]),
        "forms": first(given(named["forms"], "id"), ["id"]),
        "norms": first(given(named["norms"], "id"), ["id"]),
        "senses": first(given(senses, "id"), ["id"]),
        "sense_sigs": first(given(sigs, "id"), ["id"]),
        # two columns that are both the key: any of equal rows is the first one
        "instances": refs.select("xis", "word_ref").distinct(),
    }


def text_index(members: DataFrame) -> DataFrame:
    """text_locations: every document of the archives with its catalogue's period and designation, first archive first."""
    found = first_wins(documents.located(members).drop("content"), ["project", "text_id"], ["zip_path", "position"]).drop("position")
    listed = first_wins(documents.catalogue_entries(members), ["project", "text_id"], ["zip_path", "position", "designation", "period"]).drop("zip_path", "position")
    return found.join(listed, ["project", "text_id"], "left")


def word_nodes(members: DataFrame) -> DataFrame:
    """Nodes of all documents, each document once."""
    once = first_wins(documents.located(members), ["project", "text_id"], ["zip_path", "position"])
    return documents.flatten(once)


def line_sequences(nodes: DataFrame, annotated: bool) -> DataFrame:
    """project, text_id, line_no, position and the slot of every lemma; annotated sequences leave other languages out."""
    starts = (F.col("node") == "d") & (F.col("type") == "line-start")
    kept = nodes.filter(starts | ((F.col("node") == "l") & F.col("cf").isNotNull() & (F.col("cf") != "")))
    placed = ngrams.lines_of(kept.withColumn("_start", F.coalesce(starts, F.lit(False))), ["project", "text_id"], "position", "_start")
    lemmas = placed.filter("not _start")
    if annotated:
        lemmas = lemmas.filter((F.coalesce("lang", F.lit("")) == "") | F.col("lang").startswith("sux"))
    shown = F.regexp_replace(strip(F.regexp_replace("frag", r"\{[^}]*\}", "")), r"^[\[\]⸢⸣(),;:!?]+|[\[\]⸢⸣(),;:!?]+$", "")
    case = F.when(shown != "", morph.outermost_case(morph.peel_suffixes(shown)["suffixes"]))
    blank = F.lit("")
    return lemmas.select("project", "text_id", "line_no", "position", "cf", F.nullif("gw", blank).alias("gw"), F.nullif("pos", blank).alias("pos"), case.alias("case"))


def ngram_tables(nodes: DataFrame, least: int = 3, longest: int = 4) -> dict[str, DataFrame]:
    """unigrams, collocations and inflected_ngrams; lines of one lemma give nothing, and rare n-grams are dropped."""
    line = ["project", "text_id", "line_no"]
    plain, rich = line_sequences(nodes, False), line_sequences(nodes, True)
    slot = F.struct("cf", "gw", "pos", "case")
    tables: dict[str, DataFrame] = {}

    def lists(df: DataFrame, item: Column) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("slot")))), lambda s: s["slot"])
        return df.groupBy(*line).agg(ordered.alias("items")).filter(F.size("items") >= 2)

    words, slots = lists(plain, F.col("cf")), lists(rich, slot)
    tables["unigrams"] = words.select(F.explode("items").alias("cf")).groupBy("cf").agg(F.count(F.lit(1)).alias("count"))
    grams = features = None
    for n in range(2, longest + 1):
        counted = words.select(F.explode(ngrams.array_ngrams("items", n)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)
        part = counted.select(F.lit(n).alias("n"), F.array_join("g", " ").alias("ngram"), *[F.get("g", F.lit(i)).alias(f"cf{i + 1}") for i in range(4)], "count")
        grams = part if grams is None else grams.unionByName(part)
        rows = slots.select(F.explode(ngrams.array_ngrams("items", n)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)
        columns = [F.get("g", F.lit(i))[f].alias(f"{f}{i + 1}") for f in ("cf", "gw", "pos", "case") for i in range(4)]
        part = rows.select(F.lit(n).alias("n"), ngrams.encode_slots(F.col("g")).alias("ngram"), *columns, "count")
        features = part if features is None else features.unionByName(part)
    return tables | {"collocations": grams, "inflected_ngrams": features}


def bilingual_tables(members: DataFrame) -> dict[str, DataFrame]:
    """texts, lines, words, paragraphs of the bilingual archives; an unreadable transliteration leaves its text out."""
    words = bilingual.read_words(members)
    paragraphs = bilingual.read_paragraphs(members).filter("error is null")
    fine = words.filter("error is null")
    titles = fine.filter("line_id is null").select("text_id", "title")
    form = normalize_translit(F.col("form"))
    rows = fine.filter("line_id is not null").select("text_id", "line_id", "ord", "number", "paragraph_id", "word_pos", form.alias("form"), normalize_translit(F.col("lemma")).alias("lemma"), "pos", "label", "type")
    spelt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_pos", "form"))), lambda s: s["form"]), " ")
    lines = rows.groupBy("text_id", "line_id", "ord", "number", "paragraph_id").agg(spelt.alias("transliteration"))
    lines = first_wins(lines, ["text_id", "line_id"], ["ord"]).withColumn("line_label", line_label(F.col("line_id"), F.col("number"))).drop("number")
    kept = first_wins(rows, ["text_id", "line_id", "word_pos"], ["ord"]).select("text_id", "line_id", "word_pos", "form", "lemma", "pos", "label", "type")
    once = first_wins(paragraphs, ["text_id", "para_id"], ["position"]).select("text_id", "para_id", "line_range", leading_number(F.col("line_range")).alias("line_start"), "translation")
    translated = once.select("text_id").distinct().withColumn("t", F.lit(True))
    texts = titles.join(translated, "text_id", "left").select("text_id", "title", F.coalesce("t", F.lit(False)).alias("has_translation"))
    return {"texts": texts, "lines": lines.select("text_id", "line_id", "ord", "line_label", "transliteration", "paragraph_id"), "words": kept, "paragraphs": once}


def mirrored(name: str, df: DataFrame) -> DataFrame:
    """The table with its case-folded mirrors, and for entries with letter and sort_key."""
    for column in MIRRORED.get(name, ()):
        df = df.withColumn(f"{column}_cf", casefold(F.col(column)))
    if name == "entries":
        df = df.withColumn("letter", collate.first_letter(F.col("cf"))).withColumn("sort_key", collate.sort_key(F.col("cf")))
    return df


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Write every table anew and return its rows."""
    counts = {}
    for name, df in tables.items():
        rows = mirrored(name, df)
        if name in SORTED:
            # the whole key makes the ranges, so a hot first column is split like any other
            rows = rows.repartitionByRange(*SORTED[name]).sortWithinPartitions(*SORTED[name])
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{folder}/{name}").count()
    return counts


def publish(spark: SparkSession, folder: str, names: list[str], database: str = "tellgrid") -> None:
    """Tables over the written files in a catalog database, with table and column statistics."""
    spark.sql(f"create database if not exists {database}")
    for name in names:
        spark.sql(f"drop table if exists {database}.{name}")
        spark.catalog.createTable(f"{database}.{name}", path=f"{folder}/{name}", source="parquet")
        spark.sql(f"analyze table {database}.{name} compute statistics for all columns")


def _members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("zip_members").option("path", path).option("pattern", pattern).load()


def build_all(
    spark: SparkSession, folder: str, *, glossary: tuple[str, str] | None = None, archives: str | None = None, bilingual_archive: str | None = None,
    catalogue_csv: str | None = None, signs: str | None = None, least: int = 3, force: bool = False,
) -> dict[str, int]:
    """Build what has a source; nothing is done where the build at ``folder`` is of the current version.

    ``glossary`` is (zip file, member); the other sources are paths. Stages without a source are left out, and a build of
    another version is overwritten table by table. The version marker is written last.
    """
    if not force and (state := built_state(spark, folder)) and state.get("version") == str(SCHEMA_VERSION):
        return {k.removeprefix("rows."): int(v) for k, v in state.items() if k.startswith("rows.")}
    register_sources(spark)
    rows: dict[str, int] = {}
    stages: list[tuple[str | tuple | None, Callable[[], dict[str, DataFrame]]]] = []

    def of_glossary() -> dict[str, DataFrame]:
        def items(field: str, kind: str) -> DataFrame:
            return spark.read.format("json_items").option("path", glossary[0]).option("member", glossary[1]).option("field", field).option("kind", kind).load()

        return glossary_tables(items("entries", "items"), items("instances", "pairs"))

    def of_archives() -> dict[str, DataFrame]:
        members = _members(spark, archives, r"/corpusjson/[PQ]\d+\.json$|/catalogue\.json$")
        nodes = word_nodes(members)
        broken = members.filter("member is null").select(F.col("archive").alias("project"), F.lit(None).cast("string").alias("text_id"))
        unreadable = nodes.filter("not readable").select("project", "text_id").unionByName(broken)
        return {"text_locations": text_index(members), "corpus_words": nodes.filter("readable"), "unreadable": unreadable} | ngram_tables(nodes.filter("readable"), least)

    stages.append((archives, of_archives))
    stages.append((glossary, of_glossary))
    stages.append((bilingual_archive, lambda: bilingual_tables(_members(spark, bilingual_archive, r"\.xml$"))))
    stages.append((catalogue_csv, lambda: {"artifacts": catalogue.read_catalogue(spark, catalogue_csv)}))
    stages.append((signs, lambda: {"signs": catalogue.read_signs(spark, signs)}))
    for source, stage in stages:
        if source:
            rows |= write_tables(stage(), folder)
    if bilingual_archive:
        held = {n: spark.read.parquet(f"{folder}/{n}") for n in ("paragraphs", "lines")}
        fts.build_index(held["paragraphs"].withColumn("doc", F.concat_ws("|", "text_id", "para_id")), "doc", "translation", True).write(f"{folder}/fts_paragraphs")
        fts.build_index(held["lines"].withColumn("doc", F.concat_ws("|", "text_id", "line_id")), "doc", "transliteration").write(f"{folder}/fts_lines")
    sources = {"glossary": glossary and "!".join(glossary), "archives": archives, "bilingual_archive": bilingual_archive, "catalogue_csv": catalogue_csv, "signs": signs}
    meta = [("version", str(SCHEMA_VERSION)), ("built_at", datetime.now(UTC).isoformat()), ("least_count", str(least))]
    meta += [(f"source.{n}", v) for n, v in sources.items() if v] + [(f"rows.{n}", str(c)) for n, c in sorted(rows.items())]
    if archives:
        meta += [("texts_scanned", str(rows["text_locations"])), ("parse_failures", str(rows["unreadable"]))]
    # written last: what it says is there
    spark.createDataFrame(meta, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/build_meta")
    return rows


def built_state(spark: SparkSession, folder: str) -> dict[str, str]:
    """Keys and values of the build at a folder, wherever it lies; empty if there is none."""
    try:
        return {r["key"]: r["value"] for r in spark.read.parquet(f"{folder}/build_meta").collect()}
    except AnalysisException:
        return {}
