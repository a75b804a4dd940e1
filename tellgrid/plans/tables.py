"""The corpus as a set of named DataFrames, and the current state of tables that are delivered in versions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellgrid.functions.text import casefold
from tellgrid.operators.dedup import first_wins, last_wins
from tellgrid.session import load, shared_folder


@dataclass
class Corpus:
    """Tables by name; ``corpus["entries"]`` reads one."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def derived(self, name: str, make: Callable[[Corpus], DataFrame], layout: tuple[str, ...] = ()) -> DataFrame:
        """A table made from others; a built corpus keeps it, sorted by ``layout``, and any other plans it anew."""
        return self.tables[name] if name in self.tables else make(self)

    @classmethod
    def read(cls, spark: SparkSession, folder: str, names: list[str]) -> Corpus:
        """Tables written by the build."""
        return cls({n: spark.read.parquet(f"{folder}/{n}") for n in names})


#: Sort keys of the built tables, which take the place of indexes, and columns that get a case-folded mirror.
LAYOUT = {
    "entries": ("id",), "forms": ("entry_id", "id"), "periods": ("entry_id", "ord"), "senses": ("entry_id", "id"), "compounds": ("entry_id", "xcpd"),
    "instances": ("xis", "word_ref"), "text_locations": ("project", "text_id"), "artifacts": ("p_id",), "lines": ("text_id", "ord"), "words": ("text_id", "line_id"),
    "paragraphs": ("text_id", "para_id"), "unigrams": ("cf",), "collocations": ("n", "ngram"), "inflected_ngrams": ("n", "ngram"), "morphology": ("entry_id", "kind", "n"),
}
MIRRORS = {"entries": ("cf", "gw", "headword"), "forms": ("n",), "senses": ("mng",), "compounds": ("xcpd",), "morphology": ("n",)}


class Built(Corpus):
    """Tables of a corpus, each written once, when it is first needed, in the layout its lookups want.

    What is written is read from there by every later query: repeats are out, mirrors are columns, derived tables (readings,
    postings) are there to be looked up. ``folder`` must be shared by all executors.
    """

    def __init__(self, source: Corpus, folder: str) -> None:
        super().__init__(dict(source.tables))
        self.folder, self.ready = folder, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.ready:
            rows = self.tables[name]
            mirrors = {f"{c}_cf": casefold(F.col(c)) for c in MIRRORS.get(name, ()) if c in rows.columns}
            self.ready[name] = self._written(name, rows.withColumns(mirrors) if mirrors else rows, LAYOUT.get(name, ()))
        return self.ready[name]

    def derived(self, name: str, make: Callable[[Corpus], DataFrame], layout: tuple[str, ...] = ()) -> DataFrame:
        if name not in self.ready:
            self.ready[name] = self._written(name, make(self), layout)
        return self.ready[name]

    def without(self, *names: str) -> Built:
        """The same corpus, sharing what is written, without some tables."""
        other = Built(Corpus({n: t for n, t in self.tables.items() if n not in names}), self.folder)
        other.ready = {n: t for n, t in self.ready.items() if n not in names}
        return other

    def _written(self, name: str, rows: DataFrame, layout: tuple[str, ...]) -> DataFrame:
        if layout:
            rows = rows.repartitionByRange(*layout).sortWithinPartitions(*layout)
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.folder}/{name}")


_BUILT: dict[tuple, Built] = {}


def built(spark: SparkSession, folder: str) -> Built:
    """The delivered tables of a folder as a built corpus, written beside the checkpoints of this application.

    It is built anew for another application and when a file of the folder has changed.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    state = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)
    key = (spark.sparkContext.applicationId, folder, tuple(state))
    if key not in _BUILT:
        for old in [k for k in _BUILT if k[0] != key[0]]:
            del _BUILT[old]
        mark = hashlib.sha256(repr(key).encode()).hexdigest()[:16]
        _BUILT[key] = Built(delivered(spark, folder), f"{shared_folder(spark)}/built-{mark}")
    return _BUILT[key]


def folded(df: DataFrame, column: str) -> Column:
    """The case-folded mirror of a column where the build has written one, else its lower case."""
    return F.col(f"{column}_cf") if f"{column}_cf" in df.columns else F.lower(column)


def delivered(spark: SparkSession, folder: str) -> Corpus:
    """Tables as delivered, brought to their current state: repeats once, withdrawn rows out, the latest version of a row.

    The delivered tables have no table of senses; the periods of an entry, which have the same shape, stand in for them, and
    verb templates are read off the hyphenated spellings.
    """
    entries = first_wins(load(spark, folder, "entries").filter("removed_at is null"), ["id"], ["loaded_at", "headword"])
    forms = load(spark, folder, "forms").distinct()
    periods = load(spark, folder, "periods").distinct()
    words = load(spark, folder, "words").distinct()
    artifacts = last_wins(load(spark, folder, "artifacts").filter("removed_at is null"), ["p_id"], ["loaded_at", "designation", "period"])
    texts = first_wins(load(spark, folder, "text_locations"), ["project", "text_id"], ["loaded_at", "zip_path", "designation", "period"])
    senses = periods.select(
        F.concat_ws(".", "entry_id", F.lpad(F.col("ord").cast("string"), 3, "0")).alias("id"), "entry_id", F.col("p").alias("mng"), "icount", "ipct"
    )
    return Corpus(
        {
            "entries": entries.select("id", "headword", "cf", "gw", "pos", "icount", "ipct", "xis"),
            "forms": forms,
            "periods": periods,
            "senses": senses,
            "compounds": load(spark, folder, "compounds").select("entry_id", "xcpd", "eref").distinct(),
            "instances": load(spark, folder, "instances").select("xis", "word_ref").distinct(),
            "text_locations": texts,
            "artifacts": artifacts,
            "lines": load(spark, folder, "text_lines").distinct(),
            "words": words,
            "paragraphs": load(spark, folder, "paragraphs").distinct(),
            "unigrams": load(spark, folder, "unigrams").distinct().groupBy("cf").agg(F.sum("count").alias("count")),
            "collocations": load(spark, folder, "collocations").distinct(),
            "inflected_ngrams": last_wins(load(spark, folder, "inflected_ngrams"), ["n", "ngram"], ["loaded_at", "count", "cf1"]).filter("count is not null"),
            "morphology": morphology_of(forms, entries),
        }
    )


#: A hyphenated verb spelling: prefixes, stem, ending (the order of the pieces is fixed).
_VERB = r"^((?:(?:nu|mu|na|un|ba|an|bi₂|in|im|ma|i₃|ḫe₂)-)+)([^-(){}]+)(?:-(eš|en|e|a))?$"


def morphology_of(forms: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of kind morph (a template), base (the stem) and form-sans (no determinatives) for every spelling."""
    verb = forms.join(entries.select(F.col("id").alias("entry_id"), "pos").filter("pos like 'V%'"), "entry_id", "left_semi")
    prefix, stem, ending = (F.regexp_extract("n", _VERB, i) for i in (1, 2, 3))
    split = verb.filter(stem != "").select("id", "entry_id", "icount", "xis", prefix.alias("p"), stem.alias("s"), ending.alias("e"))
    chain = F.regexp_replace(F.translate("p", "-", "."), r"\.$", "")
    template = F.concat(chain, F.lit(":~"), F.when(F.col("e") != "", F.concat(F.lit(";"), F.col("e"))).otherwise(""))
    morph = split.groupBy("entry_id", template.alias("n")).agg(F.sum("icount").alias("icount"), F.min("xis").alias("xis")).withColumn("kind", F.lit("morph"))
    base = split.groupBy("entry_id", F.col("s").alias("n")).agg(F.sum("icount").alias("icount"), F.min("xis").alias("xis")).withColumn("kind", F.lit("base"))
    plain = F.regexp_replace("n", r"\{[^}]*\}", "")
    sans = forms.filter("n is not null").groupBy("entry_id", plain.alias("n")).agg(F.sum("icount").alias("icount"), F.min("xis").alias("xis")).withColumn("kind", F.lit("form-sans"))
    return morph.unionByName(base).unionByName(sans)
