"""Lookups in the dictionary: by meaning, by spelling, by entry, by compound, by inflection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellgrid.functions import collate, morph, text
from tellgrid.functions.render import cuneify
from tellgrid.operators.groups import share, top_per_group
from tellgrid.plans.tables import Corpus, folded

#: Kinds of morphology each lookup reads (fixed values).
ANALYSIS_KINDS = ("base", "form-sans", "morph")
LOOKUP_KINDS = ("base", "form-sans")


def _desc(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def by_meaning(corpus: Corpus, query: str) -> DataFrame:
    """Entries with a sense that holds the query (the best one each), and entries whose guide word does.

    oid, cf, gw, pos, sense, sense_count, sense_pct, entry_total; order by sense_count, entry_total descending, oid.
    """
    needle = query.casefold().strip()
    entries, senses = corpus["entries"], corpus["senses"]
    hits = senses.filter(text.contains_like(folded(senses, "mng"), needle))
    # the best sense: the highest count, a null count last, then the smaller id
    place = [F.col("icount").isNull().alias("uncounted"), (-F.col("icount")).alias("down"), F.col("id")]
    best = hits.groupBy(F.col("entry_id").alias("oid")).agg(F.min(F.struct(*place, "mng", "icount", "ipct")).alias("best"))
    gw = folded(entries, "gw")
    head = entries.select(F.col("id").alias("oid"), "cf", "gw", "pos", F.col("icount").alias("entry_total"), F.coalesce(text.contains_like(gw, needle), F.lit(False)).alias("by_word"))
    found = head.join(best, "oid", "left").filter(F.col("best").isNotNull() | F.col("by_word"))
    # a guide word stands for a sense where no sense holds the query
    said = F.col("best").isNotNull()
    sense = [F.when(said, F.col(f"best.{f}")).otherwise(other).alias(name) for f, other, name in (("mng", F.col("gw"), "sense"), ("icount", F.col("entry_total"), "sense_count"), ("ipct", F.lit(100), "sense_pct"))]
    return found.select("oid", "cf", "gw", "pos", *sense, "entry_total")


def meaning_order() -> list[Column]:
    return [*_desc("sense_count", "entry_total"), F.col("oid")]


def entry_profiles(corpus: Corpus, oids: list[str] | None = None, spellings: int = 25, glyphs: dict[str, str] | None = None) -> DataFrame:
    """One row per entry with its senses, commonest spellings, periods and compounds as arrays of structs.

    With a sign dictionary every spelling has its ``glyphs``.
    """
    entries = corpus["entries"]
    if oids is not None:
        entries = entries.filter(F.col("id").isin(oids))

    def listed(df: DataFrame, name: str, order: list[Column], columns: list[str], cap: int = 0) -> DataFrame:
        if oids is not None:
            df = df.filter(F.col("entry_id").isin(oids))
        ranked = top_per_group(df, ["entry_id"], order, cap)
        if glyphs is not None and name == "spellings":
            ranked, columns = ranked.withColumn("glyphs", cuneify(F.col("n"), glyphs)), [*columns, "glyphs"]
        sorted_rows = F.array_sort(F.collect_list(F.struct("rank", *columns)))
        return ranked.groupBy("entry_id").agg(F.transform(sorted_rows, lambda s: s.dropFields("rank")).alias(name))

    parts = [
        listed(corpus["senses"], "senses", [*_desc("icount"), F.col("id")], ["mng", "icount", "ipct"]),
        listed(corpus["forms"], "spellings", [*_desc("icount"), F.col("n"), F.col("id")], ["n", "icount", "ipct"], spellings),
        listed(corpus["periods"], "periods", [F.col("ord"), F.col("p")], ["p", "icount", "ipct"]),
        listed(corpus["compounds"], "compounds", [F.col("xcpd"), F.col("eref")], ["xcpd", "eref"]),
    ]
    return reduce(lambda a, b: a.join(b, "entry_id", "left"), parts, entries.withColumnRenamed("id", "entry_id")).withColumnRenamed("entry_id", "oid")


def compounds_of(corpus: Corpus, phrase: str) -> DataFrame:
    """Compounds that a meaning may be said with: two-word citation forms, and words usually written with a second sign.

    oid, cf, gw, branch (A or B), spelling, total; order by total descending, branch, oid. A word of branch B is no verb, has
    one word, and its commonest hyphenated spelling (attested five times or more) does not begin with the word itself.
    """
    found = by_meaning(corpus, phrase).select("oid", "cf", "gw", "pos", F.col("entry_total").alias("total"))
    two = found.filter(F.instr("cf", " ") > 0).select("oid", "cf", "gw", F.lit("A").alias("branch"), F.lit(None).cast("string").alias("spelling"), "total")
    hyphenated = corpus["forms"].filter((F.instr("n", "-") > 0) & (F.col("icount") >= 5))
    top = F.row_number().over(Window.partitionBy("entry_id").orderBy(*_desc("icount"), "n", "id"))
    commonest = hyphenated.withColumn("_r", top).filter("_r = 1").select(F.col("entry_id").alias("oid"), F.col("n").alias("spelling"))
    no_verb = F.col("pos").isNull() | ~text.ascii_lower(F.col("pos")).startswith("v")
    one = found.filter((F.instr("cf", " ") == 0) & no_verb).join(commonest, "oid")
    first = text.strip_subscripts(F.substring_index("spelling", "-", 1))
    other = one.filter(first != text.strip_subscripts(F.col("cf"))).select("oid", "cf", "gw", F.lit("B").alias("branch"), "spelling", "total")
    return two.unionByName(other)


def compound_order() -> list[Column]:
    return [*_desc("total"), F.col("branch"), F.col("oid")]


def inflections(corpus: Corpus, least: int = 2, per_kind: int = 25) -> DataFrame:
    """entry_id, kind, n, count, rank, total: the commonest inflections of each kind; a null count counts as 0."""
    rows = corpus["morphology"].withColumn("count", F.coalesce("icount", F.lit(0))).filter(F.col("count") >= least)
    ranked = top_per_group(rows, ["entry_id", "kind"], [F.col("count").desc(), F.col("n")], per_kind)
    return ranked.select("entry_id", "kind", "n", "count", "rank", "total")


def _spellings(corpus: Corpus) -> DataFrame:
    forms, rows = corpus["forms"], corpus["morphology"].filter(F.col("kind").isin(*ANALYSIS_KINDS))
    first = forms.select(F.lit("forms").alias("matched_in"), "entry_id", F.col("n").alias("spelling"), folded(forms, "n").alias("n_cf"), F.col("icount").alias("count"))
    tag = F.concat(F.lit("morphology."), F.col("kind"))
    second = rows.select(tag.alias("matched_in"), "entry_id", F.col("n").alias("spelling"), folded(rows, "n").alias("n_cf"), F.col("icount").alias("count"))
    return first.unionByName(second).filter("spelling is not null")


def spellings(corpus: Corpus, kinds: tuple[str, ...] = ANALYSIS_KINDS) -> DataFrame:
    """matched_in, entry_id, spelling, n_cf, count: every known spelling, tagged with where it is known from."""
    known = corpus.derived("spellings", _spellings, ("n_cf",))
    return known.filter(F.col("matched_in").isin("forms", *[f"morphology.{k}" for k in kinds]))


def analyze(corpus: Corpus, asked: DataFrame, spelling: str) -> DataFrame:
    """Readings of every asked spelling: spelling, matched_in, oid, cf, gw, pos, matched_text, count, total.

    ``total`` is the number of readings of the spelling over all the places it is known from. Order by analysis_order().
    """
    wanted = asked.select(F.col(spelling).alias("asked")).filter("asked is not null").distinct().withColumn("asked_cf", F.lower("asked"))
    known = spellings(corpus)
    head = corpus["entries"].select(F.col("id").alias("entry_id"), "cf", "gw", "pos")
    hits = wanted.join(known, wanted["asked_cf"] == known["n_cf"]).join(head, "entry_id")
    total = F.count(F.lit(1)).over(Window.partitionBy("asked"))
    return hits.select(F.col("asked").alias("spelling"), "matched_in", F.col("entry_id").alias("oid"), "cf", "gw", "pos", F.col("spelling").alias("matched_text"), "count", total.alias("total"))


def analysis_order() -> list[Column]:
    """Spellings of the dictionary before those of the morphology, each by count."""
    return [F.when(F.col("matched_in") == "forms", 0).otherwise(1), *_desc("count"), F.col("matched_in"), F.col("oid"), F.col("matched_text")]


def _readings(corpus: Corpus) -> DataFrame:
    entries = corpus["entries"]
    head = entries.select(F.col("id").alias("oid"), "cf", "gw", "pos", F.col("icount").alias("entry_total"))
    own = entries.select(folded(entries, "cf").alias("key"), F.col("id").alias("oid"))
    other = spellings(corpus, LOOKUP_KINDS).select(F.col("n_cf").alias("key"), F.col("entry_id").alias("oid"))
    keys = own.unionByName(other).filter("key is not null").distinct().join(head, "oid")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*_desc("entry_total"), F.col("oid")))
    return keys.withColumn("rank", rank)


def readings(corpus: Corpus) -> DataFrame:
    """key, oid, cf, gw, pos, entry_total, rank: entries by citation form, spelling or base, each once per key, the commonest first."""
    return corpus.derived("readings", _readings, ("key", "rank"))


def top_readings(corpus: Corpus, per_key: int = 3) -> DataFrame:
    """The ``per_key`` commonest readings of every key, with their rank."""
    return readings(corpus).filter(F.col("rank") <= per_key)


def gloss_tokens(corpus: Corpus, lines: DataFrame, key: list[str], spelling: str, per_token: int = 3) -> DataFrame:
    """Word-by-word glosses of transliterations.

    key.., position, part, token, from_word, match_kind (whole, split_fallback, unmatched), base, suffixes, rank, oid, cf, gw,
    pos. A word known as a whole is not split, and its suffix chain is given where it has one; one that is not known is split
    at hyphens and dots and its cleaned parts are looked up, unless no more than one part is left. Distinct words are looked
    up once, whatever the number of lines.
    """
    words = lines.select(*key, F.posexplode(text.tokens(F.col(spelling), placeholders=True)).alias("position", "word"))
    known = top_readings(corpus, per_token).select("key", "rank", "oid", "cf", "gw", "pos")
    vocabulary = words.select("word").distinct().withColumn("word_key", F.lower("word"))
    keys = readings(corpus).filter("rank = 1").select(F.col("key").alias("word_key"), F.lit(True).alias("is_whole"))
    kinds = vocabulary.join(keys, "word_key", "left").select("word", F.coalesce("is_whole", F.lit(False)).alias("is_whole"))
    split = kinds.withColumn("parts", F.when(F.col("is_whole"), F.array("word")).otherwise(text.clean_pieces(F.col("word"))))
    kind = F.when(F.col("is_whole"), "whole").when(F.size("parts") <= 1, "unmatched").otherwise("split_fallback")
    split = split.withColumn("match_kind", kind).withColumn("parts", F.when(F.col("match_kind") == "split_fallback", F.col("parts")).otherwise(F.array("word")))
    peeled = F.when(F.col("match_kind") == "whole", morph.peel_suffixes(F.col("word")))
    split = split.withColumn("peeled", F.when(F.size(peeled["suffixes"]) > 0, peeled))
    tokens = split.select("word", "match_kind", "peeled", F.posexplode("parts").alias("part", "token"))
    # an unmatched word has no readings of its own
    sought = F.when(F.col("match_kind") != "unmatched", F.lower("token"))
    glossed = tokens.withColumn("token_key", sought).join(known, F.col("token_key") == F.col("key"), "left")
    glossed = glossed.select("word", "part", "token", "match_kind", F.col("peeled.base").alias("base"), F.col("peeled.suffixes").alias("suffixes"), "rank", "oid", "cf", "gw", "pos")
    found = words.join(glossed, "word")
    from_word = F.when(F.col("match_kind") == "split_fallback", F.col("word")).alias("from_word")
    number = [F.col(c).cast("bigint").alias(c) for c in ("position", "part")]
    return found.select(*key, *number, "token", from_word, "match_kind", "base", "suffixes", F.col("rank").cast("bigint").alias("rank"), "oid", "cf", "gw", "pos")


def parse_phrases(corpus: Corpus, lines: DataFrame, key: list[str], spelling: str) -> DataFrame:
    """Grammatical roles of the words of transliterations.

    key.., chunks (array of token, base, suffixes, cf, pos_head, is_verb_form, verbal_prefixes, role,
    phrase_boundary_after), skeleton, notes. Distinct words are read once, whatever the number of lines.
    """
    words = lines.select(*key, F.posexplode(text.tokens(F.col(spelling))).alias("position", "word"))
    top = top_readings(corpus, 1).select("key", "cf", "pos")
    vocabulary = words.select("word").distinct()
    peeled = vocabulary.withColumn("peeled", morph.peel_suffixes(F.col("word"))).withColumn("prefixes", morph.verbal_prefixes(F.col("word")))
    peeled = peeled.withColumn("w_key", F.lower("word")).withColumn("b_key", F.lower("peeled.base"))
    whole = top.select(F.col("key").alias("w_key"), F.col("cf").alias("w_cf"), F.col("pos").alias("w_pos"), F.lit(True).alias("w_known"))
    base = top.select(F.col("key").alias("b_key"), F.col("cf").alias("b_cf"), F.col("pos").alias("b_pos"), F.lit(True).alias("b_known"))
    read = peeled.join(whole, "w_key", "left").join(base, "b_key", "left")
    w_known, b_known = F.coalesce("w_known", F.lit(False)), F.coalesce("b_known", F.lit(False))
    is_verb = F.coalesce(F.col("w_pos").startswith("V"), F.lit(False)) | (F.col("prefixes").isNotNull() & (F.coalesce("w_pos", F.lit("")) == ""))
    suffixed = F.size("peeled.suffixes") > 0
    by_base = suffixed & ~w_known
    known = F.when(by_base, b_known).otherwise(w_known)
    cf = F.when(by_base, F.col("b_cf")).otherwise(F.col("w_cf"))
    pos = F.when(by_base, F.col("b_pos")).otherwise(F.col("w_pos"))
    last = F.element_at(F.split("word", "-"), -1)
    case = morph.outermost_case(F.col("peeled.suffixes"))
    role = F.when(F.col("is_verb"), "verb_head").otherwise(morph.phrase_role(F.col("case"), F.col("pos_head"), F.col("known")))
    chunk = (
        read.withColumn("is_verb", is_verb).withColumn("known", F.when(F.col("is_verb"), w_known).otherwise(known))
        .withColumn("cf", F.when(F.col("is_verb"), F.col("w_cf")).otherwise(cf)).withColumn("pos_head", F.when(F.col("is_verb"), F.col("w_pos")).otherwise(pos))
        .withColumn("case", F.when(~F.col("is_verb"), case)).withColumn("role", role)
        .withColumn("base", F.when(F.col("is_verb"), F.when(F.col("prefixes").isNotNull(), last)).when(suffixed, F.col("peeled.base")))
        .withColumn("suffixes", F.when(F.col("is_verb"), F.slice("peeled.suffixes", 1, 0)).otherwise(F.col("peeled.suffixes")))
        .withColumn("prefixes", F.when(F.col("is_verb"), F.col("prefixes")))
    )
    head = F.coalesce(F.when(F.col("known"), F.col("cf")), F.when(F.col("is_verb"), last).otherwise(F.coalesce("base", "word")))
    verb = F.concat(F.lit("[V "), head, F.when(F.col("prefixes").isNotNull(), F.concat(F.lit(" ("), F.col("prefixes"), F.lit("-)"))).otherwise(""), F.lit("]"))
    noun = F.concat(F.lit("[NP "), head, F.lit("-"), morph.role_label(F.col("role")), F.lit("]"))
    shown = (
        F.when(F.col("is_verb"), verb).when(F.col("role") == "adjective_modifier", head)
        .when(F.col("case").isNotNull() | (F.col("role") == "noun_head_unmarked"), noun).otherwise(F.concat(F.lit("[? "), head, F.lit("]")))
    )
    read = chunk.select(
        "word",
        F.struct(
            F.col("word").alias("token"), "base", "suffixes", "cf", "pos_head", F.col("is_verb").alias("is_verb_form"),
            F.col("prefixes").alias("verbal_prefixes"), "role", (F.col("role") != "adjective_modifier").alias("phrase_boundary_after"),
        ).alias("chunk"),
        F.struct(shown.alias("text"), (F.col("role") == "adjective_modifier").alias("adjective")).alias("shown"),
    )
    placed = words.join(read, "word").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", "chunk", "shown")), lambda a, b: a["position"] - b["position"]).alias("all"))
    chunks = F.transform("all", lambda x: x["chunk"])
    result = placed.select(*key, chunks.alias("chunks"), morph.skeleton(F.transform("all", lambda x: x["shown"])).alias("skeleton"))
    return result.withColumn("notes", _notes(F.col("chunks")))


def _notes(chunks: Column) -> Column:
    """Remarks that the roles of a phrase suggest (the wordings are fixed values)."""
    has = lambda role: F.exists(chunks, lambda c: c["role"] == role)
    subject, thing, verb = has("subject_ergative"), has("noun_head_unmarked"), has("verb_head")
    clause = F.when(subject & thing & verb, "ergative subject + absolutive object + verb head: transitive clause (canonical SOV pattern)").when(
        thing & verb & ~subject,
        "absolutive subject + verb head, no ergative marker: likely INTRANSITIVE clause (or the ergative-marked subject was elided in this fragment)",
    )
    like = F.when(
        has("comparison_equative"),
        "equative -gin₇ detected: the marked noun is being compared LIKE the head, not described AS the head — rules out an attributive-adjective reading",
    )
    each = F.flatten(
        F.transform(
            chunks,
            lambda c: F.transform(
                F.filter(c["suffixes"], lambda s: F.size(s["ambiguous_with"]) > 0),
                lambda s: F.concat(F.lit("token '"), c["token"], F.lit("': suffix '"), s["spelling"], F.lit("' read as '"), s["role"], F.lit("', but ambiguous with: "), F.array_join(s["ambiguous_with"], ", ")),
            ),
        )
    )
    return F.concat(F.array_compact(F.array(clause, like)), each)


def verb_forms(
    corpus: Corpus, *, cf: str | None = None, pos: str = "V/t", prefix: str | None = None, polarity: str = "affirm", object_person: str | None = None,
    dimensional: list[str] | None = None, aspect: str | None = None, suffix_a: bool | None = None, reduplicated: bool | None = None, least: int = 1,
    limit: int = 10, glyphs: dict[str, str] | None = None,
) -> DataFrame:
    """Attested forms with the asked features: oid, cf, morph, spelling, verified_in_forms, forms_count, count, share_pct, rank, xis.

    forms_count is the count of the made spelling among the attested ones, null where it is not there or not counted. With a
    sign dictionary there are ``glyphs`` too; corpus.form_examples adds a line for each form.

    Without ``cf`` all verbs of the part of speech are answered. The best entry of a citation form and the commonest base of
    an entry are used; null counts are left out.
    """
    for value, known, name in ((polarity, ("affirm", "neg"), "polarity"), (aspect, (None, "hamtu", "maru"), "aspect"), (prefix, (None, *morph.CONJUGATION), "prefix"), (object_person, (None, *morph.OBJECTS), "object_person")):
        if value not in known:
            raise ValueError(f"unknown {name}: {value!r}")
    if unknown := set(dimensional or []) - set(morph.DIMENSIONS):
        raise ValueError(f"unknown dimensional: {sorted(unknown)}")
    entries = corpus["entries"].filter(F.col("pos") == pos)
    if cf is not None:
        entries = entries.filter(F.col("cf") == cf)
    best = F.row_number().over(Window.partitionBy("cf").orderBy(*_desc("icount"), "id"))
    entries = entries.withColumn("_r", best).filter("_r = 1").select(F.col("id").alias("entry_id"), "cf", F.col("icount").alias("whole"))
    rows = corpus["morphology"]
    top = F.row_number().over(Window.partitionBy("entry_id").orderBy(*_desc("icount"), "n"))
    base = rows.filter("kind = 'base'").withColumn("_r", top).filter("_r = 1").select("entry_id", F.col("n").alias("base"))
    template = F.col("n")
    test = morph.matches_features(template, polarity, prefix, dimensional, object_person)
    for asked, present in ((suffix_a, morph.has_nominalizer(template)), (reduplicated, morph.is_reduplicated(template)), (None if aspect is None else aspect == "maru", morph.is_imperfective(template))):
        if asked is not None:
            test = test & (present if asked else ~present)
    found = rows.filter((F.col("kind") == "morph") & (F.col("icount") >= least) & test).join(entries, "entry_id").join(base, "entry_id")
    made = found.withColumn("spelling", morph.synthesize(template, F.col("base")))
    attested = corpus["forms"].groupBy("entry_id", F.col("n").alias("spelling")).agg(F.lit(True).alias("there"), F.max("icount").alias("forms_count"))
    checked = made.join(attested, ["entry_id", "spelling"], "left")
    ranked = top_per_group(checked, ["entry_id"], [F.col("icount").desc(), F.col("n")], limit)
    has_refs = F.col("xis") if "xis" in ranked.columns else F.lit(None).cast("string")
    found = ranked.select(
        F.col("entry_id").alias("oid"), "cf", F.col("n").alias("morph"), "spelling", F.coalesce("there", F.lit(False)).alias("verified_in_forms"), "forms_count",
        F.col("icount").alias("count"), share(F.col("icount"), F.col("whole")).alias("share_pct"), F.col("rank").cast("bigint").alias("rank"), has_refs.alias("xis"),
    )
    return found if glyphs is None else found.withColumn("glyphs", cuneify(F.col("spelling"), glyphs))


def search_entries(corpus: Corpus, query: str) -> DataFrame:
    """Entries that hold a query in citation form, guide word, a spelling, a compound, a sense or the headword; collation order.

    The four child tables give one set of ids, which is semi-joined once.
    """
    needle = query.casefold().strip()
    entries, forms, compounds, senses = corpus["entries"], corpus["forms"], corpus["compounds"], corpus["senses"]

    def ids(df: DataFrame, column: str) -> DataFrame:
        return df.filter(text.contains_like(folded(df, column), needle)).select("entry_id")

    own = entries.filter(text.contains_like(folded(entries, "cf"), needle) | text.contains_like(folded(entries, "gw"), needle) | text.contains_like(F.lower("headword"), needle))
    found = own.select(F.col("id").alias("entry_id")).union(ids(forms, "n")).union(ids(compounds, "xcpd")).union(ids(senses, "mng")).distinct()
    return with_collation(entries.join(found, entries["id"] == found["entry_id"], "left_semi"))


def with_collation(entries: DataFrame) -> DataFrame:
    """Entries with letter and sort_key."""
    return entries.withColumn("letter", collate.first_letter(F.col("cf"))).withColumn("sort_key", collate.sort_key(F.col("cf")))


def entries_under(corpus: Corpus, letter: str) -> DataFrame:
    """Entries whose citation form begins with a letter of the collation, with letter and sort_key."""
    return with_collation(corpus["entries"]).filter(F.col("letter") == letter)


def glossary_page(corpus: Corpus, found: DataFrame, number: int = 1, per_page: int = 25, children: int = 5) -> DataFrame:
    """A page of entries (from search_entries or entries_under) in collation order with their child lists.

    id, cf, gw, pos, icount, total, pages, page, and arrays: spellings and senses by count, periods in their order, at most
    ``children`` of each. A number beyond the last page gives the last. Totals and page are worked out in the plan.
    """
    order = [F.col("sort_key"), F.col("gw").asc_nulls_first(), F.col("id")]
    placed, asked = found.select("id", "cf", "gw", "pos", "icount", "sort_key"), max(1, int(number))
    # the page, or the last one, is among the first number * per_page rows, so no more of them are ranked
    late = placed.orderBy(*order).limit(asked * per_page).withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    late = late.withColumn("total", placed.agg(F.count(F.lit(1))).scalar())
    late = late.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page))).withColumn("page", F.least(F.lit(asked), F.col("pages")))
    begin = (F.col("page") - 1) * per_page
    rows = late.filter((F.col("_place") > begin) & (F.col("_place") <= begin + per_page)).drop("_place", "sort_key")
    ids = rows.select(F.col("id").alias("entry_id"))

    def listed(df: DataFrame, column: str, order: list[Column], name: str) -> DataFrame:
        own = top_per_group(df.join(F.broadcast(ids), "entry_id", "left_semi"), ["entry_id"], order, children)
        return own.groupBy(F.col("entry_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", column))), lambda x: x[column]).alias(name))

    parts = [
        listed(corpus["forms"].filter("n is not null"), "n", [*_desc("icount"), F.col("n"), F.col("id")], "spellings"),
        listed(corpus["senses"].filter("mng is not null and mng <> ''"), "mng", [*_desc("icount"), F.col("id")], "senses"),
        listed(corpus["periods"].filter("p is not null"), "p", [F.col("ord"), F.col("p")], "periods"),
    ]
    return reduce(lambda a, b: a.join(b, "id", "left"), parts, rows)


def entry_detail(corpus: Corpus, oid: str) -> DataFrame:
    """Everything about one entry in a row: its profile with all spellings, normalizations, senses with their signatures, and
    the number of its attestations. No row if there is no such entry; the lines come from corpus.examples."""
    profile = entry_profiles(corpus, [oid], 0)

    def own(name: str, order: list[Column], columns: list[str]) -> DataFrame:
        rows = top_per_group(corpus[name].filter(F.col("entry_id") == oid), ["entry_id"], order, 0)
        listed = F.array_sort(F.collect_list(F.struct("rank", *columns)))
        return rows.groupBy(F.col("entry_id").alias("oid")).agg(F.transform(listed, lambda s: s.dropFields("rank")).alias(name))

    if "norms" in corpus:
        profile = profile.join(own("norms", [*_desc("icount"), F.col("n")], ["n", "icount", "ipct"]), "oid", "left")
    if "sense_sigs" in corpus:
        senses = corpus["senses"].filter(F.col("entry_id") == oid).select(F.col("id").alias("sense_id"))
        sigs = corpus["sense_sigs"].join(F.broadcast(senses), "sense_id", "left_semi")
        each = sigs.groupBy("sense_id").agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("icount", F.lit(0))).alias("down"), "sig", "icount"))).alias("sigs"))
        found = each.agg(F.map_from_entries(F.collect_list(F.struct("sense_id", F.transform("sigs", lambda s: s.dropFields("down"))))).alias("sense_sigs"))
        profile = profile.withColumn("sense_sigs", found.scalar())
    refs = corpus["instances"].filter("word_ref is not null").groupBy(F.col("xis")).agg(F.count(F.lit(1)).alias("attestations"))
    return profile.join(refs, "xis", "left").withColumn("attestations", F.coalesce("attestations", F.lit(0)))


def entries_of_refs(corpus: Corpus, refs: DataFrame, ref: str) -> DataFrame:
    """word_ref, oid, cf, gw, pos: the entries that a word of a text is an attestation of (the way back from a reference)."""
    asked = refs.select(F.col(ref).alias("word_ref")).filter("word_ref is not null").distinct()
    named = corpus["instances"].join(asked, "word_ref", "left_semi").filter("xis is not null").select("word_ref", "xis").distinct()
    head = corpus["entries"].filter("xis is not null").select("xis", F.col("id").alias("oid"), "cf", "gw", "pos")
    return named.join(head, "xis").select("word_ref", "oid", "cf", "gw", "pos")
