"""The core's registered queries: every operator over the delivered tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellgrid.functions import collate, morph, refs, render, text
from tellgrid.operators import dedup, fts, groups, ngrams, paging
from tellgrid.plans import corpus as texts
from tellgrid.plans import integrity, lexicon
from tellgrid.plans.tables import built
from tellgrid.session import load
from tellgrid.sql import oracle_sql  # noqa: F401  (part of the registry)
from tellgrid.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]

#: Glyphs of a small sign list for the rendering query (fixed values).
GLYPHS = {"tuk": "𒋾", "šaše": "𒂍", "d": "𒀭", "ŋeš": "𒄑", "a": "𒀀", "e": "𒂊", "ra": "𒊏", "bi": "𒁉", "ta": "𒋫", "ŋu₁₀": "𒈬", "mu": "𒈬", "na": "𒈾", "ak": "𒀝"}


def _big(*columns: str):
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def meaning_matches(spark: SparkSession, folder: str) -> DataFrame:
    found = lexicon.by_meaning(built(spark, folder), "tarsumic")
    return found.select("oid", "cf", "gw", "pos", "sense", "sense_count", *_big("sense_pct"), "entry_total")


def ranked_substring_search(spark: SparkSession, folder: str) -> DataFrame:
    return paging.paged(meaning_matches(spark, folder), lexicon.meaning_order(), 20, 20)


def search_total_count(spark: SparkSession, folder: str) -> DataFrame:
    return meaning_matches(spark, folder).agg(F.countDistinct("oid").alias("total"))


def entry_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The arrays of every entry's profile, one row per element."""
    profiles = lexicon.entry_profiles(built(spark, folder))
    parts = [
        profiles.select("oid", F.lit("sense").alias("part"), F.posexplode("senses").alias("place", "x")).select("oid", "part", "place", F.col("x.mng").alias("value"), F.col("x.icount").alias("count")),
        profiles.select("oid", F.lit("spelling").alias("part"), F.posexplode("spellings").alias("place", "x")).select("oid", "part", "place", F.col("x.n").alias("value"), F.col("x.icount").alias("count")),
        profiles.select("oid", F.lit("period").alias("part"), F.posexplode("periods").alias("place", "x")).select("oid", "part", "place", F.col("x.p").alias("value"), F.col("x.icount").alias("count")),
        profiles.select("oid", F.lit("compound").alias("part"), F.posexplode("compounds").alias("place", "x")).select("oid", "part", "place", F.col("x.xcpd").alias("value"), F.lit(None).cast("bigint").alias("count")),
    ]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return found.select("oid", "part", *_big("place"), "value", "count")


def compound_two_branch(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.compounds_of(built(spark, folder), "i")


def inflections_capped_per_kind(spark: SparkSession, folder: str) -> DataFrame:
    found = lexicon.inflections(built(spark, folder), 2, 5)
    return found.select("entry_id", "kind", "n", "count", *_big("rank", "total"))


def tagged_union_lookup(spark: SparkSession, folder: str) -> DataFrame:
    corpus = built(spark, folder)
    found = lexicon.analyze(corpus, corpus["words"].select("form"), "form")
    return found.groupBy("matched_in", "spelling").agg(F.count(F.lit(1)).alias("readings"), F.countDistinct("oid").alias("entries"))


def token_gloss(spark: SparkSession, folder: str) -> DataFrame:
    corpus = built(spark, folder)
    found = lexicon.gloss_tokens(corpus, corpus["lines"], ["text_id", "line_id", "ord"], "transliteration")
    return found.groupBy("token", "match_kind", "oid").agg(F.count(F.lit(1)).alias("uses"), F.min("rank").alias("rank"))


def gloss_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Glosses row by row, with the suffix chains of words known as a whole."""
    corpus = built(spark, folder)
    found = lexicon.gloss_tokens(corpus, corpus["lines"], ["text_id", "line_id", "ord"], "transliteration", 1)
    roles = F.coalesce(F.array_join(F.transform("suffixes", lambda x: x["role"]), ","), F.lit("")).alias("roles")
    return found.select("text_id", "line_id", *_big("ord"), "position", "part", "token", "from_word", "match_kind", "base", roles, "oid", "cf")


def phrase_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Roles of every line's words with what they are read from, the skeleton and the notes."""
    corpus = built(spark, folder)
    parsed = lexicon.parse_phrases(corpus, corpus["lines"], ["text_id", "line_id", "ord"], "transliteration")
    blank = F.lit("")
    chunk = lambda c: F.concat_ws("|", c["token"], c["role"], *[F.coalesce(c[f], blank) for f in ("base", "cf", "pos_head", "verbal_prefixes")], F.array_join(F.transform(c["suffixes"], lambda x: x["role"]), ","))
    return parsed.select("text_id", "line_id", *_big("ord"), "skeleton", F.array_join(F.transform("chunks", chunk), " / ").alias("chunks"), F.array_join("notes", " / ").alias("notes"))


def unigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    words = built(spark, folder)["words"]
    seq = ngrams.sequences(words, ["text_id", "line_id"], "word_pos", "lemma")
    return seq.select(F.explode("items").alias("cf")).groupBy("cf").agg(F.count(F.lit(1)).alias("count"))


def _grams(n: int) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        words = dedup.first_wins(built(spark, folder)["words"], ["text_id", "line_id", "word_pos"], ["lemma", "form"])
        return ngrams.ngram_counts(words, ["text_id", "line_id"], "word_pos", "lemma", n, 2 if n > 2 else 3)

    return run


def feature_ngram_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Feature-annotated n-grams of every length keyed by their slots: the key the table has is the one its columns give."""
    rows = load(spark, folder, "inflected_ngrams").distinct()
    key = F.coalesce(*[F.when(F.col("n") == n, ngrams.encode_slots(texts.pattern.slots_of(rows, n))) for n in (2, 3, 4)])
    return rows.groupBy(*_big("n"), (key == F.col("ngram")).alias("same")).agg(F.count(F.lit(1)).alias("rows"))


def feature_ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    """N-grams of two to four annotated words (lemma, gloss, part of speech, outermost case of the spelling) within a line, two uses or more."""
    words = dedup.first_wins(built(spark, folder)["words"].filter("lemma <> ''"), ["text_id", "line_id", "word_pos"], ["lemma", "form"])
    case = morph.outermost_case(morph.peel_suffixes(F.col("form"))["suffixes"])
    slot = ngrams.encode_slots(F.array(F.struct(F.col("lemma").alias("cf"), F.col("label").alias("gw"), "pos", case.alias("case"))))
    words = words.select("text_id", "line_id", "word_pos", slot.alias("slot"))
    found = [ngrams.ngram_counts(words, ["text_id", "line_id"], "word_pos", "slot", n, 2, "\t") for n in (2, 3, 4)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def event_type_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").withColumn("at", F.struct("ts", "event_id"))
    return ngrams.ngram_counts(events, ["user_id"], "at", "event_type", 3)


def collocation_any_slot(spark: SparkSession, folder: str) -> DataFrame:
    found = texts.collocations_of(built(spark, folder), "tuk")
    return found.select(*_big("n"), "ngram", "count")


def phrase_pattern_pos_case(spark: SparkSession, folder: str) -> DataFrame:
    found = texts.phrase_pattern(built(spark, folder), ["N:locative", "V*"])
    return found.select("ngram", "count", "key")


def phrase_pattern_negated_null(spark: SparkSession, folder: str) -> DataFrame:
    found = texts.phrase_pattern(built(spark, folder), ["N[!king]", "*:!ergative", "*:absolutive"])
    return found.select("ngram", "count", "key")


def phrase_pattern_plain(spark: SparkSession, folder: str) -> DataFrame:
    corpus = built(spark, folder).without("inflected_ngrams")
    found = texts.phrase_pattern(corpus, ["N", "V*"])
    return found.select("ngram", "count", F.col("tokens")[0]["pos"].alias("pos1"), F.col("tokens")[0]["gw"].alias("gw1"), F.col("tokens")[1]["pos"].alias("pos2"))


def feature_spec_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = built(spark, folder)["morphology"].filter("kind = 'morph'")
    found = rows.filter(morph.matches_features(F.col("n"), prefix="mu", dimensional=["dat"]))
    return found.select("entry_id", "n", "icount")


def verb_form_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.verb_forms(built(spark, folder), pos="V/t", prefix="mu", aspect="maru", limit=3).drop("xis")


def suffix_peel(spark: SparkSession, folder: str) -> DataFrame:
    forms = built(spark, folder)["words"].filter("form is not null").select("form").distinct()
    peeled = forms.select("form", morph.peel_suffixes(F.col("form")).alias("p"))
    return peeled.select("form", "p.base", F.array_join(F.transform("p.suffixes", lambda s: s["role"]), ",").alias("roles"), morph.outermost_case(F.col("p.suffixes")).alias("case"))


def verb_prefix_chains(spark: SparkSession, folder: str) -> DataFrame:
    forms = built(spark, folder)["words"].filter("form is not null").select("form").distinct()
    return forms.groupBy(morph.verbal_prefixes(F.col("form")).alias("chain")).agg(F.count(F.lit(1)).alias("forms"))


def fts_bm25_top(spark: SparkSession, folder: str) -> DataFrame:
    index = texts.index_translations(built(spark, folder), stemmed=False)
    return fts.search(index, "king temple").select("doc", F.round("score", 6).alias("score"))


def fts_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    index = texts.index_translations(built(spark, folder), stemmed=True)
    return fts.search(index, "(rivers OR canals) AND brought").select("doc", F.round("score", 6).alias("score"))


def fts_boolean(spark: SparkSession, folder: str) -> DataFrame:
    index = texts.index_translations(built(spark, folder), stemmed=False)
    return fts.search(index, "(river OR canal) AND king NOT temple").select("doc")


def fts_phrase(spark: SparkSession, folder: str) -> DataFrame:
    index = texts.index_translations(built(spark, folder), stemmed=False)
    return fts.search(index, '"the river"').select("doc")


def fts_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return fts.search(texts.index_lines(built(spark, folder)), "tu*").select("doc")


def lemma_lines_join(spark: SparkSession, folder: str) -> DataFrame:
    found = texts.lines_with_lemma(built(spark, folder))
    return found.select("text_id", "line_id", *_big("word_pos", "ord"), "form", "lemma", "line_label", "transliteration", "translation")


def block_islands(spark: SparkSession, folder: str) -> DataFrame:
    found = texts.text_blocks(built(spark, folder))
    return found.select("text_id", "island", "paragraph_id", *_big("first_ord", "last_ord"), "lines")


def paragraph_texts(spark: SparkSession, folder: str) -> DataFrame:
    return texts.paragraph_lines(built(spark, folder))


def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows, _ = paging.keyset_page(orders, "o_orderkey", 1000, 50)
    return rows


def catalogue_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = texts.artifacts_page(built(spark, folder), period="TARSUMIC", genre="admin", language=None, provenience=" ")
    return found.select("p_id", "cdli_id", "period", "genre", "artifact_url", "photo_url", "lineart_thumb_url")


def artifact_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = texts.artifacts_page(built(spark, folder))
    return rows.select("p_id", texts.artifact_markdown(rows).alias("markdown"))


def pid_normalize(spark: SparkSession, folder: str) -> DataFrame:
    ids = load(spark, folder, "text_locations").select("text_id").distinct()
    return ids.select("text_id", text.normalize_p_id(F.col("text_id")).alias("p_id"), text.format_p_id(F.substring("text_id", 2, 20)).alias("plain"))


def existence_or_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.search_entries(built(spark, folder), "ruin").select("id", "cf", "gw")


def collation_sort_page(spark: SparkSession, folder: str) -> DataFrame:
    entries = lexicon.with_collation(built(spark, folder)["entries"]).select("id", "cf", "gw", "letter", "sort_key")
    rows, _, _ = paging.numbered_page(entries, [F.col("sort_key"), F.col("gw"), F.col("id")], 2)
    return rows


def collation_keys(spark: SparkSession, folder: str) -> DataFrame:
    entries = built(spark, folder)["entries"]
    return entries.select("id", collate.first_letter(F.col("cf")).alias("letter"), collate.sort_key(F.col("cf")).alias("sort_key"))


def dedup_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = dedup.first_wins(load(spark, folder, "text_locations"), ["project", "text_id"], ["loaded_at", "zip_path", "designation", "period"])
    return rows.select("project", "text_id", "period", "designation")


def dedup_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = dedup.last_wins(load(spark, folder, "artifacts").filter("removed_at is null"), ["p_id"], ["loaded_at", "designation", "period"])
    return rows.select("p_id", "cdli_id", "designation", "period")


def ref_resolve_enrich(spark: SparkSession, folder: str) -> DataFrame:
    return texts.attestations(built(spark, folder), 3)


def attestations_of_period(spark: SparkSession, folder: str) -> DataFrame:
    return texts.attestations(built(spark, folder), 2, "belethian").select("oid", "rank", "word_ref", "period")


def unresolved_by_project(spark: SparkSession, folder: str) -> DataFrame:
    """References per project that name no located text, and those that cannot be read."""
    corpus = built(spark, folder)
    ref = refs.parse_word_ref(F.col("word_ref"))
    read = corpus["instances"].filter("word_ref is not null").withColumn("r", ref).select("r.project", "r.text_id", F.col("r").isNull().alias("unread"))
    known = corpus["text_locations"].select("project", "text_id", F.lit(True).alias("known"))
    both = read.join(known, ["project", "text_id"], "left")
    lost = F.when(F.col("known").isNull(), 1).otherwise(0)
    return both.groupBy("project").agg(F.count(F.lit(1)).alias("refs"), F.sum(lost).alias("lost"))


def json_extract_flatten(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    parsed = events.select("event_id", "event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))
    return parsed.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))


def strip_markup(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(text.strip_markup(F.col("text"))).alias("digest"))


def sign_rendering(spark: SparkSession, folder: str) -> DataFrame:
    forms = built(spark, folder)["forms"].filter("n is not null").select("n").distinct()
    shown = forms.select("n", render.cuneify(F.col("n"), GLYPHS).alias("glyphs"))
    return shown.select("n", "glyphs", render.placeholder_count(F.col("glyphs")).cast("bigint").alias("missing"))


def first_wins_map(spark: SparkSession, folder: str) -> DataFrame:
    return groups.first_of(load(spark, folder, "part"), "p_brand", "p_name", "p_partkey")


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return texts.table_counts(built(spark, folder))


def gap_report_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return texts.located_texts(built(spark, folder)).groupBy("bucket").agg(F.count(F.lit(1)).alias("texts"))


def share_pct(spark: SparkSession, folder: str) -> DataFrame:
    counted = load(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    whole = load(spark, folder, "lineitem").count()
    return counted.select("l_returnflag", "l_linestatus", "n", groups.share(F.col("n"), F.lit(whole)).alias("pct"))


def spelling_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Subscripts, parts and normal forms of every distinct spelling."""
    forms = built(spark, folder)["words"].filter("form is not null").select("form").distinct()
    value = F.col("form")
    return forms.select(
        "form", text.strip_subscripts(value).alias("bare"), text.digits_to_subscripts(value).alias("lowered"), F.size(text.pieces(value)).cast("bigint").alias("pieces"),
        F.substring_index("form", "-", 1).alias("head"), F.array_join(text.tokens(value), " ").alias("tokens"), text.blank_to_null(value).alias("trimmed"),
    )


def tumbling_window(spark: SparkSession, folder: str) -> DataFrame:
    return stream.tumbling(load(spark, folder, "events"), "1 hour").select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_window(spark: SparkSession, folder: str) -> DataFrame:
    return stream.sessions(load(spark, folder, "events"), "30 minutes").select("user_id", F.col("start").cast("string").alias("start"), "n")


def normalized_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Source spellings and typed queries in the usual letters, for every spelling, designation, line name and made-up mixture."""
    corpus = built(spark, folder)
    words, lines = corpus["words"], corpus["lines"]
    parts = [words.select(F.col("form").alias("value")), corpus["text_locations"].select("designation"), lines.select("line_id"), words.select(F.concat("lemma", F.lit("12a₂3"), "line_id"))]
    values = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).filter("value is not null").distinct()
    return values.select("value", text.normalize_translit(F.col("value")).alias("source"), text.normalize_query(F.col("value")).alias("typed"))


def search_page(spark: SparkSession, folder: str) -> DataFrame:
    found = texts.search_translations(built(spark, folder), "king temple", 10, 5, stemmed=False)
    count = F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("lines")
    return found.select("text_id", "para_id", "line_range", "translation", F.round("score", 6).alias("score"), count, "markdown", "total", "next_offset")


def line_search_page(spark: SparkSession, folder: str) -> DataFrame:
    found = texts.search_lines(built(spark, folder), "tuk OR lip*", 20, 0)
    return found.select("text_id", "line_id", "line", "transliteration", "translation", "markdown", F.round("score", 6).alias("score"), "total", "next_offset")


def lemma_page(spark: SparkSession, folder: str) -> DataFrame:
    found = texts.lemma_page(built(spark, folder), "tuk", 25, 25)
    return found.select("text_id", "line", *_big("ord", "word_pos"), "transliteration", "translation", "markdown", "total", "next_offset")


def compound_page(spark: SparkSession, folder: str) -> DataFrame:
    return paging.paged(lexicon.compounds_of(built(spark, folder), "i").withColumnRenamed("total", "count"), [F.col("count").desc_nulls_last(), "branch", "oid"], 20, 10)


def catalogue_page(spark: SparkSession, folder: str) -> DataFrame:
    found = texts.artifacts_page(built(spark, folder), genre="admin").select("p_id", "cdli_id", "period", "genre")
    return paging.paged(found, [F.col("p_id")], 25, 50)


def collocation_page(spark: SparkSession, folder: str) -> DataFrame:
    found = texts.collocations_of(built(spark, folder), "tuk").select(*_big("n"), "ngram", "count")
    return paging.paged(found, [F.col("count").desc_nulls_last(), F.col("ngram")], 30, 0)


def collocation_by_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """A spelling that is no citation form is resolved to those it may stand for."""
    return texts.collocations_of(built(spark, folder), "tuk-ra").select(*_big("n"), "ngram", "count", "resolved_from")


def analysis_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of every attested spelling, over all places it is known from, and the kind of place that comes first."""
    corpus = built(spark, folder)
    found = lexicon.analyze(corpus, corpus["words"].select("form"), "form")
    return found.groupBy("spelling").agg(F.max("total").alias("total"), F.min(F.when(F.col("matched_in") == "forms", "1 dictionary").otherwise("2 morphology")).alias("first"))


def glossary_list(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of a letter, with the child lists of its entries."""
    corpus = built(spark, folder)
    rows = lexicon.glossary_page(corpus, lexicon.entries_under(corpus, "K"), 2)
    lists = [F.array_join(c, "; ").alias(c) for c in ("spellings", "senses", "periods")]
    return rows.select("id", "cf", "gw", "pos", "icount", "total", *_big("pages", "page"), *lists)


def reverse_references(spark: SparkSession, folder: str) -> DataFrame:
    """Entries behind every reference, and references per entry."""
    corpus = built(spark, folder)
    found = lexicon.entries_of_refs(corpus, corpus["instances"], "word_ref")
    return found.groupBy("oid").agg(F.count(F.lit(1)).alias("refs"), F.min("word_ref").alias("first"))


def unresolved_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries whose references all lead nowhere, with the projects they name most."""
    return texts.unresolved(built(spark, folder))


def catalogue_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue row by its id as typed, without P."""
    found = texts.artifact(built(spark, folder), " 100709 ")
    return found.select("p_id", "cdli_id", "designation", "period", "artifact_url", "photo_url")


def line_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of line names, numbers that ranges begin with, fields that are there."""
    corpus = built(spark, folder)
    labels = corpus["lines"].select(F.lit("label").alias("what"), F.col("line_id").alias("given"), text.line_label(F.col("line_id"), F.col("line_label")).alias("got"))
    numbers = corpus["paragraphs"].select(F.lit("number").alias("what"), F.col("line_range").alias("given"), text.leading_number(F.col("line_range")).cast("string").alias("got"))
    there = corpus["artifacts"].select(F.lit("there").alias("what"), F.col("museum_no").alias("given"), text.has_scan(F.col("museum_no")).cast("string").alias("got"))
    return labels.unionByName(numbers).unionByName(there).distinct()


_HERE = [
    ranked_substring_search, meaning_matches, search_total_count, entry_profile, compound_two_branch, inflections_capped_per_kind, tagged_union_lookup,
    token_gloss, phrase_roles, unigram_counts, feature_ngram_keys, event_type_ngrams, collocation_any_slot, phrase_pattern_pos_case,
    phrase_pattern_negated_null, phrase_pattern_plain, feature_spec_match, verb_form_search, suffix_peel, verb_prefix_chains, fts_bm25_top, fts_stemmed,
    fts_boolean, fts_phrase, fts_prefix, lemma_lines_join, block_islands, paragraph_texts, keyset_page, catalogue_filter, artifact_blocks, pid_normalize,
    existence_or_search, collation_sort_page, collation_keys, dedup_first_wins, dedup_last_wins, ref_resolve_enrich, attestations_of_period,
    unresolved_by_project, json_extract_flatten, strip_markup, sign_rendering, first_wins_map, corpus_stats, gap_report_buckets, share_pct,
    spelling_functions, tumbling_window, session_window, gloss_rows, feature_ngram_counts, normalized_spellings, search_page, line_search_page, compound_page,
    catalogue_page, collocation_page, collocation_by_spelling, analysis_totals, glossary_list, reverse_references, unresolved_entries, catalogue_lookup,
    line_functions, lemma_page,
]


def queries() -> dict[str, Query]:
    named = {f.__name__: f for f in _HERE}
    counted = {"bigram_counts": _grams(2), "trigram_counts": _grams(3), "fourgram_counts": _grams(4)}
    return named | counted | {"p3_found": integrity.orphans_found, "p3_per_month": integrity.orphans_per_month}
