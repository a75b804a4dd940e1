"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellgrid.llm import alignment, canonical, cooccurrence, lookalikes, packing, stuffing, suffix_counts, tokens, topn
from tellgrid.session import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    words = load(spark, folder, "words")
    lines = cooccurrence.associated_pairs(words, ["text_id", "line_id"], "lemma", 5, 4)
    grams = load(spark, folder, "collocations").filter("n = 2").distinct()
    beside = cooccurrence.adjacent_pairs(grams, "cf1", "cf2", "count", 20, 4)
    named = [F.col("a").alias("lemma_a"), F.col("b").alias("lemma_b")]
    return lines.select(F.lit("words").alias("src"), *named).unionByName(beside.select(F.lit("collocations").alias("src"), *named))


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The qualifying pairs of lines with their counts and lift."""
    found = cooccurrence.associated_pairs(load(spark, folder, "words"), ["text_id", "line_id"], "lemma", 5, 4)
    return found.select("a", "b", "together", "records_a", "records_b", "baskets", F.round("lift", 6).alias("lift"))


#: Words that tell periods of one name apart, and words that say nothing about which period is meant (fixed values).
PERIOD_QUALIFIERS = frozenset("early late later old older middle neo new proto post pre transitional".split())
PERIOD_FILLERS = frozenset("period periods per age era time the probably prob possibly perhaps maybe likely presumably ca c circa approx bc bce".split())


def _typed_periods(spark: SparkSession, folder: str) -> DataFrame:
    """src, k1, k2, period of every record whose period is not character for character a listed name."""
    nothing = F.lit("")
    rows = (
        load(spark, folder, "artifacts").select(F.lit("artifacts").alias("src"), F.col("p_id").alias("k1"), nothing.alias("k2"), "period")
    ).unionByName(
        load(spark, folder, "text_locations").select(F.lit("text_locations").alias("src"), F.col("project").alias("k1"), F.col("text_id").alias("k2"), "period")
    )
    ordinals = F.col("ord").cast("string").alias("k2")
    rows = rows.unionByName(
        load(spark, folder, "periods").select(F.lit("periods").alias("src"), F.col("entry_id").alias("k1"), ordinals, F.col("p").alias("period"))
    )
    listed = load(spark, folder, "period_list").select(F.col("name").alias("period")).filter("period is not null").distinct()
    return rows.filter("period is not null").join(listed, "period", "left_anti").select("src", "k1", "k2", "period")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    reference = load(spark, folder, "period_list")
    found = canonical.match_values(_typed_periods(spark, folder), "period", reference, "period_id", "name", "period_id", qualifiers=PERIOD_QUALIFIERS, fillers=PERIOD_FILLERS)
    return found.select("src", "k1", "k2", "period_id").distinct()


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The typed values that mean no listed period, or several, with their records."""
    reference = load(spark, folder, "period_list")
    found = canonical.match_values(_typed_periods(spark, folder).distinct(), "period", reference, "period_id", "name", "period_id", qualifiers=PERIOD_QUALIFIERS, fillers=PERIOD_FILLERS)
    return found.filter("period_id = 0").groupBy("period").agg(F.count(F.lit(1)).alias("records"))


def _spellings(spark: SparkSession, folder: str) -> DataFrame:
    blank = F.lit("")
    key = F.concat_ws("|", F.coalesce("text_id", blank), F.coalesce("line_id", blank), F.coalesce(F.col("word_pos").cast("string"), blank))
    entries = load(spark, folder, "entries").select(F.lit("entries.cf").alias("field"), F.col("id").alias("row_key"), F.col("cf").alias("value"))
    forms = load(spark, folder, "forms").select(F.lit("forms.n").alias("field"), F.col("id").alias("row_key"), F.col("n").alias("value"))
    words = load(spark, folder, "words").select(F.lit("words.form").alias("field"), key.alias("row_key"), F.col("form").alias("value"))
    return entries.unionByName(forms).unionByName(words)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.consistent_form(_spellings(spark, folder), "value").select("field", "row_key").distinct()


def p4_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every uneven spelling with its consistent form."""
    return lookalikes.consistent_form(_spellings(spark, folder), "value").select("field", "row_key", "value", "canonical").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    grams = load(spark, folder, "inflected_ngrams").select("n", "ngram", "cf1", "count", "loaded_at")
    valid = topn.latest_valid(grams, ["n", "ngram"], "loaded_at", ["count", "cf1"])
    return topn.top_n_per_group(valid, "cf1", "count", ["n", "ngram"], 5).select("cf1", "n", "ngram")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "text_lines").select(
        F.col("text_id").alias("text"), F.col("line_id").alias("line"), F.col("ord").alias("place"), F.col("line_label").alias("label"), F.col("paragraph_id").alias("para")
    )
    paragraphs = load(spark, folder, "paragraphs").select(
        F.col("text_id").alias("text"), F.col("para_id").alias("para"), F.col("line_range").alias("range"), "translation"
    )
    tokens = alignment.source_tokens(load(spark, folder, "words"), "text_id", "line_id", "word_pos", "lemma", "form", "label", hashed=True)
    pairs = alignment.align(lines, tokens, paragraphs)
    return pairs.select(F.col("text").alias("text_id"), F.col("line").alias("line_id"), F.col("para").alias("para_id"), F.col("sent").alias("sent_no"))


def _marked(counts: DataFrame, field: str, measure: str, rare_at_most: int, common_times: int, whole: int) -> DataFrame:
    amount = F.col(measure)
    mark = F.when(amount <= rare_at_most, "rare").when(amount.cast("decimal(38,0)") * common_times > whole, "common")
    return counts.select(F.lit(field).alias("field"), F.col("gram")[0].alias("term"), mark.alias("mark")).filter("mark is not null")


def _lemma_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    words = load(spark, folder, "words").select("text_id", "line_id", "word_pos", "lemma").distinct()
    return suffix_counts.suffixes_of_rows(words, ["text_id", "line_id"], "lemma")


#: Terms of the longest n-gram of ``collocations``; every run within one is counted, and the terms are the runs of one.
RUN = 4


def _gram_runs(spark: SparkSession, folder: str) -> DataFrame:
    """gram, occurrences, records of every run of terms within an n-gram."""
    grams = load(spark, folder, "collocations").filter("ngram is not null").select("n", "ngram").distinct()
    return suffix_counts.count_prefixes(suffix_counts.suffixes_of_arrays(grams.withColumn("terms", F.split("ngram", " ")), "terms", RUN), RUN)


def _unigram_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    batches = load(spark, folder, "unigrams").distinct().filter("cf is not null and cf <> ''")
    return batches.select(F.array("cf").alias("suffix"), F.lit(1).alias("fresh"), F.col("count").alias("weight"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    words = load(spark, folder, "words").filter("lemma is not null and lemma <> ''").select("text_id", "line_id").distinct().count()
    grams = load(spark, folder, "collocations").filter("ngram is not null").select("n", "ngram").distinct().count()
    total = load(spark, folder, "unigrams").distinct().agg(F.sum("count")).first()[0] or 0
    lemmas = suffix_counts.count_prefixes(_lemma_suffixes(spark, folder), 1)
    heads = suffix_counts.count_prefixes(_unigram_suffixes(spark, folder), 1)
    terms = _gram_runs(spark, folder).filter(F.size("gram") == 1)
    return (
        _marked(lemmas, "words.lemma", "records", 2, 50, words)
        .unionByName(_marked(heads, "unigrams.cf", "occurrences", 5, 200, total))
        .unionByName(_marked(terms, "collocations.ngram", "records", 1, 50, grams))
    )


def p7_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of the three fields with its occurrences and records."""
    parts = (
        ("words.lemma", suffix_counts.count_prefixes(_lemma_suffixes(spark, folder), 1)),
        ("unigrams.cf", suffix_counts.count_prefixes(_unigram_suffixes(spark, folder), 1)),
        ("collocations.ngram", _gram_runs(spark, folder).filter(F.size("gram") == 1)),
    )
    found = [counted.select(F.lit(field).alias("field"), F.col("gram")[0].alias("term"), "occurrences", "records") for field, counted in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p7_gram_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of one to four terms within the n-grams of ``collocations``, with its occurrences and n-grams."""
    return _gram_runs(spark, folder).select(F.size("gram").cast("bigint").alias("n"), F.concat_ws(" ", "gram").alias("gram"), "occurrences", "records")


def p7_line_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of one to three lemmas within a line, with its occurrences and lines."""
    words = load(spark, folder, "words").select("text_id", "line_id", "word_pos", "lemma").distinct()
    suffixes = suffix_counts.suffixes_of_rows(words, ["text_id", "line_id"], "lemma", "word_pos", 3)
    counted = suffix_counts.count_prefixes(suffixes, 3)
    return counted.select(F.size("gram").cast("bigint").alias("n"), F.concat_ws(" ", "gram").alias("gram"), "occurrences", "records")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(load(spark, folder, "documents"), "doc_id", "text")


#: Tokens a container of problem 9 holds.
CONTAINER = 2048


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, piece, tokens, container; a document over the capacity has several pieces, an empty one no container."""
    counts = tokens.encode_corpus(load(spark, folder, "documents"), "doc_id", "text", count_only=True)
    return packing.pack(counts, "doc_id", "ids", CONTAINER).withColumnRenamed("size", "tokens")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed_pages(load(spark, folder, "documents"), "doc_id", "text").select("doc_id").distinct()


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_scores": p1_scores,
        "p2_found": p2_found,
        "p2_unmatched": p2_unmatched,
        "p4_found": p4_found,
        "p4_canonical": p4_canonical,
        "p5_found": p5_found,
        "p8_ids": p8_ids,
        "p9_containers": p9_containers,
        "p10_found": p10_found,
        "p6_found": p6_found,
        "p7_found": p7_found,
        "p7_terms": p7_terms,
        "p7_line_ngrams": p7_line_ngrams,
        "p7_gram_runs": p7_gram_runs,
    }
