"""Texts, attestations, phrases, catalogue, signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellgrid.functions.refs import parse_word_ref
from tellgrid.functions.text import SUBSCRIPTS, joined, normalize_p_id
from tellgrid.operators import filters, fts, groups, pattern
from tellgrid.operators.dedup import first_wins
from tellgrid.operators.paging import paged
from tellgrid.plans import lexicon
from tellgrid.plans.tables import Corpus

#: Where the catalogue's public pages live (a parameter of every function that builds addresses).
CATALOGUE = "https://cdli.earth"


def asset_urls(p_id: Column, cdli_id: Column, photo: Column, lineart: Column, base: str = CATALOGUE) -> dict[str, Column]:
    """Addresses of an artifact's page and pictures; a picture that does not exist has none."""
    return {
        "artifact_url": F.concat(F.lit(f"{base}/artifacts/"), cdli_id.cast("string")),
        "photo_url": F.when(photo == 1, F.concat(F.lit(f"{base}/dl/photo/"), p_id, F.lit(".jpg"))),
        "photo_thumb_url": F.when(photo == 1, F.concat(F.lit(f"{base}/dl/tn_photo/"), p_id, F.lit(".jpg"))),
        "lineart_url": F.when(lineart == 1, F.concat(F.lit(f"{base}/dl/lineart/"), p_id, F.lit("_l.jpg"))),
        "lineart_thumb_url": F.when(lineart == 1, F.concat(F.lit(f"{base}/dl/tn_lineart/"), p_id, F.lit("_l.jpg"))),
    }


def artifacts_page(corpus: Corpus, base: str = CATALOGUE, **asked: str | None) -> DataFrame:
    """Catalogue rows that hold all asked substrings (provenience, period, museum_collection, genre, language, subgenre)."""
    known = {"provenience", "period", "museum_collection", "genre", "language", "subgenre"}
    if unknown := set(asked) - known:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    rows = filters.all_of(corpus["artifacts"], asked)
    urls = asset_urls(F.col("p_id"), F.col("cdli_id"), F.col("has_photo"), F.col("has_lineart"), base)
    return rows.select("*", *[c.alias(n) for n, c in urls.items()])


def artifact(corpus: Corpus, p_id: str, base: str = CATALOGUE) -> DataFrame:
    """The catalogue row of a typed id (with or without P); no row if there is none."""
    asked = corpus["artifacts"].sparkSession.createDataFrame([(p_id,)], "asked string").select(normalize_p_id(F.col("asked")).alias("p_id"))
    return artifacts_page(corpus, base).join(F.broadcast(asked), "p_id", "left_semi")


def artifact_markdown(row: DataFrame, source: str = "catalogue") -> Column:
    """One block per artifact: a link with its label, then museum, number and period, empty parts left out."""
    label = F.coalesce(F.nullif("designation", F.lit("")), F.col("p_id"))
    about = joined(" · ", F.col("museum_collection"), F.col("museum_no"), F.col("period"))
    return F.concat(
        F.lit("["), label, F.lit(" ("), F.col("p_id"), F.lit(")]("), F.col("artifact_url"), F.lit(")"),
        F.when(about != "", F.concat(F.lit(" — "), about)).otherwise(""), F.lit(f"\n<sub>— {source}</sub>"),
    )


def attestations(corpus: Corpus, per_entry: int = 3, period: str | None = None, oids: list[str] | None = None) -> DataFrame:
    """The first attested lines of every entry, in the byte order of their references, with text and catalogue data.

    oid, rank, word_ref, project, text_id, line_label, period, designation, museum_collection, museum_no. A line counts once
    per entry. With ``period`` only texts whose period name holds it (case folded) are kept, before the limit.
    """
    entries = corpus["entries"].select(F.col("id").alias("oid"), "xis").filter("xis is not null")
    if oids is not None:
        entries = entries.filter(F.col("oid").isin(oids))
    ref = parse_word_ref(F.col("word_ref"))
    instances = corpus["instances"].filter("word_ref is not null")
    if oids is not None:
        instances = instances.join(entries.select("xis"), "xis", "left_semi")
    refs = instances.withColumn("_r", ref).filter("_r is not null")
    refs = refs.select("xis", "word_ref", "_r.project", "_r.text_id", F.col("_r.line").alias("line_label"))
    texts = corpus["text_locations"].select("project", "text_id", "period", "designation")
    if period is not None:
        names = filters.period_names(texts, "period", period)
        texts = texts.join(names, texts["period"] == names["_name"], "left_semi")
        refs = refs.join(texts, ["project", "text_id"], "left_semi")
    lines = refs.groupBy("xis", "project", "text_id", "line_label").agg(F.min("word_ref").alias("word_ref"))
    rank = F.row_number().over(Window.partitionBy("xis").orderBy("word_ref"))
    top = lines.withColumn("rank", rank).filter(F.col("rank") <= per_entry)
    found = entries.join(top, "xis").join(texts, ["project", "text_id"], "left")
    dated = corpus["artifacts"].select(F.col("p_id").alias("text_id"), "museum_collection", "museum_no")
    full = found.join(dated, "text_id", "left")
    return full.select("oid", F.col("rank").cast("bigint").alias("rank"), "word_ref", "project", "text_id", "line_label", "period", "designation", "museum_collection", "museum_no")


def examples(corpus: Corpus, per_entry: int = 3, period: str | None = None, oids: list[str] | None = None, base: str = CATALOGUE, citations: tuple[str, str] = ("dictionary", "catalogue")) -> DataFrame:
    """Attested lines as they read: attestations with transliteration, target (the word itself), target_position, the
    artifact's addresses and a quotation in markdown.

    A line of a text that is not at hand has none of these. Needs ``corpus_words`` (project, text_id, line, position, frag, ref).
    """
    found = attestations(corpus, per_entry, period, oids)
    lines = resolve_lines(corpus["corpus_words"], found, "word_ref").withColumnRenamed("line", "line_label").drop("asked")
    lines = lines.withColumn("target", F.get(F.col("frags"), F.col("target_position")))
    shown = corpus["artifacts"].select(F.col("p_id").alias("text_id"), "cdli_id", "has_photo", "has_lineart")
    both = found.join(lines, ["project", "text_id", "line_label"], "left").join(shown, "text_id", "left")
    urls = asset_urls(F.col("text_id"), F.col("cdli_id"), F.col("has_photo"), F.col("has_lineart"), base)
    both = both.select(*found.columns, "transliteration", "target", "target_position", *[c.alias(n) for n, c in urls.items()])
    return both.withColumn("markdown", attestation_markdown(*citations))


def form_examples(corpus: Corpus, forms: DataFrame, base: str = CATALOGUE, citations: tuple[str, str] = ("dictionary", "catalogue")) -> DataFrame:
    """``forms`` (with xis) and the first line at hand that attests each: word_ref, transliteration, target, target_position,
    period, designation, markdown; null where there is none."""
    refs = corpus["instances"].join(forms.select("xis").distinct(), "xis", "left_semi").filter("word_ref is not null")
    lines = resolve_lines(corpus["corpus_words"], refs, "word_ref")
    read = refs.withColumn("r", parse_word_ref(F.col("word_ref"))).filter("r is not null").select("xis", "word_ref", "r.project", "r.text_id", "r.line")
    own = read.join(lines.drop("asked"), ["project", "text_id", "line"])
    first = own.groupBy("xis").agg(F.min(F.struct("word_ref", "project", "text_id", F.col("line").alias("line_label"), "transliteration", "target_position", "frags")).alias("e")).select("xis", "e.*")
    texts = corpus["text_locations"].select("project", "text_id", "period", "designation")
    shown = corpus["artifacts"].select(F.col("p_id").alias("text_id"), "cdli_id", "has_photo", "has_lineart", "museum_collection", "museum_no")
    full = first.join(texts, ["project", "text_id"], "left").join(shown, "text_id", "left").withColumn("target", F.get("frags", F.col("target_position")))
    url = asset_urls(F.col("text_id"), F.col("cdli_id"), F.col("has_photo"), F.col("has_lineart"), base)["artifact_url"]
    full = full.withColumn("artifact_url", url).withColumn("markdown", attestation_markdown(*citations))
    return forms.join(full.select("xis", "word_ref", "transliteration", "target", "target_position", "period", "designation", "markdown"), "xis", "left")


def unresolved(corpus: Corpus, oids: list[str] | None = None, top: int = 3) -> DataFrame:
    """oid, refs, p_refs, q_refs, projects for entries none of whose references leads to a located text.

    projects are the ``top`` projects named most, with their counts; p_refs and q_refs count references by kind of text id.
    """
    entries = corpus["entries"].select(F.col("id").alias("oid"), "xis").filter("xis is not null")
    if oids is not None:
        entries = entries.filter(F.col("oid").isin(oids))
    read = corpus["instances"].filter("word_ref is not null").withColumn("_r", parse_word_ref(F.col("word_ref"))).filter("_r is not null")
    read = read.select("xis", "_r.project", "_r.text_id").groupBy("xis", "project", "text_id").agg(F.count(F.lit(1)).alias("n"))
    known = corpus["text_locations"].select("project", "text_id", F.lit(1).alias("known")).distinct()
    both = read.join(known, ["project", "text_id"], "left")
    kind = F.substring("text_id", 1, 1)
    per = both.groupBy("xis", "project").agg(
        F.sum("n").alias("n"), F.sum(F.when(kind == "P", F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(kind == "Q", F.col("n")).otherwise(0)).alias("q"), F.count("known").alias("known")
    )
    whole = per.groupBy("xis").agg(
        F.sum("n").alias("refs"), F.sum("p").alias("p_refs"), F.sum("q").alias("q_refs"), F.sum("known").alias("known"),
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), "project", "n"))), 1, top).alias("all"),
    ).filter("known = 0")
    projects = F.transform("all", lambda p: F.concat(p["project"], F.lit(" ("), p["n"].cast("string"), F.lit(")")))
    return entries.join(whole, "xis").select("oid", "refs", "p_refs", "q_refs", F.array_join(projects, ", ").alias("projects"))


def resolve_lines(words: DataFrame, refs: DataFrame, ref: str) -> DataFrame:
    """Lines that references point at: project, text_id, line, transliteration, target_position; a line comes out once.

    ``words`` has project, text_id, line, position, frag, ref (of the word or line node), flattened from the documents.
    """
    wanted = refs.select(parse_word_ref(F.col(ref)).alias("r"), F.col(ref).alias("asked")).filter("r is not null")
    wanted = wanted.select("r.project", "r.text_id", "r.line", "asked", F.concat_ws(".", "r.text_id", "r.line", "r.word").alias("_target"))
    once = first_wins(wanted, ["project", "text_id", "line"], ["asked"])
    pieces = words.join(once, ["project", "text_id", "line"])
    gathered = pieces.groupBy("project", "text_id", "line", "asked", "_target").agg(F.array_sort(F.collect_list(F.struct("position", "frag", "ref"))).alias("_all"))
    hit = F.array_position(F.transform("_all", lambda s: F.coalesce(s["ref"] == F.col("_target"), F.lit(False))), F.lit(True)) - 1
    frags = F.transform("_all", lambda s: s["frag"])
    return gathered.select(
        "project", "text_id", "line", "asked", F.array_join(frags, " ").alias("transliteration"), F.when(hit >= 0, hit.cast("int")).alias("target_position"), frags.alias("frags")
    )


def attestation_markdown(source: str | None = None, catalogue: str | None = None) -> Column:
    """A quotation with its text, line and place; parts that are missing are left out. ``source`` and ``catalogue`` are what to
    cite for the line and, where the artifact is in the catalogue, for its data."""
    ref = F.when(F.col("artifact_url").isNotNull(), F.concat(F.lit("["), F.col("text_id"), F.lit("]("), F.col("artifact_url"), F.lit(")"))).otherwise(F.col("text_id"))
    head = joined(" ", ref, F.col("line_label"))
    place = joined(" · ", F.col("designation"), F.col("period"), F.col("museum_collection"), F.col("museum_no"))
    second = F.when(head != "", F.concat(F.lit("\n> — "), head, F.when(place != "", F.concat(F.lit(" · "), place)).otherwise("")))
    block = F.concat(F.rtrim(F.concat(F.lit("> "), F.coalesce("transliteration", F.lit("")))), F.coalesce(second, F.lit("")))
    if source is None:
        return block
    also = F.when(F.col("artifact_url").isNotNull(), f"; tablet metadata: {catalogue}").otherwise("") if catalogue else F.lit("")
    return F.concat(block, F.lit(f"\n<sub>— line & lemma: {source}"), also, F.lit("</sub>"))


def bilingual_markdown(title: Column, text_id: Column, label: Column, transliteration: Column, translation: Column, source: str) -> Column:
    """A quotation in two languages with where it is from; parts that are null or empty are left out."""
    place = F.concat(F.coalesce(title, text_id), F.lit(" ("), text_id, F.when(label != "", F.concat(F.lit(", line "), label)).otherwise(""), F.lit(")"))
    return F.concat_ws(
        "\n", F.when(transliteration != "", F.concat(F.lit("> "), transliteration)), F.when(translation != "", F.concat(F.lit('> "'), translation, F.lit('"'))),
        F.concat(F.lit("> — "), place), F.lit(f"<sub>— {source}</sub>"),
    )


def lines_with_lemma(corpus: Corpus, lemma: str | None = None) -> DataFrame:
    """One row per word with the lemma (of every lemma if none is asked): its line and the translation of its paragraph."""
    words = corpus["words"].filter("lemma is not null and lemma <> ''")
    if lemma is not None:
        words = words.filter(F.col("lemma") == lemma)
    lines = corpus["lines"].select("text_id", "line_id", "ord", "line_label", "transliteration", "paragraph_id")
    paragraphs = first_wins(corpus["paragraphs"], ["text_id", "para_id"], ["line_range", "translation"]).select("text_id", F.col("para_id").alias("paragraph_id"), "translation")
    joined_lines = words.select("text_id", "line_id", "word_pos", "form", "lemma").join(lines, ["text_id", "line_id"])
    return joined_lines.join(paragraphs, ["text_id", "paragraph_id"], "left")


def lemma_page(corpus: Corpus, lemma: str, limit: int = 10, offset: int = 0, source: str = "corpus") -> DataFrame:
    """A page of the lines with a lemma, one row per word, in the order of their texts: text_id, title, line, ord, word_pos,
    transliteration, translation, markdown, total, next_offset."""
    found = paged(lines_with_lemma(corpus, lemma), [F.col(c) for c in ("text_id", "ord", "line_id", "word_pos", "form")], limit, offset)
    full = _titled(corpus, found)
    block = bilingual_markdown(F.col("title"), F.col("text_id"), F.col("line_label"), F.col("transliteration"), F.col("translation"), source)
    return full.select("text_id", "title", F.col("line_label").alias("line"), "ord", "word_pos", "transliteration", "translation", block.alias("markdown"), "total", "next_offset")


def text_blocks(corpus: Corpus, text_id: str | None = None, start: int = 1, limit: int | None = None) -> DataFrame:
    """Consecutive lines of one paragraph as blocks: text_id, island, paragraph_id, first_ord, last_ord, lines."""
    lines = corpus["lines"].filter(F.col("ord") >= start)
    if text_id is not None:
        lines = lines.filter(F.col("text_id") == text_id)
    if limit is not None:
        lines = lines.orderBy("ord").limit(limit)
    marked = groups.islands(lines, ["text_id"], ["ord", "line_id"], "paragraph_id")
    return marked.groupBy("text_id", "island", "paragraph_id").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count(F.lit(1)).alias("lines"))


def paragraph_lines(corpus: Corpus) -> DataFrame:
    """The lines of every paragraph in order, joined by ' / '."""
    lines = corpus["lines"].filter("paragraph_id is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line_id", "transliteration"))), lambda s: s["transliteration"]), " / ")
    return lines.groupBy("text_id", "paragraph_id").agg(text.alias("lines"))


def _titles(corpus: Corpus) -> DataFrame | None:
    return corpus["texts"].select("text_id", "title") if "texts" in corpus else None


def _titled(corpus: Corpus, rows: DataFrame) -> DataFrame:
    """``rows`` with the title of their text; null where texts have none."""
    titles = _titles(corpus)
    return rows.withColumn("title", F.lit(None).cast("string")) if titles is None else rows.join(titles, "text_id", "left")


def _paragraph_docs(corpus: Corpus) -> DataFrame:
    rows = first_wins(corpus["paragraphs"], ["text_id", "para_id"], ["line_range", "translation"])
    return rows.withColumn("doc", F.concat_ws("|", "text_id", "para_id"))


def _line_docs(corpus: Corpus) -> DataFrame:
    rows = first_wins(corpus["lines"], ["text_id", "line_id"], ["ord", "transliteration"])
    return rows.withColumn("doc", F.concat_ws("|", "text_id", "line_id"))


def _index(corpus: Corpus, name: str, docs: DataFrame, column: str, stemmed: bool) -> fts.Index:
    """The index of a column, postings in the order of their terms; a built corpus keeps it on disk."""
    made = fts.build_index(docs, "doc", column, stemmed)
    postings = corpus.derived(f"{name}_postings", lambda _: made.postings, ("term", "doc"))
    return fts.Index(postings, corpus.derived(f"{name}_lengths", lambda _: made.lengths, ("doc",)), stemmed)


def index_translations(corpus: Corpus, stemmed: bool = True) -> fts.Index:
    return _index(corpus, "stems" if stemmed else "translations", corpus.derived("paragraph_docs", _paragraph_docs, ("doc",)), "translation", stemmed)


def index_lines(corpus: Corpus) -> fts.Index:
    return _index(corpus, "transliterations", corpus.derived("line_docs", _line_docs, ("doc",)), "transliteration", False)


def search_translations(corpus: Corpus, query: str, limit: int = 10, offset: int = 0, stemmed: bool = True, source: str = "corpus") -> DataFrame:
    """A page of paragraphs whose translation fits a query, best first, with the lines they translate.

    text_id, para_id, title, line_range, translation, score, lines (array of line, transliteration in order), markdown, total,
    next_offset. Only the paragraphs of the page are joined with their lines.
    """
    hits = paged(fts.search(index_translations(corpus, stemmed), query), [F.round("score", 9).desc(), F.col("doc")], limit, offset)
    docs = corpus.derived("paragraph_docs", _paragraph_docs, ("doc",)).select("doc", "text_id", "para_id", "line_range", "translation")
    found = hits.join(docs, "doc")
    wanted = found.select("text_id", F.col("para_id").alias("paragraph_id"))
    own = corpus["lines"].join(F.broadcast(wanted), ["text_id", "paragraph_id"], "left_semi").select("text_id", F.col("paragraph_id").alias("para_id"), "ord", "line_id", "line_label", "transliteration").distinct()
    listed = own.groupBy("text_id", "para_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line_id", "line_label", "transliteration"))).alias("all"))
    listed = listed.withColumn("lines", F.transform("all", lambda x: F.struct(x["line_label"].alias("line"), x["transliteration"].alias("transliteration")))).drop("all")
    full = _titled(corpus, found.join(listed, ["text_id", "para_id"], "left"))
    quoted = F.array_join(F.transform("lines", lambda x: x["transliteration"]), "\n> ")
    block = bilingual_markdown(F.col("title"), F.col("text_id"), F.col("line_range"), quoted, F.col("translation"), source)
    return full.select("text_id", "para_id", "title", "line_range", "translation", "score", "lines", block.alias("markdown"), "total", "next_offset")


def search_lines(corpus: Corpus, query: str, limit: int = 10, offset: int = 0, source: str = "corpus") -> DataFrame:
    """A page of lines whose transliteration fits a query, best first, with the translation of their paragraph.

    text_id, line_id, title, line, transliteration, translation, score, markdown, total, next_offset.
    """
    hits = paged(fts.search(index_lines(corpus), query), [F.round("score", 9).desc(), F.col("doc")], limit, offset)
    docs = corpus.derived("line_docs", _line_docs, ("doc",)).select("doc", "text_id", "line_id", "line_label", "transliteration", F.col("paragraph_id").alias("para_id"))
    said = corpus.derived("paragraph_docs", _paragraph_docs, ("doc",)).select("text_id", "para_id", "translation")
    full = _titled(corpus, hits.join(docs, "doc").join(said, ["text_id", "para_id"], "left"))
    block = bilingual_markdown(F.col("title"), F.col("text_id"), F.col("line_label"), F.col("transliteration"), F.col("translation"), source)
    return full.select("text_id", "line_id", "title", F.col("line_label").alias("line"), "transliteration", "translation", "score", block.alias("markdown"), "total", "next_offset")


def collocations_of(corpus: Corpus, word: str, length: int | None = None) -> DataFrame:
    """N-grams with the word in any slot, and resolved_from where a spelling had to be resolved to citation forms first.

    A length other than 2, 3 or 4 is ignored. Order by count descending nulls last, ngram.
    """
    grams = corpus["collocations"]
    if length in (2, 3, 4):
        grams = grams.filter(F.col("n") == length)
    any_slot = F.lit(False)
    for i in range(1, 5):
        any_slot = any_slot | F.coalesce(F.col(f"cf{i}") == word, F.lit(False))
    hits = grams.filter(any_slot).withColumn("resolved_from", F.lit(None).cast("string"))
    known = not corpus["unigrams"].filter(F.col("cf") == word).isEmpty() or not hits.isEmpty()
    if known:
        return hits
    keys = lexicon.readings(corpus).filter(F.col("key") == word.casefold()).select("cf").distinct()
    slots = F.array_compact(F.array("cf1", "cf2", "cf3", "cf4"))
    each = grams.withColumn("_cf", F.explode(F.array_distinct(slots))).join(keys, F.col("_cf") == F.col("cf"), "left_semi")
    return each.drop("_cf").distinct().withColumn("resolved_from", F.lit(word))


def phrase_pattern(corpus: Corpus, slots: list[str]) -> DataFrame:
    """ngram, count, tokens of the n-grams that fit a slot pattern; the feature-annotated table answers if there is one."""
    n = len(pattern.parse_pattern(slots))
    names = F.array(*[F.col(f"cf{i}") for i in range(1, n + 1)])
    if "inflected_ngrams" in corpus:
        hits = pattern.match_pattern(corpus["inflected_ngrams"], slots)
        return hits.select(F.array_join(names, " ").alias("ngram"), "count", pattern.slots_of(hits, n).alias("tokens"), F.col("ngram").alias("key"))
    hits = pattern.match_pattern_plain(corpus["collocations"], corpus["entries"], slots)
    best = first_best(corpus["entries"])
    for i in range(1, n + 1):
        own = best.select(F.col("cf").alias(f"cf{i}"), F.col("pos").alias(f"pos{i}"), F.col("gw").alias(f"gw{i}"), F.lit(None).cast("string").alias(f"case{i}"))
        hits = hits.join(own, f"cf{i}", "left")
    return hits.select("ngram", "count", pattern.slots_of(hits, n).alias("tokens"), F.col("ngram").alias("key"))


def first_best(entries: DataFrame) -> DataFrame:
    """The most attested entry of every citation form."""
    best = F.row_number().over(Window.partitionBy("cf").orderBy(F.col("icount").desc_nulls_last(), "id"))
    return entries.withColumn("_r", best).filter("_r = 1").drop("_r")


def signs_of(signs: DataFrame, query: str) -> DataFrame:
    """Signs by name, then by value (as typed or case folded), digits read as index digits; file order, each sign once."""
    asked = query.strip().translate(str.maketrans("0123456789", SUBSCRIPTS))
    by_name = F.col("sign_name") == asked
    by_value = F.coalesce(F.array_contains("values", asked) | F.array_contains("values", asked.casefold()), F.lit(False))
    tagged = signs.filter(by_name | by_value).withColumn("matched_by", F.when(by_name, "sign_name").otherwise("value"))
    return first_wins(tagged, ["sign_name"], ["matched_by", "position"])


def table_counts(corpus: Corpus) -> DataFrame:
    """name, rows of every table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in corpus.tables.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def located_texts(corpus: Corpus) -> DataFrame:
    """Where each located text is documented: have, missing_indexed, missing_alt_only or missing_unreachable.

    have: in the catalogue with a photo or drawing; missing_indexed: in the catalogue without; missing_alt_only: a designation
    but no catalogue row; missing_unreachable: neither.
    """
    texts = corpus["text_locations"].select("project", "text_id", "designation")
    shown = corpus["artifacts"].select(F.col("p_id").alias("text_id"), ((F.col("has_photo") == 1) | (F.col("has_lineart") == 1)).alias("shown"), F.lit(True).alias("there"))
    both = texts.join(shown, "text_id", "left")
    bucket = filters.gap_bucket(F.coalesce("shown", F.lit(False)), F.col("there").isNotNull(), F.coalesce(F.col("designation") != "", F.lit(False)))
    return both.select("project", "text_id", bucket.alias("bucket"))


def gap_report(projects: DataFrame) -> DataFrame:
    """``project``, bucket of a probe's results: ``local`` (an archive is at hand), ``index_status`` and ``alt_status`` (answers of the
    two places it may be fetched from; 200 is found). have, missing_indexed, missing_alt_only or missing_unreachable."""
    bucket = filters.gap_bucket(F.coalesce("local", F.lit(False)), F.coalesce(F.col("index_status") == 200, F.lit(False)), F.coalesce(F.col("alt_status") == 200, F.lit(False)))
    return projects.select("project", bucket.alias("bucket"))
