"""DuckDB equivalents of the core's registered queries."""

from __future__ import annotations

_ENTRIES = """
  entries_v as (select id, headword, cf, gw, pos, icount, ipct, xis from (select *, row_number() over (partition by id
    order by loaded_at asc nulls first, headword asc nulls first) as r from entries where removed_at is null) where r = 1)"""
_FORMS = "forms_v as (select distinct * from forms)"
_PERIODS = "periods_v as (select distinct * from periods)"
_SENSES = f"""{_PERIODS},
  senses_v as (select entry_id || '.' || lpad(ord::varchar, 3, '0') as id, entry_id, p as mng, icount, ipct from periods_v)"""
_COMPOUNDS = "compounds_v as (select distinct entry_id, xcpd, eref from compounds)"
_TEXTS = """
  texts_v as (select * exclude (r) from (select *, row_number() over (partition by project, text_id order by loaded_at asc nulls first,
    zip_path asc nulls first, designation asc nulls first, period asc nulls first) as r from text_locations) where r = 1)"""
_ARTIFACTS = """
  artifacts_v as (select * exclude (r) from (select *, row_number() over (partition by p_id order by loaded_at desc nulls last,
    designation desc nulls last, period desc nulls last) as r from artifacts where removed_at is null) where r = 1)"""
_LINES = "lines_v as (select distinct * from text_lines)"
_WORDS = "words_v as (select distinct * from words)"
_PARAGRAPHS = """
  paragraphs_v as (select * exclude (r) from (select *, row_number() over (partition by text_id, para_id order by line_range asc nulls first,
    translation asc nulls first) as r from (select distinct * from paragraphs)) where r = 1)"""
_GRAMS = """
  grams_v as (select * exclude (r) from (select *, row_number() over (partition by n, ngram order by loaded_at desc nulls last,
    "count" desc nulls last, cf1 desc nulls last) as r from inflected_ngrams) where r = 1 and "count" is not null)"""
_INSTANCES = "instances_v as (select distinct xis, word_ref from instances)"
_VERB = "'^((?:(?:nu|mu|na|un|ba|an|bi₂|in|im|ma|i₃|ḫe₂)-)+)([^-(){}]+)(?:-(eš|en|e|a))?$'"
_MORPHOLOGY = f"""
  verb as (select f.*, regexp_extract(n, {_VERB}, 1) as p, regexp_extract(n, {_VERB}, 2) as s, regexp_extract(n, {_VERB}, 3) as e from forms_v f
    where entry_id in (select id from entries_v where pos like 'V%')),
  morphology_v as (
    select entry_id, rtrim(replace(p, '-', '.'), '.') || ':~' || case when e <> '' then ';' || e else '' end as n, sum(icount)::bigint as icount,
      min(xis) as xis, 'morph' as kind from verb where s <> '' group by 1, 2
    union all select entry_id, s, sum(icount)::bigint, min(xis), 'base' from verb where s <> '' group by 1, 2
    union all select entry_id, regexp_replace(n, '\\{{[^}}]*\\}}', '', 'g'), sum(icount)::bigint, min(xis), 'form-sans' from forms_v where n is not null group by 1, 2)"""
_READINGS = """
  known as (
    select 'forms' as matched_in, entry_id, n as spelling, lower(n) as n_cf, icount as c from forms_v where n is not null
    union all select 'morphology.' || kind, entry_id, n, lower(n), icount from morphology_v where n is not null),
  keys as (select distinct key, entry_id from (select lower(cf) as key, id as entry_id from entries_v
    union all select n_cf, entry_id from known where matched_in in ('forms', 'morphology.base', 'morphology.form-sans')) where key is not null),
  readings as (select k.key, e.id as oid, e.cf, e.gw, e.pos, e.icount as total,
    row_number() over (partition by k.key order by e.icount desc nulls last, e.id) as rank from keys k join entries_v e on e.id = k.entry_id)"""
_MEANING = f"""{_ENTRIES}, {_SENSES},
  top as (select entry_id, mng, icount, ipct from (select *, row_number() over (partition by entry_id order by icount desc nulls last, id) as r
    from senses_v where lower(mng) like '%NEEDLE%') where r = 1),
  meaning as (
    select e.id as oid, e.cf, e.gw, e.pos, t.mng as sense, t.icount as sense_count, t.ipct::bigint as sense_pct, e.icount as entry_total
    from top t join entries_v e on e.id = t.entry_id
    union select e.id, e.cf, e.gw, e.pos, e.gw, e.icount, 100, e.icount from entries_v e
    where lower(e.gw) like '%NEEDLE%' and e.id not in (select entry_id from top))"""
#: White space as Unicode has it, for trim and for a character class.
_BLANKS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_TOKENS = f"""list_filter(list_transform(regexp_split_to_array(trim(TEXT, '{_BLANKS}'), '[{_BLANKS}]+'),
  lambda w: regexp_replace(trim(regexp_replace(w, '\\{{[^}}]*\\}}', '', 'g'), '{_BLANKS}'), '^[\\[\\]⸢⸣(),;:!?]+|[\\[\\]⸢⸣(),;:!?]+$', '', 'g')), lambda w: w <> '')"""
_FTS = f"""{_PARAGRAPHS},
  docs as (select text_id || '|' || para_id as doc, regexp_extract_all(lower(translation), '[a-z0-9]+') as t from paragraphs_v where translation is not null),
  lengths as (select doc, len(t) as length from docs),
  terms as (select doc, unnest(t) as term, unnest(range(len(t))) as at from docs)"""
_P3_REFS = """
  refs as (
    select distinct 'compounds' as src, entry_id as k1, xcpd as k2, loaded_at, eref as key from compounds where eref is not null
    union all
    select distinct 'text_locations', project, text_id, loaded_at, text_id from text_locations where text_id is not null
    union all
    select distinct 'instances', xis, word_ref, loaded_at,
      case when regexp_full_match(word_ref, '[^:]+:[^:.]+\\.[^:.]+(\\.[^:.]+)?') then regexp_extract(word_ref, '^([^:]+:[^:.]+)\\.', 1) else '' end
    from instances where word_ref is not null),
  there as (
    select distinct 'compounds' as src, id as key from entries where removed_at is null
    union all
    select distinct 'text_locations', key from (select p_id as key from artifacts where removed_at is null
      union select composite_id from artifacts where removed_at is null) where key is not null
    union all
    select distinct 'instances', project || ':' || text_id from text_locations where project <> '' and text_id <> ''),
  checked as (select r.*, t.key is null as lost from refs r left join there t on t.src = r.src and t.key = r.key)"""
_REFS = """
  read_v as (select xis, word_ref, regexp_extract(word_ref, '^([^:]*):', 1) as project, string_split(regexp_replace(word_ref, '^[^:]*:', ''), '.') as parts
    from instances_v where word_ref is not null),
  refs_v as (select xis, word_ref, project, parts[1] as text_id, parts[2] as line_label from read_v
    where word_ref like '%:%' and len(parts) >= 2 and parts[1] <> '')"""


def _meaning(needle: str) -> str:
    return _MEANING.replace("NEEDLE", needle)


def _gram_sql(n: int, least: int) -> str:
    leads = "".join(f", lead(lemma, {k}) over w as w{k}" for k in range(1, n))
    joined = "lemma" + "".join(f" || ' ' || w{k}" for k in range(1, n))
    return f"""
with one as (select * from (select *, row_number() over (partition by text_id, line_id, word_pos order by lemma asc nulls first, form asc nulls first) as r
    from (select distinct * from words)) where r = 1),
  g as (select lemma{leads} from one where lemma is not null and lemma <> '' window w as (partition by text_id, line_id order by word_pos))
select {n}::bigint as n, {joined} as ngram, count(*) as "count" from g where w{n - 1} is not null group by 2 having count(*) >= {least}"""


def _bm25(terms: list[str]) -> str:
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""
with {_FTS},
  n as (select count(*) as n, avg(length) as mean from lengths),
  tf as (select doc, term, count(*) as tf from terms where term in ({wanted}) group by 1, 2),
  df as (select term, count(*) as df from tf group by 1),
  s as (select tf.doc, tf.term, greatest(1e-6, ln((n.n - df.df + 0.5) / (df.df + 0.5))) * tf.tf * 2.2 /
    (tf.tf + 1.2 * (0.25 + 0.75 * l.length / n.mean)) as s from tf join df using (term) join lengths l using (doc), n)
select doc, round(sum(s), 6) as score from s group by 1 having count(*) = {len(terms)}"""


def _artifact_urls() -> str:
    base = "https://cdli.earth"
    return f"""'{base}/artifacts/' || cdli_id as artifact_url, case when has_photo = 1 then '{base}/dl/photo/' || p_id || '.jpg' end as photo_url,
  case when has_lineart = 1 then '{base}/dl/tn_lineart/' || p_id || '_l.jpg' end as lineart_thumb_url"""


def _attestations(period: str | None, per_entry: int) -> str:
    some = f"where contains(lower(period), '{period}')" if period else ""
    keep = "join texts_p p on p.project = r.project and p.text_id = r.text_id" if period else ""
    return f"""
with {_ENTRIES}, {_INSTANCES}, {_TEXTS}, {_ARTIFACTS}, {_REFS},
  texts_p as (select * from texts_v {some}),
  l as (select r.xis, r.project, r.text_id, r.line_label, min(r.word_ref) as word_ref from refs_v r {keep} group by all),
  t as (select *, row_number() over (partition by xis order by word_ref) as rank from l qualify rank <= {per_entry})
select e.id as oid, t.rank, t.word_ref, t.project, t.text_id, t.line_label, x.period, x.designation, a.museum_collection, a.museum_no
from t join entries_v e on e.xis = t.xis left join texts_p x on x.project = t.project and x.text_id = t.text_id left join artifacts_v a on a.p_id = t.text_id"""


def oracle_sql() -> dict[str, str]:
    letters = "ABCDEGŊHḪIKLMNOPRSṢŠTṬUWXYZ"
    codes = "".join(f" when '{c.lower()}' then '{i:02d}{c.lower()}'" for i, c in enumerate(letters))
    codes += "".join(f" when '{c}' then '3{i}'" for d in ("0123456789", "₀₁₂₃₄₅₆₇₈₉") for i, c in enumerate(d))
    sort_key = f"array_to_string(list_transform(string_split(lower(cf), ''), lambda c: case c when ' ' then ' ' when '-' then ' ' when '/' then ' ' when '.' then '4'{codes} else '99' || c end), '')"
    letter = f"case when contains('{letters}', upper(left(cf, 1))) and coalesce(cf, '') <> '' then upper(left(cf, 1)) else '?' end"
    subs = "₀₁₂₃₄₅₆₇₈₉"
    from tellgrid.sql_lookups import lookups

    tokens = lambda column: _TOKENS.replace("TEXT", column)
    own = {
        "p3_found": f"with {_P3_REFS} select distinct src, k1, k2 from checked where lost",
        "p3_per_month": f"with {_P3_REFS} select src, strftime(loaded_at, '%Y-%m') as month, count(*) as refs, count(*) filter (where lost) as orphans from checked group by 1, 2",
        "meaning_matches": f"with {_meaning('tarsumic')} select * from meaning",
        "search_total_count": f"with {_meaning('tarsumic')} select count(distinct oid) as total from meaning",
        "entry_profile": f"""
with {_ENTRIES}, {_FORMS}, {_SENSES}, {_COMPOUNDS},
  a as (
    select entry_id, 'sense' as part, row_number() over (partition by entry_id order by icount desc nulls last, id) as r, mng as value, icount as c from senses_v
    union all select * from (select entry_id, 'spelling', row_number() over (partition by entry_id order by icount desc nulls last, n, id) as r, n, icount from forms_v) where r <= 25
    union all select entry_id, 'period', row_number() over (partition by entry_id order by ord, p), p, icount from periods_v
    union all select entry_id, 'compound', row_number() over (partition by entry_id order by xcpd, eref), xcpd, null from compounds_v)
select e.id as oid, part, r - 1 as place, value, c as "count" from a join entries_v e on e.id = a.entry_id""",
        "compound_two_branch": f"""
with {_meaning('i')}, {_FORMS},
  h as (select entry_id, n from (select *, row_number() over (partition by entry_id order by icount desc nulls last, n, id) as r from forms_v
    where contains(n, '-') and icount >= 5) where r = 1)
select oid, cf, gw, 'A' as branch, null as spelling, entry_total as total from meaning where contains(cf, ' ')
union all
select oid, cf, gw, 'B', h.n, entry_total from meaning m join h on h.entry_id = m.oid where not contains(cf, ' ') and (pos is null or not pos ilike 'v%')
  and regexp_replace(split_part(h.n, '-', 1), '[{subs}]', '', 'g') <> regexp_replace(cf, '[{subs}]', '', 'g')""",
        "inflections_capped_per_kind": f"""
with {_ENTRIES}, {_FORMS}, {_MORPHOLOGY}
select entry_id, kind, n, coalesce(icount, 0) as "count", row_number() over (partition by entry_id, kind order by coalesce(icount, 0) desc, n) as rank,
  count(*) over (partition by entry_id, kind) as total from morphology_v where coalesce(icount, 0) >= 2 qualify rank <= 5""",
        "tagged_union_lookup": f"""
with {_ENTRIES}, {_FORMS}, {_MORPHOLOGY}, {_READINGS},
  asked as (select distinct form from words where form is not null)
select matched_in, form as spelling, count(*) as readings, count(distinct k.entry_id) as entries
from asked join known k on k.n_cf = lower(form) join entries_v e on e.id = k.entry_id group by 1, 2""",
        "unigram_counts": f"""
with {_WORDS}, w as (select * from words_v where lemma is not null and lemma <> ''),
  l as (select text_id, line_id from w group by 1, 2 having count(*) >= 2)
select lemma as cf, count(*) as "count" from w join l using (text_id, line_id) group by 1""",
        "bigram_counts": _gram_sql(2, 3),
        "trigram_counts": _gram_sql(3, 2),
        "fourgram_counts": _gram_sql(4, 2),
        "event_type_ngrams": """
with g as (select event_type, lead(event_type, 1) over w as a, lead(event_type, 2) over w as b from events
  where event_type is not null and event_type <> '' window w as (partition by user_id order by ts, event_id))
select 3::bigint as n, event_type || ' ' || a || ' ' || b as ngram, count(*) as "count" from g where b is not null group by 2""",
        "collocation_any_slot": "select n::bigint as n, ngram, \"count\" from (select distinct * from collocations) where 'tuk' in (cf1, cf2) or cf3 = 'tuk' or cf4 = 'tuk'",
        "phrase_pattern_pos_case": f"""
with {_GRAMS} select cf1 || ' ' || cf2 as ngram, "count", ngram as key from grams_v where n = 2 and pos1 = 'N' and case1 = 'locative' and pos2 like 'V%'""",
        "phrase_pattern_negated_null": f"""
with {_GRAMS} select cf1 || ' ' || cf2 || ' ' || cf3 as ngram, "count", ngram as key from grams_v
where n = 3 and pos1 = 'N' and gw1 <> 'king' and (case2 <> 'ergative' or case2 is null) and case3 is null""",
        "phrase_pattern_plain": f"""
with {_ENTRIES}, b as (select * from (select *, row_number() over (partition by cf order by icount desc nulls last, id) as r from entries_v) where r = 1)
select c.ngram, c."count", b1.pos as pos1, b1.gw as gw1, b2.pos as pos2 from (select distinct * from collocations) c
left join b b1 on b1.cf = c.cf1 left join b b2 on b2.cf = c.cf2
where n = 2 and exists (select 1 from entries_v e where e.cf = c.cf1 and e.pos = 'N') and exists (select 1 from entries_v e where e.cf = c.cf2 and e.pos ilike 'v%')""",
        "feature_spec_match": f"""
with {_ENTRIES}, {_FORMS}, {_MORPHOLOGY}
select entry_id, n, icount from morphology_v where kind = 'morph' and regexp_matches(n, '^mu\\.([^:]+\\.)*na(\\.[^:]+)*:~')""",
        "verb_form_search": f"""
with {_ENTRIES}, {_FORMS}, {_MORPHOLOGY},
  e as (select * from (select *, row_number() over (partition by cf order by icount desc nulls last, id) as r from entries_v where pos = 'V/t') where r = 1),
  b as (select entry_id, n as base from (select *, row_number() over (partition by entry_id order by icount desc nulls last, n) as r from morphology_v where kind = 'base') where r = 1),
  m as (select v.entry_id, e.cf, v.n, v.icount, e.icount as whole, trim(regexp_replace(replace(replace(translate(v.n, '.:;,', '----'), '~', '-~-'), '~', b.base), '-+', '-', 'g'), '-') as spelling
    from morphology_v v join e on e.id = v.entry_id join b on b.entry_id = v.entry_id
    where v.kind = 'morph' and v.icount >= 1 and regexp_matches(v.n, '^mu[.:]') and regexp_matches(v.n, ':~;(e|ed|en|eš)$'))
select entry_id as oid, cf, n as morph, spelling, exists (select 1 from forms_v f where f.entry_id = m.entry_id and f.n = m.spelling) as verified_in_forms,
  (select max(f.icount) from forms_v f where f.entry_id = m.entry_id and f.n = m.spelling) as forms_count, icount as "count", case when coalesce(whole, 0) <> 0 then round(icount / whole * 100, 2) else 0 end as share_pct,
  row_number() over (partition by entry_id order by icount desc, n) as rank from m qualify rank <= 3""",
        "verb_prefix_chains": f"""
with f as (select distinct form from words where form is not null),
  x as (select form, string_split(form, '-') as p from f),
  y as (select form, p[1:-2] as ahead from x),
  z as (select form, list_filter(ahead, lambda c, i: len(list_filter(ahead[1:i], lambda d: d in ('ḫe₂','na','ga','bara','nu','mu','ba','bi₂','al','i₃','i','e','ni','ši','ta','da','bi','n','b'))) = i) as chain from y)
select nullif(array_to_string(chain, '-'), '') as chain, count(*) as forms from z group by 1""",
        "fts_bm25_top": _bm25(["king", "temple"]),
        "fts_boolean": f"""
with {_FTS}, t as (select doc, list(distinct term) as t from terms group by 1)
select doc from t where (list_contains(t, 'river') or list_contains(t, 'canal')) and list_contains(t, 'king') and not list_contains(t, 'temple')""",
        "fts_phrase": f"with {_FTS} select distinct a.doc from terms a join terms b on b.doc = a.doc and b.at = a.at + 1 where a.term = 'the' and b.term = 'river'",
        "lemma_lines_join": f"""
with {_LINES}, {_WORDS}, {_PARAGRAPHS}
select w.text_id, w.line_id, w.word_pos::bigint as word_pos, l.ord::bigint as ord, w.form, w.lemma, l.line_label, l.transliteration, p.translation
from words_v w join lines_v l using (text_id, line_id) left join paragraphs_v p on p.text_id = l.text_id and p.para_id = l.paragraph_id
where w.lemma is not null and w.lemma <> ''""",
        "block_islands": f"""
with {_LINES}, a as (select *, case when row_number() over w = 1 or paragraph_id is distinct from lag(paragraph_id) over w then 1 else 0 end as c
    from lines_v where ord >= 1 window w as (partition by text_id order by ord, line_id)),
  b as (select *, sum(c) over (partition by text_id order by ord, line_id rows unbounded preceding) as island from a)
select text_id, island::bigint as island, paragraph_id, min(ord)::bigint as first_ord, max(ord)::bigint as last_ord, count(*) as lines from b group by 1, 2, 3""",
        "paragraph_texts": f"""
with {_LINES} select text_id, paragraph_id, string_agg(transliteration, ' / ' order by ord, line_id, transliteration) as lines
from lines_v where paragraph_id is not null group by 1, 2""",
        "keyset_page": "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey >= 1000 order by o_orderkey limit 50",
        "catalogue_filter": f"""
with {_ARTIFACTS} select p_id, cdli_id, period, genre, {_artifact_urls()} from artifacts_v
where contains(translate(period, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'tarsumic')
  and contains(translate(genre, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'admin')""",
        "artifact_blocks": f"""
with {_ARTIFACTS}, a as (select *, array_to_string(list_filter([museum_collection, museum_no, period], lambda x: x <> ''), ' · ') as about from artifacts_v)
select p_id, '[' || coalesce(nullif(designation, ''), p_id) || ' (' || p_id || ')](https://cdli.earth/artifacts/' || cdli_id || ')' ||
  case when about <> '' then ' — ' || about else '' end || E'\\n<sub>— catalogue</sub>' as markdown from a""",
        "pid_normalize": """
with t as (select distinct text_id, regexp_replace(trim(text_id), '^[Pp]+', '') as a, substr(text_id, 2) as b from text_locations)
select text_id, case when regexp_full_match(a, '\\d+') then printf('P%06d', a::bigint) end as p_id, case when regexp_full_match(b, '\\d+') then printf('P%06d', b::bigint) end as plain from t""",
        "existence_or_search": f"""
with {_ENTRIES}, {_FORMS}, {_SENSES}, {_COMPOUNDS}
select id, cf, gw from entries_v where lower(cf) like '%ruin%' or lower(gw) like '%ruin%' or lower(headword) like '%ruin%'
  or id in (select entry_id from forms_v where lower(n) like '%ruin%') or id in (select entry_id from compounds_v where lower(xcpd) like '%ruin%')
  or id in (select entry_id from senses_v where lower(mng) like '%ruin%')""",
        "collation_keys": f"with {_ENTRIES} select id, {letter} as letter, {sort_key} as sort_key from entries_v",
        "collation_sort_page": f"""
with {_ENTRIES} select id, cf, gw, {letter} as letter, {sort_key} as sort_key from entries_v order by sort_key, gw asc nulls first, id limit 25 offset 25""",
        "dedup_first_wins": f"with {_TEXTS} select project, text_id, period, designation from texts_v",
        "dedup_last_wins": f"with {_ARTIFACTS} select p_id, cdli_id, designation, period from artifacts_v",
        "ref_resolve_enrich": _attestations(None, 3),
        "attestations_of_period": f"select oid, rank, word_ref, period from ({_attestations('belethian', 2)})",
        "unresolved_by_project": f"""
with {_INSTANCES}, {_TEXTS}, {_REFS},
  u as (select r.word_ref, x.project, x.text_id from instances_v r left join (select distinct word_ref, project, text_id from refs_v) x using (word_ref) where r.word_ref is not null)
select u.project, count(*) as refs, count(*) filter (where t.text_id is null) as lost from u left join texts_v t on t.project = u.project and t.text_id = u.text_id group by 1""",
        "json_extract_flatten": """
select event_type, key, count(*) as rows, sum(v)::bigint as total from (select event_type, unnest(json_keys(props)) as key,
  (json_extract_string(props, '$.' || unnest(json_keys(props))))::bigint as v from events) group by 1, 2""",
        "strip_markup": f"""
select doc_id, md5(trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[{_BLANKS}]+', ' ', 'g'), '{_BLANKS}')) as digest from documents where text is not null""",
        "corpus_stats": f"""
with {_ENTRIES}, {_FORMS}, {_SENSES}, {_COMPOUNDS}, {_INSTANCES}, {_TEXTS}, {_ARTIFACTS}, {_LINES}, {_WORDS}, {_GRAMS}, {_MORPHOLOGY}
select 'entries' as name, count(*) as rows from entries_v union all select 'forms', count(*) from forms_v union all select 'periods', count(*) from periods_v
union all select 'senses', count(*) from senses_v union all select 'compounds', count(*) from compounds_v union all select 'instances', count(*) from instances_v
union all select 'text_locations', count(*) from texts_v union all select 'artifacts', count(*) from artifacts_v union all select 'lines', count(*) from lines_v
union all select 'words', count(*) from words_v union all select 'paragraphs', count(*) from (select distinct * from paragraphs)
union all select 'unigrams', count(distinct cf) from unigrams union all select 'collocations', count(*) from (select distinct * from collocations)
union all select 'inflected_ngrams', count(*) from grams_v union all select 'morphology', count(*) from morphology_v""",
        "first_wins_map": "select p_brand, arg_min(p_name, p_partkey) as p_name from part group by 1",
        "gap_report_buckets": f"""
with {_TEXTS}, {_ARTIFACTS}
select case when a.has_photo = 1 or a.has_lineart = 1 then 'have' when a.p_id is not null then 'missing_indexed' when t.designation <> '' then 'missing_alt_only'
  else 'missing_unreachable' end as bucket, count(*) as texts from texts_v t left join artifacts_v a on a.p_id = t.text_id group by 1""",
        "share_pct": "select l_returnflag, l_linestatus, count(*) as n, round(count(*) / (select count(*) from lineitem) * 100, 2) as pct from lineitem group by 1, 2",
        "spelling_functions": f"""
with f as (select distinct form from words where form is not null)
select form, regexp_replace(form, '[{subs}]', '', 'g') as bare, translate(form, '0123456789', '{subs}') as lowered,
  len(list_filter(regexp_split_to_array(form, '[-.]'), lambda p: p <> '')) as pieces, split_part(form, '-', 1) as head, array_to_string({tokens('form')}, ' ') as tokens,
  nullif(trim(form, '{_BLANKS}'), '') as trimmed from f""",
        "tumbling_window": "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
        "session_window": """
with a as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minute then 1 else 0 end as c from events window w as (partition by user_id order by ts, event_id)),
  b as (select *, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from a)
select user_id, rtrim(rtrim(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') as start, count(*) as n from b group by user_id, s""",
    }
    return own | lookups(own, sort_key, letter)
