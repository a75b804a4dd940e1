"""DuckDB equivalents of lookups that answer in pages, gloss words or take spellings apart."""

from __future__ import annotations

from tellgrid.functions.morph import CASE_ROLES, ROLE_LABELS, SUFFIXES, VERB_PREFIXES
from tellgrid.functions.text import QUERY_LETTERS, SPELLING_LETTERS
from tellgrid.sql import _ARTIFACTS, _BLANKS, _ENTRIES, _FORMS, _FTS, _INSTANCES, _LINES, _MORPHOLOGY, _PARAGRAPHS, _READINGS, _REFS, _SENSES, _TEXTS, _TOKENS, _WORDS, _artifact_urls, _bm25, _meaning

#: Endings peeled from the right, the first that fits in the order of the table: base and list of {role, kind} for every ``form`` of ``peel_v``.
_PEEL = f"""
  endings(pri, ending, role, kind) as (values {", ".join(f"({i}, '{e}', '{r}', '{k}')" for i, (e, r, k, _) in enumerate(SUFFIXES))}),
  peel(form, rest, found, depth) as (
    select form, form, []::struct(role varchar, kind varchar)[], 0 from peel_v
    union all
    select p.form, left(p.rest, length(p.rest) - length(x.ending)), list_prepend(struct_pack(role := x.role, kind := x.kind), p.found), p.depth + 1
    from peel p join (select p2.form, p2.rest, min(y.pri) as pri from peel p2 join endings y on ends_with(p2.rest, y.ending) group by 1, 2) m on m.form = p.form and m.rest = p.rest
      join endings x on x.pri = m.pri),
  peeled as (select form, arg_max(rest, depth) as base, arg_max(found, depth) as found from peel group by 1)"""
_CASE = "list_filter(found, lambda x: x.kind = 'case')[-1].role"
#: A cleaned piece of a word.
_CLEAN = _TOKENS[_TOKENS.index("lambda w: ") + len("lambda w: ") : _TOKENS.rindex("), lambda w: w <> '')")]
_LINE_TOKENS = f"list_filter({_TOKENS.replace('TEXT', 'transliteration')}, lambda w: w not in ('x', 'X'))"
_LINE_DOCS = """(select *, text_id || '|' || line_id as doc from (select *, row_number() over (partition by text_id, line_id order by ord asc nulls first,
    transliteration asc nulls first) as r from (select distinct * from text_lines)) where r = 1)"""
_LINE_TERMS = "list_filter(regexp_split_to_array(strip_accents(lower(transliteration)), '[^\\p{L}\\p{N}\\p{M}]+'), lambda x: x <> '')"


def _gloss(words: str) -> str:
    """w: the words of all lines; k: how each distinct word is read."""
    return f"""w as ({words.replace("TOKENS", _LINE_TOKENS)}),
  d as (select distinct word, lower(word) in (select key from readings) as whole,
    list_filter(list_transform(regexp_split_to_array(word, '[-.]'), lambda w: {_CLEAN}), lambda w: w not in ('', 'x', 'X')) as bits from w),
  k as (select word, case when whole then 'whole' when len(bits) <= 1 then 'unmatched' else 'split_fallback' end as match_kind,
    case when whole or len(bits) <= 1 then [word] else bits end as parts from d)"""


def _index_digits(text: str, letters: str) -> str:
    """A digit is an index digit if all that stands between it and a letter before it are digits."""
    one = f"case when c between '0' and '9' and regexp_matches(left({text}, i - 1), '[{letters}][0-9]*$') then substr('₀₁₂₃₄₅₆₇₈₉', c::int + 1, 1) else c end"
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c, i: {one}), '')"


def _page(source: str, order: str, limit: int, offset: int) -> str:
    after = limit + offset
    return f"""select *, (select count(*) from {source}) as total, case when (select count(*) from {source}) > {after} then {after}::bigint end as next_offset
from {source} order by {order} limit {limit} offset {offset}"""


def _quoted(text_id: str, label: str, transliteration: str, translation: str) -> str:
    return f"""concat_ws(chr(10), case when {transliteration} <> '' then '> ' || {transliteration} end, case when {translation} <> '' then '> "' || {translation} || '"' end,
    '> — ' || {text_id} || ' (' || {text_id} || case when {label} <> '' then ', line ' || {label} else '' end || ')', '<sub>— corpus</sub>')"""


def _glyphs() -> str:
    from tellgrid.registry import GLYPHS

    return "map([" + ", ".join(f"'{k}'" for k in GLYPHS) + "], [" + ", ".join(f"'{v}'" for v in GLYPHS.values()) + "])"


def _slot(i: int) -> str:
    return f"case when n >= {i} then cf{i} || '|' || coalesce(gw{i}, '') || '|' || coalesce(pos{i}, '') || '|' || coalesce(case{i}, '') end"


def _cases(pairs: dict[str, str], of: str) -> str:
    return f"case {of} " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs.items()) + " end"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _phrases(base: str) -> str:
    """Every line's words with their roles, folded into a skeleton, and the notes that the roles suggest."""
    also = "map([" + ", ".join(f"'{e}'" for e, _, _, a in SUFFIXES if a) + "], [" + ", ".join("[" + ", ".join(map(_text, a)) + "]" for _, _, _, a in SUFFIXES if a) + "])"
    prefixes = ", ".join(f"'{p}'" for p in VERB_PREFIXES)
    known = "case when suffixed and not w_known then b_known else w_known end"
    read = lambda name: f"case when is_verb then w_{name} when suffixed and not w_known then b_{name} else w_{name} end"
    peel = _PEEL.replace("role varchar, kind varchar", "role varchar, kind varchar, ending varchar").replace("kind := x.kind", "kind := x.kind, ending := x.ending")
    return f"""
{base}, {_LINES},
  t as (select text_id, line_id, ord, {_TOKENS.replace("TEXT", "transliteration")} as words from lines_v),
  w as (select text_id, line_id, ord, unnest(words) as word, unnest(range(len(words))) as place from t),
  peel_v as (select distinct word as form from w), {peel},
  best as (select key, cf, pos from readings where rank = 1),
  a as (select p.form as word, p.base as stem, p.found, len(found) > 0 as suffixed, string_split(p.form, '-') as parts, x.cf as w_cf, x.pos as w_pos, x.key is not null as w_known,
    y.cf as b_cf, y.pos as b_pos, y.key is not null as b_known from peeled p left join best x on x.key = lower(p.form) left join best y on y.key = lower(p.base)),
  b as (select *, list_filter(parts[1:-2], lambda c, i: len(list_filter(parts[1:i], lambda d: d in ({prefixes}))) = i) as chain from a),
  c as (select *, coalesce(w_pos like 'V%', false) or (len(chain) > 0 and coalesce(w_pos, '') = '') as is_verb, parts[-1] as last from b),
  d as (select *, case when is_verb then w_known else {known} end as known, {read("cf")} as cf, {read("pos")} as pos, case when not is_verb then {_CASE} end as outer_case,
    case when is_verb and len(chain) > 0 then array_to_string(chain, '-') end as prefixes,
    case when is_verb then case when len(chain) > 0 then last end when suffixed then stem end as base, case when is_verb then found[1:0] else found end as ends from c),
  e as (select *, case when is_verb then 'verb_head' when outer_case is not null then coalesce({_cases(CASE_ROLES, "outer_case")}, 'unknown') when pos = 'AJ' then 'adjective_modifier'
    when known then 'noun_head_unmarked' else 'unknown' end as role,
    coalesce(case when known then cf end, case when is_verb then last else coalesce(base, word) end) as head from d),
  f as (select *, case when is_verb then '[V ' || head || case when prefixes is not null then ' (' || prefixes || '-)' else '' end || ']' when role = 'adjective_modifier' then head
    when outer_case is not null or role = 'noun_head_unmarked' then '[NP ' || head || '-' || coalesce({_cases(ROLE_LABELS, "role")}, '?') || ']' else '[? ' || head || ']' end as shown,
    concat_ws('|', word, role, coalesce(base, ''), coalesce(cf, ''), coalesce(pos, ''), coalesce(prefixes, ''), array_to_string(list_transform(ends, lambda x: x.role), ',')) as chunk,
    list_transform(list_filter(ends, lambda x: len(coalesce({also}[x.ending], [])) > 0), lambda x: 'token ' || chr(39) || word || chr(39) || ': suffix ' || chr(39) || x.ending || chr(39) || ' read as ' || chr(39) || x.role
      || chr(39) || ', but ambiguous with: ' || array_to_string({also}[x.ending], ', ')) as remarks from e),
  g as (select w.text_id, w.line_id, w.ord, list(f.chunk order by place) as chunks, list(f.role order by place) as roles, flatten(list(f.remarks order by place)) as remarks,
    list(struct_pack(adjective := f.role = 'adjective_modifier', said := f.shown) order by place) as said from w join f using (word) group by 1, 2, 3),
  h as (select *, list_reduce(list_prepend(struct_pack(adjective := false, said := ''), said), lambda x, y: struct_pack(adjective := false, said := case
    when y.adjective and ends_with(x.said, ']') then left(x.said, length(x.said) - 1) || ' +ADJ:' || y.said || ']'
    else x.said || case when x.said <> '' then ' ' else '' end || case when y.adjective then '[ADJ ' || y.said || ']' else y.said end end)).said as skeleton,
    case when list_contains(roles, 'noun_head_unmarked') and list_contains(roles, 'verb_head') then case when list_contains(roles, 'subject_ergative') then
      'ergative subject + absolutive object + verb head: transitive clause (canonical SOV pattern)' else
      'absolutive subject + verb head, no ergative marker: likely INTRANSITIVE clause (or the ergative-marked subject was elided in this fragment)' end end as clause,
    case when list_contains(roles, 'comparison_equative') then 'equative -gin₇ detected: the marked noun is being compared LIKE the head, not described AS the head — rules out an attributive-adjective reading' end as alike
    from g)
select text_id, line_id, ord::bigint as ord, skeleton, array_to_string(chunks, ' / ') as chunks,
  array_to_string(list_concat(list_filter([clause, alike], lambda x: x is not null), remarks), ' / ') as notes from h"""


def lookups(own: dict[str, str], sort_key: str, letter: str) -> dict[str, str]:
    """``own`` holds the queries that pages are taken from."""
    base = "with recursive " + ", ".join([_ENTRIES, _FORMS, _MORPHOLOGY, _READINGS])
    tab = "chr(9)"
    grams = {n: "concat_ws(" + ", ".join([tab, *"abcd"[:n]]) + ")" for n in (2, 3, 4)}
    spaced = "regexp_split_to_array(trim(n, '" + _BLANKS + "'), '[" + _BLANKS + "]+')"
    parts = r"regexp_extract_all(regexp_replace(word, '\{[^}]*$', '{'), '\{[^}]*\}|\{|[^{]+')"
    pieces = "case when part = '{' then ['{'] else list_filter(regexp_split_to_array(trim(part, '{}'), '[-.]'), lambda x: x <> '') end"
    inner = "case when contains(t, '(') and ends_with(t, ')') and length(t) > strpos(t, '(') + 1 then substr(t, strpos(t, '(') + 1, length(t) - strpos(t, '(') - 1) else t end"
    glyphs = _glyphs()
    return {
        "ranked_substring_search": f"with {_meaning('tarsumic')} {_page('meaning', 'sense_count desc nulls last, entry_total desc nulls last, oid', 20, 20)}",
        "feature_ngram_keys": f"""
select n::bigint as n, array_to_string(list_filter([{", ".join(map(_slot, (1, 2, 3, 4)))}], lambda x: x is not null), {tab}) = ngram as same, count(*) as rows
from (select distinct * from inflected_ngrams) group by 1, 2""",
        "feature_ngram_counts": f"""
with recursive one as (select * from (select *, row_number() over (partition by text_id, line_id, word_pos order by lemma asc nulls first, form asc nulls first) as r
    from (select distinct * from words where lemma <> '')) where r = 1),
  peel_v as (select distinct form from one where form is not null), {_PEEL},
  w as (select text_id, line_id, word_pos, lemma || '|' || coalesce(label, '') || '|' || coalesce(pos, '') || '|' || coalesce({_CASE}, '') as s from one left join peeled using (form)),
  g as (select s as a, lead(s, 1) over v as b, lead(s, 2) over v as c, lead(s, 3) over v as d from w window v as (partition by text_id, line_id order by word_pos)),
  x as (select 2 as n, {grams[2]} as ngram from g where b is not null union all select 3, {grams[3]} from g where c is not null union all select 4, {grams[4]} from g where d is not null)
select n::bigint as n, ngram, count(*) as "count" from x group by 1, 2 having count(*) >= 2""",
        "token_gloss": f"""
{base}, {_LINES}, {_gloss("select unnest(TOKENS) as word from lines_v")},
  v as (select word, count(*) as uses from w group by 1),
  t as (select uses, match_kind, unnest(parts) as token from v join k using (word))
select token, match_kind, r.oid, sum(uses)::bigint as uses, min(r.rank)::bigint as rank from t
left join readings r on r.key = lower(token) and r.rank <= 3 and t.match_kind <> 'unmatched' group by 1, 2, 3""",
        "gloss_rows": f"""
{base}, {_LINES}, {_gloss("select text_id, line_id, ord, unnest(TOKENS) as word, unnest(range(len(TOKENS))) as position from lines_v")},
  peel_v as (select word as form from k where match_kind = 'whole'), {_PEEL},
  t as (select w.*, match_kind, unnest(parts) as token, unnest(range(len(parts))) as part from w join k using (word))
select t.text_id, t.line_id, t.ord::bigint as ord, t.position, t.part, t.token, case when match_kind = 'split_fallback' then word end as from_word, match_kind,
  case when len(found) > 0 then base end as base, coalesce(array_to_string(list_transform(found, lambda x: x.role), ','), '') as roles, r.oid, r.cf
from t left join peeled on peeled.form = t.word and match_kind = 'whole' left join readings r on r.key = lower(token) and r.rank = 1 and match_kind <> 'unmatched'""",
        "phrase_roles": _phrases(base),
        "suffix_peel": f"""
with recursive peel_v as (select distinct form from words where form is not null), {_PEEL}
select form, base, array_to_string(list_transform(found, lambda x: x.role), ',') as roles, {_CASE} as "case" from peeled""",
        "sign_rendering": f"""
with f as (select distinct n from forms where n is not null),
  w as (select n, unnest({spaced}) as word, unnest(range(len({spaced}))) as place from f),
  p as (select n, place, unnest({parts}) as part, unnest(range(len({parts}))) as nth from w where word <> ''),
  t as (select n, place, nth, unnest({pieces}) as token, unnest(range(len({pieces}))) as k from p),
  b as (select *, split_part(token, chr(92), 1) as t from t),
  c as (select *, {inner} as u from b),
  g as (select n, place, string_agg(case when token in ('x', 'X', '*', '...', '[...]') then '□' else coalesce({glyphs}[u], {glyphs}[rtrim(u, '?!*')], '□') end, '' order by nth, k) as shown
    from c group by 1, 2),
  s as (select n, string_agg(coalesce(g.shown, ''), ' ' order by place) as glyphs from w left join g using (n, place) where w.word <> '' group by 1)
select f.n, coalesce(glyphs, '') as glyphs, length(coalesce(glyphs, '')) - length(replace(coalesce(glyphs, ''), '□', '')) as missing from f left join s using (n)""",
        "fts_prefix": f"with x as (select doc, unnest({_LINE_TERMS}) as term from {_LINE_DOCS}) select distinct doc from x where starts_with(term, 'tu')",
        "fts_stemmed": f"""
with {_FTS}, n as (select count(*) as n, avg(length) as mean from lengths),
  x as (select doc, case when term in ('river', 'rivers') then 'river' when term in ('canal', 'canals') then 'canal' when term = 'brought' then 'brought' end as term from terms),
  tf as (select doc, term, count(*) as tf from x where term is not null group by 1, 2),
  df as (select term, count(*) as df from tf group by 1),
  s as (select tf.doc, tf.term, greatest(1e-6, ln((n.n - df.df + 0.5) / (df.df + 0.5))) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * l.length / n.mean)) as s
    from tf join df using (term) join lengths l using (doc), n)
select doc, round(sum(s), 6) as score from s group by 1 having bool_or(term = 'brought') and bool_or(term <> 'brought')""",
        "normalized_spellings": f"""
with v as (select distinct value from (select form as value from words union all select designation from text_locations union all select line_id from text_lines
    union all select lemma || '12a₂3' || line_id from words) where value is not null),
  q as (select value, translate(value, 'jJcC', 'ŋŊšŠ') as s,
    replace(replace(replace(replace(replace(trim(value, '{_BLANKS}'), 'sz', 'š'), 's,', 'ṣ'), 't,', 'ṭ'), 'j', 'ŋ'), chr(39), 'ʾ') as t from v)
select value, {_index_digits("s", SPELLING_LETTERS)} as source, {_index_digits("t", QUERY_LETTERS)} as typed from q""",
        "search_page": f"""
with b as ({_bm25(["king", "temple"])}), {_PARAGRAPHS}, {_LINES},
  l as (select text_id, paragraph_id as para_id, count(*) as lines, string_agg(transliteration, chr(10) || '> ' order by ord, line_id, line_label, transliteration) as said
    from (select distinct text_id, paragraph_id, ord, line_id, line_label, transliteration from lines_v) group by 1, 2),
  f as (select p.text_id, p.para_id, p.line_range, p.translation, b.score, coalesce(l.lines, 0) as lines, {_quoted("p.text_id", "p.line_range", "l.said", "p.translation")} as markdown
    from b join paragraphs_v p on p.text_id || '|' || p.para_id = b.doc left join l on l.text_id = p.text_id and l.para_id = p.para_id)
{_page("f", "score desc, text_id || '|' || para_id", 10, 5)}""",
        "line_search_page": f"""
with {_PARAGRAPHS}, d as (select *, {_LINE_TERMS} as t from {_LINE_DOCS} where transliteration is not null),
  n as (select count(*) as n, avg(len(t)) as mean from d),
  x as (select doc, unnest(t) as term from d),
  tf as (select doc, p as term, count(*) as tf from x, (values ('tuk'), ('lip')) as q(p) where term = p or (p = 'lip' and starts_with(term, p)) group by 1, 2),
  df as (select term, count(*) as df from tf group by 1),
  s as (select tf.doc, sum(greatest(1e-6, ln((n.n - df.df + 0.5) / (df.df + 0.5))) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len(d.t) / n.mean))) as score
    from tf join df using (term) join d using (doc), n group by 1),
  f as (select d.text_id, d.line_id, d.line_label as line, d.transliteration, p.translation, round(s.score, 6) as score, {_quoted("d.text_id", "d.line_label", "d.transliteration", "p.translation")} as markdown
    from s join d using (doc) left join paragraphs_v p on p.text_id = d.text_id and p.para_id = d.paragraph_id)
{_page("f", "score desc, text_id || '|' || line_id", 20, 0)}""",
        "lemma_page": f"""
with {_LINES}, {_WORDS}, {_PARAGRAPHS},
  f as (select w.text_id, l.line_label as line, l.ord::bigint as ord, w.word_pos::bigint as word_pos, l.transliteration, p.translation, w.line_id, w.form,
    {_quoted("w.text_id", "l.line_label", "l.transliteration", "p.translation")} as markdown
    from words_v w join lines_v l using (text_id, line_id) left join paragraphs_v p on p.text_id = l.text_id and p.para_id = l.paragraph_id where w.lemma = 'tuk')
select * exclude (line_id, form) from ({_page("f", "text_id, ord, line_id, word_pos, form", 25, 25)})""",
        "compound_page": f"""
with c as (select * exclude (total), total as "count" from ({own["compound_two_branch"]})) {_page("c", '"count" desc nulls last, branch, oid', 20, 10)}""",
        "catalogue_page": f"""
with {_ARTIFACTS}, c as (select p_id, cdli_id, period, genre from artifacts_v where contains(lower(genre), 'admin')) {_page("c", "p_id", 25, 50)}""",
        "collocation_page": f"""
with c as ({own["collocation_any_slot"]}) {_page("c", '"count" desc nulls last, ngram', 30, 0)}""",
        "collocation_by_spelling": f"""
{base}, c as (select distinct cf from readings where key = 'tuk-ra')
select n::bigint as n, ngram, "count", 'tuk-ra' as resolved_from from (select distinct * from collocations)
where cf1 in (from c) or cf2 in (from c) or cf3 in (from c) or cf4 in (from c)""",
        "analysis_totals": f"""
{base}, h as (select form as spelling, k.matched_in from (select distinct form from words where form is not null) join known k on k.n_cf = lower(form) join entries_v e on e.id = k.entry_id)
select spelling, count(*) as total, min(case when matched_in = 'forms' then '1 dictionary' else '2 morphology' end) as first from h group by 1""",
        "glossary_list": f"""
with {_ENTRIES}, {_FORMS}, {_SENSES},
  e as (select *, {sort_key} as sort_key from entries_v where {letter} = 'K'),
  t as (select count(*) as total, greatest(1, ceil(count(*) / 25))::bigint as pages from e),
  r as (select id, cf, gw, pos, icount, total, pages, least(2, pages) as page, row_number() over (order by sort_key, gw asc nulls first, id) as place from e, t),
  x as (select * from r where place > (page - 1) * 25 and place <= page * 25),
  s as (select entry_id, string_agg(n, '; ' order by k) as v from (select *, row_number() over (partition by entry_id order by icount desc nulls last, n, id) as k
    from forms_v where n is not null) where k <= 5 group by 1),
  m as (select entry_id, string_agg(mng, '; ' order by k) as v from (select *, row_number() over (partition by entry_id order by icount desc nulls last, id) as k
    from senses_v where mng <> '') where k <= 5 group by 1),
  p as (select entry_id, string_agg(p, '; ' order by k) as v from (select *, row_number() over (partition by entry_id order by ord, p) as k
    from periods_v where p is not null) where k <= 5 group by 1)
select x.id, x.cf, x.gw, x.pos, x.icount, x.total, x.pages, x.page, s.v as spellings, m.v as senses, p.v as periods
from x left join s on s.entry_id = x.id left join m on m.entry_id = x.id left join p on p.entry_id = x.id""",
        "reverse_references": f"""
with {_ENTRIES}, {_INSTANCES} select e.id as oid, count(*) as refs, min(word_ref) as first from instances_v i join entries_v e on e.xis = i.xis where word_ref is not null group by 1""",
        "unresolved_entries": f"""
with {_ENTRIES}, {_INSTANCES}, {_TEXTS}, {_REFS},
  x as (select r.xis, r.project, count(*) as n, count(*) filter (where left(r.text_id, 1) = 'P') as p, count(*) filter (where left(r.text_id, 1) = 'Q') as q, count(t.text_id) as known
    from refs_v r left join texts_v t on t.project = r.project and t.text_id = r.text_id group by 1, 2),
  y as (select *, row_number() over (partition by xis order by n desc, project) as k from x),
  z as (select xis, sum(n)::bigint as refs, sum(p)::bigint as p_refs, sum(q)::bigint as q_refs, string_agg(project || ' (' || n || ')', ', ' order by k) filter (where k <= 3) as projects
    from y group by 1 having sum(known) = 0)
select e.id as oid, refs, p_refs, q_refs, projects from z join entries_v e on e.xis = z.xis""",
        "catalogue_lookup": f"""
with {_ARTIFACTS}, u as (select *, {_artifact_urls()} from artifacts_v) select p_id, cdli_id, designation, period, artifact_url, photo_url from u where p_id = 'P100709'""",
        "line_functions": f"""
with {_LINES}, {_ARTIFACTS}
select distinct 'label' as what, line_id as given,
  case when regexp_full_match(line_id, 'c\\d+(\\.[A-Z])?\\.\\d+') then regexp_replace(line_id, '^c\\d+\\.', '') else coalesce(nullif(line_label, ''), '?') end as got from lines_v
union select 'number', line_range, try_cast(nullif(regexp_extract(line_range, '^\\d+'), '') as bigint)::varchar from paragraphs
union select 'there', museum_no, case when coalesce(trim(museum_no, '{_BLANKS}'), '') <> '' then '1' else '0' end from artifacts_v""",
    }
