"""DuckDB equivalents of the training-data queries that SQL can express."""

_LINE_ITEMS = "select distinct text_id, line_id, lemma from words where lemma is not null and lemma <> ''"

_P1_WORDS = f"""
  d as ({_LINE_ITEMS}),
  n as (select count(*) as n from (select distinct text_id, line_id from d)),
  r as (select lemma, count(*) as c from d group by lemma),
  t as (select x.lemma as a, y.lemma as b, count(*) as together from d x join d y
        on x.text_id = y.text_id and x.line_id = y.line_id and x.lemma < y.lemma group by 1, 2 having count(*) >= 5),
  s as (select t.a, t.b, t.together, ra.c as records_a, rb.c as records_b, n.n as baskets
        from t join r ra on ra.lemma = t.a join r rb on rb.lemma = t.b, n where t.together * n.n >= 4 * ra.c * rb.c)"""

_P7_COUNTS = f"""
  l as (select lemma as term, count(*) as occurrences, count(distinct (text_id, line_id)) as records
        from (select distinct text_id, line_id, word_pos, lemma from words where lemma is not null and lemma <> '') group by 1),
  u as (select cf as term, sum("count")::bigint as occurrences, count(*) as records
        from (select distinct * from unigrams) where cf is not null and cf <> '' group by 1),
  g as (select distinct n, ngram from collocations where ngram is not null),
  x as (select n, ngram, unnest(string_split(ngram, ' ')) as term from g),
  c as (select term, count(*) as occurrences, count(distinct (n, ngram)) as records from x where term <> '' group by 1)"""


def sql() -> dict[str, str]:
    return {
        "p1_found": f"""
with {_P1_WORDS},
  k as (select distinct * from collocations where n = 2),
  kp as (select least(cf1, cf2) as a, greatest(cf1, cf2) as b, "count" as c from k where "count" is not null and cf1 <> cf2),
  ks as (select a, b, sum(c) as together from kp group by 1, 2),
  ko as (select x, sum(c) as c from (select a as x, c from kp union all select b, c from kp) group by 1),
  kt as (select sum(c) as total from kp)
select 'words' as src, a as lemma_a, b as lemma_b from s
union all
select 'collocations', ks.a, ks.b from ks join ko oa on oa.x = ks.a join ko ob on ob.x = ks.b, kt
where ks.together >= 20 and ks.together * kt.total >= 4 * oa.c * ob.c""",
        "p1_scores": f"""
with {_P1_WORDS}
select a, b, together, records_a, records_b, baskets,
  round(together * baskets / (records_a * records_b)::double, 6) as lift from s""",
        "p5_found": """
with v as (select n, ngram, cf1, "count" as c, row_number() over (partition by n, ngram order by loaded_at desc nulls last,
           "count" desc nulls last, cf1 desc nulls last) as r from inflected_ngrams)
select cf1, n, ngram from (select *, row_number() over (partition by cf1 order by c desc, n, ngram) as k
  from v where r = 1 and c is not null and cf1 is not null) where k <= 5""",
        "p7_found": f"""
with {_P7_COUNTS}
select 'words.lemma' as field, term, case when records <= 2 then 'rare' else 'common' end as mark from l
where records <= 2 or 50 * records > (select count(distinct (text_id, line_id)) from words where lemma is not null and lemma <> '')
union all
select 'unigrams.cf', term, case when occurrences <= 5 then 'rare' else 'common' end from u
where occurrences <= 5 or 200 * occurrences > (select sum(occurrences) from u)
union all
select 'collocations.ngram', term, case when records <= 1 then 'rare' else 'common' end from c
where records <= 1 or 50 * records > (select count(*) from g)""",
        "p7_terms": f"""
with {_P7_COUNTS}
select 'words.lemma' as field, term, occurrences, records from l
union all select 'unigrams.cf', term, occurrences, records from u
union all select 'collocations.ngram', term, occurrences, records from c""",
        "p7_gram_runs": """
with g as (select row_number() over () as id, list_filter(string_split(ngram, ' '), lambda t: t <> '') as t from (select distinct n, ngram from collocations where ngram is not null)),
  p as (select id, t, unnest(range(1, len(t) + 1)) as i from g),
  r as (select id, k as n, array_to_string(t[i:i + k - 1], ' ') as gram from p, (values (1), (2), (3), (4)) as l(k) where i + k - 1 <= len(t))
select n::bigint as n, gram, count(*) as occurrences, count(distinct id) as records from r group by 1, 2""",
        "p7_line_ngrams": """
with w as (select text_id, line_id, lemma, row_number() over (partition by text_id, line_id order by word_pos) as i
           from (select distinct text_id, line_id, word_pos, lemma from words where lemma is not null and lemma <> '')),
  x as (select *, lead(lemma, 1) over q as l2, lead(lemma, 2) over q as l3 from w window q as (partition by text_id, line_id order by i)),
  y as (select text_id, line_id, 1 as n, lemma as gram from x
        union all select text_id, line_id, 2, lemma || ' ' || l2 from x where l2 is not null
        union all select text_id, line_id, 3, lemma || ' ' || l2 || ' ' || l3 from x where l3 is not null)
select n::bigint as n, gram, count(*) as occurrences, count(distinct (text_id, line_id)) as records from y group by 1, 2""",
    }
