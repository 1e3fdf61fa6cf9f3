"""SQL (DuckDB) that gives the same rows as the queries that SQL can express. The other queries hold learned verdicts, token ids or image
files; tests hold them against the libraries and brute force."""

from __future__ import annotations

#: Words, sets of shingles, pairs that share one, links by count, and what links reach.
NGRAM_JACCARD = r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') words from documents)
, s as (select distinct doc_id, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) when len(words) > 0 then [array_to_string(words, ' ')] else [] end) g from w)
, n as (select doc_id, count(*) n from s group by 1), h as (select g from s group by 1 having count(*) > 1), k as (select s.* from s semi join h using (g))
, p as (select a.doc_id a, b.doc_id b, count(*) m from k a join k b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2)
, l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * p.m >= 80 * (x.n + y.n - p.m)), e as (select a, b from l union all select b, a from l)
, c as (select doc_id id, doc_id root from n union select e.b, c.root from c join e on e.a = c.id)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(r.root, d.doc_id)::bigint component_id from documents d left join n using (doc_id) left join (select id, min(root) root from c group by 1) r on r.id = d.doc_id"""

#: Windows numbered by document and place; all but the first of equal ones cover words that go.
SUBSTRING = r"""with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') words from documents)
, g as (select doc_id, unnest(range(1, len(words) - 18)) i, unnest(list_transform(range(1, len(words) - 18), lambda i: array_to_string(words[i:i + 19], ' '))) t from w where len(words) >= 20)
, m as (select doc_id, i from (select doc_id, i, row_number() over (partition by t order by doc_id, i) k from g) where k > 1)
, c as (select distinct doc_id, unnest(range(i, i + 20)) p from m)
, x as (select doc_id, list(p) gone from c group by 1)
select w.doc_id, len(words)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed, sha256(case when gone is null then array_to_string(words, ' ') else array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: not list_contains(gone, i)), lambda i: words[i]), ' ') end) kept_sha256 from w left join x using (doc_id)"""

#: Phrases of one to four words of each piece, counted; every cut of the frequent ones; those without a longer one around them.
COLLOCATIONS = r"""with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) piece from documents)
, w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') words from p)
, f as (select lang, k, g, count(*) f from (select lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])) g from w, unnest([1, 2, 3, 4]) t(k) where len(words) >= k) group by all)
, n as (select lang, sum(f)::bigint n from f where k = 1 group by 1), c as (select * from f where k > 1 and f >= 30)
, x as materialized (select *, array_to_string(g[1:j], ' ') lg, array_to_string(g[j + 1:k], ' ') rg from (select lang, k, g, f a, unnest(range(1, k)) j from c)), s as materialized (select lang, k, array_to_string(g, ' ') s, f from f)
, cuts as (select x.lang, x.k, x.g, x.a, l.f l, r.f r, j, (2000000::hugeint * x.a) // (l.f + r.f) score from x join s l on l.lang = x.lang and l.k = j and l.s = lg join s r on r.lang = x.lang and r.k = x.k - j and r.s = rg)
, best as (select * from cuts qualify row_number() over (partition by lang, g order by score, j) = 1)
, subs as (select lang, g[i:i + m - 1] g, max(f) f from c, unnest([2, 3]) t(m), unnest([1, 2, 3]) u(i) where m < k and i + m - 1 <= k group by all)
, kept as (select b.*, array_to_string(b.g, ' ') phrase from best b left join subs s using (lang, g) where s.f is null or 100 * s.f < 80 * b.a)
, ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint score from ranked join n using (lang) where rank <= 2000"""

#: Counts of every kept term in every group and in its language, smoothed shares, differences of all pairs and of each group and its language.
DIVERGENCE = r"""with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') text from documents)
, t as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d)
, k as (select lang, term from t group by 1, 2 having count(distinct id) >= 10), v as (select lang, count(*) v from k group by 1), g as (select distinct lang, source from d)
, c as (select lang, source, term, count(*) n from t semi join k using (lang, term) group by all), m as (select lang, source, sum(n) m from c group by 1, 2)
, p as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(m.m, 0) + 2 * v.v) p from g join k using (lang) join v using (lang) left join m on m.lang = g.lang and m.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term)
, q as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 2)) // (any_value(w.w) + 2 * any_value(v.v)) q from c join (select lang, sum(n) w from c group by 1) w using (lang) join v using (lang) group by 1, 2)
, pairs as (select a.lang, a.source, 'pair' part, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all)
, found as (select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0)::bigint value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p join q using (lang, term) where n > 0 and p > q)
select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int rank from found) where part = 'pair' or rank <= 10"""
