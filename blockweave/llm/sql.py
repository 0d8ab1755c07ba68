"""DuckDB SQL for the queries that SQL can express. The others are held against brute-force versions in tests/llm/."""

from __future__ import annotations

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL: dict[str, str] = {}

SQL["op2_line_dedup"] = f"""
with parts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
 ln as materialized (select doc_id, unnest(range(len(l))) as i, unnest(l) as line from parts),
 ky as materialized (select *, translate(trim(line, {SPACE}), {LOWER}) as k from ln),
 held as (select k, max(doc_id) as last from ky where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
 told as (select ky.doc_id, i, line, held.k is not null and ky.doc_id < last as gone from ky left join held on held.k = ky.k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from told group by doc_id
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL["op3_decontaminate"] = f"""
with dw as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{_WORD}') as w from documents),
 bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{_WORD}') as w from benchmark),
 iw as materialized (select distinct item_id, n, w[p:p + n - 1] as win from (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from bw where len(w) > 0)),
 dwin as materialized (select doc_id, n, p, w[p:p + n - 1] as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from dw cross join (select distinct n from iw) where len(w) >= n)),
 hits as materialized (select doc_id, p, dwin.n, item_id from dwin join iw on iw.n = dwin.n and iw.win = dwin.win),
 covered as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
 items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as s from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (doc_id) left join items using (doc_id)
"""

_SPLIT = f"list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SQL["op4_jaccard_join"] = f"""
with recursive wd as materialized (select doc_id, {_SPLIT.replace("coalesce(text, '')", f"translate(coalesce(text, ''), {LOWER})")} as w from documents),
 sh as materialized (select distinct doc_id, s from (select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) when len(w) > 0 then [w] else [] end) as s from wd)),
 sz as materialized (select doc_id, count(*) as n from sh group by doc_id),
 met as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
 lk as materialized (select a, b from met join sz x on x.doc_id = a join sz y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
 ed as materialized (select a, b from lk union select b, a from lk),
 reach(a, r) as (select doc_id, doc_id from documents union select ed.b, reach.r from reach join ed on ed.a = reach.a)
select wd.doc_id, coalesce(n, 0) as n_shingles, r as component_id from wd left join sz using (doc_id) join (select a, min(r) as r from reach group by a) q on q.a = wd.doc_id
"""



def _count(kind: str) -> str:
    """How many characters of the text are of the kind."""
    return f"length(regexp_replace(coalesce(text, ''), '[^{kind}]', '', 'g'))"


_MARK = "length(regexp_replace(coalesce(text, ''), '[^!\"''()+,\\-./:;=?@\\[\\\\\\]^_`{}~]', '', 'g'))"
_JS = """sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0.0 end + case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0.0 end)) / 2, 0.0))"""
_REST = "list_append({a}, greatest(0.0, 1.0 - coalesce(list_sum({a}), 0.0)))"
SQL["op6_quality_rules"] = f"""
with wd as materialized (select doc_id, text, case when regexp_full_match(lower(lang), '[a-z]{{2,3}}') then lower(lang) else 'und' end as lang, {_SPLIT} as w from documents),
 ct as materialized (select *, length(translate(coalesce(text, ''), {SPACE}, '')) as word_chars, {_count("a-z")} as c0, {_count("A-Z")} as c1, {_count("0-9")} as c2,
   {_count('#*$%&|<>')} as n_symbols, {_MARK} as c4,
   (with l as (select unnest(string_split(coalesce(text, ''), chr(10))) as x) select count(*) - count(distinct x) from l where length(trim(x, {SPACE})) > 0) as n_dup_lines from wd),
 cl as materialized (select *, [c0, c1, c2, n_symbols, c4, word_chars - c0 - c1 - c2 - n_symbols - c4] as c from ct),
 wn as (select doc_id, p, count(*) over (partition by doc_id, win) as k from (select doc_id, p, w[p:p + 4] as win from (select doc_id, w, unnest(range(1, len(w) - 3)) as p from wd where len(w) >= 5))),
 rp as (select doc_id, count(distinct q) as n_repeat_words from (select doc_id, unnest(range(p, p + 5)) as q from wn where k > 1) group by doc_id),
 ok as materialized (select min(doc_id) as doc_id from cl left join rp using (doc_id) where not (len(w) < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * len(w)) group by lang, text),
 lw as materialized (select lang, w, count(*) as c from (select lang, unnest(w) as w from wd semi join ok using (doc_id)) group by 1, 2),
 tot as (select lang, sum(c) as n from lw group by lang),
 tops as (select lang, w, c from (select lang, lower(w) as w, sum(c) as c, row_number() over (partition by lang order by sum(c) desc, lower(w)) as r from lw where length(w) <= 24 and not contains(w, ',') group by lang, lower(w)) where r <= 32),
 rw as (select lang, list(w order by c desc, w) as rw, list(c / n order by c desc, w) as rs from tops join tot using (lang) group by lang),
 rc as (select lang, list_transform([sum(c[1]), sum(c[2]), sum(c[3]), sum(c[4]), sum(c[5]), sum(c[6])], lambda x: x / greatest(sum(c[1] + c[2] + c[3] + c[4] + c[5] + c[6]), 1)) as rc from cl semi join ok using (doc_id) group by lang),
 hw as (select doc_id, w, count(*) as k from (select doc_id, lower(unnest(w)) as w from wd) group by 1, 2),
 seen as (select cl.doc_id, list(coalesce(k, 0) / greatest(len(cl.w), 1) order by i) as s from cl join rw using (lang) cross join lateral (select unnest(rw) as r, unnest(range(len(rw))) as i) left join hw on hw.doc_id = cl.doc_id and hw.w = r group by cl.doc_id),
 js as (select cl.*, coalesce(n_repeat_words, 0) as n_repeat_words,
   case when word_chars >= 200 then coalesce({_JS.format(p="list_transform(c, lambda x: x / greatest(word_chars, 1))", q="rc")}, 0.0) else 0.0 end as cd,
   case when len(w) >= 40 then coalesce({_JS.format(p=_REST.format(a="s"), q=_REST.format(a="rs"))}, 0.0) else 0.0 end as wdist
   from cl left join rp using (doc_id) left join rc using (lang) left join rw using (lang) left join seen using (doc_id))
select doc_id, len(w)::bigint as n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, len(w) < 10 or 100 * n_repeat_words > 20 * len(w) as base_failed,
 not (len(w) < 10 or 100 * n_repeat_words > 20 * len(w)) and cd <= 0.3 and wdist <= 0.42 as kept, round(cd, 6) as class_distance, round(wdist, 6) as word_distance from js
"""

_SHARE = "(1 + 1000000000::hugeint * ({n} + 5) // ({N} + 5 * {V}))"
SQL["op11_source_divergence"] = f"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
 c as materialized (select lang, source, row, w, count(*) as n from (select lang, source, row, unnest(w) as w from d) group by all),
 k as materialized (select lang, w, sum(n) as n from c group by lang, w having count(*) >= 30),
 l as (select lang, count(*) as v, sum(n) as total from k group by lang),
 g as materialized (select d.lang, d.source, coalesce(v, 0) as v, coalesce(total, 0) as total from (select distinct lang, source from d) d left join l using (lang)),
 s as (select lang, source, w, sum(c.n) as n from c semi join k using (lang, w) group by all),
 gn as materialized (select g.*, coalesce(n, 0) as n from g left join (select lang, source, sum(n) as n from s group by all) using (lang, source)),
 p as materialized (select gn.lang, gn.source, k.w, coalesce(s.n, 0) as c, {_SHARE.format(n="coalesce(s.n, 0)", N="gn.n", V="v")} as p, {_SHARE.format(n="k.n", N="total", V="v")} as q from gn join k using (lang) left join s on s.lang = gn.lang and s.source = gn.source and s.w = k.w),
 pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.w = b.w and a.source <> b.source group by all),
 listed as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0) as value from g join g h on g.lang = h.lang and g.source <> h.source left join pairs on pairs.lang = g.lang and pairs.source = g.source and pairs.item = h.source
  union all select lang, source, 'term', w, p - q from p where c > 0 and p > q),
 r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from listed)
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 50
"""

# DuckDB has no crc32: its table of 256 is made by rule, and each distinct feature is folded over its bytes.
_BIT = "(case when {c} & 1 = 1 then xor({c} >> 1, 3988292384) else {c} >> 1 end)"
_FEATURES = """select {id}, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from (select {id}, regexp_extract_all(translate(coalesce(text, ''), {lower}), '{word}') as w from {table})"""
SQL["op13_resample"] = f"""
with recursive bits as (select i, i::bigint as c, 0 as k from range(256) t(i) union all select i, {_BIT.format(c="c")}, k + 1 from bits where k < 8),
 crc as materialized (select list(c order by i) as tab from bits where k = 8),
 df as materialized (select doc_id, f, count(*) as n from ({_FEATURES.format(id="doc_id", lower=LOWER, word=_WORD, table="documents")}) group by all),
 bf as materialized (select f, count(*) as n from ({_FEATURES.format(id="item_id", lower=LOWER, word=_WORD, table="benchmark")}) group by all),
 hx as (select f, hex(encode(f)) as h from (select f from df union select f from bf)),
 bk as materialized (select f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295::bigint), 4294967295) % 10000 as b from hx, crc),
 s as (select b, sum(n) as n from df join bk using (f) group by b),
 t as (select b, sum(n) as n from bf join bk using (f) group by b),
 c as (select i as b, coalesce(s.n, 0)::double as s, coalesce(t.n, 0)::double as t from range(10000) r(i) left join s on s.b = i left join t on t.b = i),
 g as materialized (select b, floor(1000 * ln(((t + 1) * ((select sum(s) from c) + 10000)) / ((s + 1) * ((select sum(t) from c) + 10000))))::bigint as gain from c),
 w as (select doc_id, sum(n)::bigint as n, sum(n * gain)::bigint as total from df join bk using (f) join g using (b) group by doc_id),
 h as (select doc_id, ('0x' || substr(sha256('7:' || doc_id::varchar), 1, 8))::bigint::double as h from documents),
 sc as (select doc_id, coalesce(n, 0) as n, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight, floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::bigint as luck from h left join w using (doc_id)),
 r as (select doc_id, weight + luck as score, row_number() over (order by weight + luck desc, doc_id) as rank, count(*) over () as able from sc where n >= 39)
select doc_id, n::bigint as n_features, weight, weight + luck as score, case when rank <= 25 * able // 100 then rank end as rank from sc left join (select doc_id, rank, able from r) using (doc_id)
"""
