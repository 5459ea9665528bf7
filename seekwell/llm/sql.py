"""DuckDB SQL for the rows of the queries that SQL can express."""

from .spotsigs import COMMON

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs of texts by their common five-grams, exactly; classes by reaching the smallest id.
NGRAM_JOIN = f"""
with recursive w as (select doc_id, {WORDS.format(LOW)} w from documents),
g as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' ')))) gram from w where len(w) > 0),
n as (select doc_id, count(*) n from g group by doc_id),
c as (select a.doc_id a, b.doc_id b, count(*) c from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
links as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach as (select doc_id d, doc_id m from documents union select l.b, r.m from reach r join links l on l.a = r.d where r.m < l.b)
select d doc_id, min(m) class_id, (select count(*) from links where a = d) n_links from reach group by d"""

MIX_SOURCES = rf"""
with sized as (select row_number() over () rid, doc_id, source, md5(coalesce(text, '')) row, len({WORDS.format("coalesce(text, '')")})::bigint size from documents),
s as (select *, md5(concat('17/', doc_id, '/', row, '/', source)) h from sized),
src as (select source, sum(size)::bigint source_size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end weight from s group by source),
caps as (select *, 2.0::double * source_size cap, 1.5::double * sum(source_size) over () budget, sum(weight) over () w from src),
filled as (select *, (budget - coalesce(sum(cap) over before, 0)) / (w - coalesce(sum(weight) over before, 0)) level from caps
           window before as (order by cap / weight, source rows between unbounded preceding and 1 preceding)),
aims as (select source, source_size, least(weight * (select max(level) from filled), cap) target from filled),
t as (select *, (select sum(floor(round(target, 6)))::bigint from aims) budget from aims),
q as (select s.*, source_size, target, budget, sum(size) over (partition by s.source order by h, size, rid rows unbounded preceding) e from s join t on s.source is not distinct from t.source),
copies as (select rid, doc_id, source, size, source_size, target, budget, copy, (e + (copy - 1) * source_size)::bigint e from (select *, unnest([1, 2]) copy from q)),
steps as (select *, case when e - size < target and e > target then 1 else greatest(size, 1) end step from copies),
parts as (select *, least(step, size) words, case when target > 0 then (e - size + upto)::double / target end finish from (select *, unnest(case when size = 0 then [0] else range(step, size + 1, step) end) upto from steps)),
sent as (select *, sum(words) over (order by finish nulls last, source nulls last, e, upto, rid rows unbounded preceding) total from parts)
select any_value(doc_id) doc_id, any_value(size) size, any_value(source_size) source_size, any_value(target) target,
sum(least(words, greatest(0, budget - (total - words))))::bigint taken from sent group by rid"""

REPEATS = """
runs{0} as (select rid, min(p) a, max(p) + {0} b from (
  select rid, p, sum(case when p <= last + {0} then 0 else 1 end) over (partition by rid order by p rows unbounded preceding) island from (
    select rid, p, lag(p, 1, -1000000) over (partition by rid order by p) last from (
      select rid, p, count(*) over (partition by h) times from (
        select rid, p, md5_number(substr(x, 2 * p + 1, 2 * {0})) h from (select rid, x, unnest(range(0, n - {0} + 1)) p from d where n >= {0}))) where times > 1)) group by rid, island)"""
SPACE = "('20', '09', '0A', '0B', '0C', '0D')"

#: Every string of 400 bytes at every place, and of 240 for passages.
SUFFIX_DEDUP = f"""
with d as (select row_number() over () rid, doc_id, hex(encode(coalesce(text, ''))) x, octet_length(encode(coalesce(text, ''))) n from documents),
{REPEATS.format(400)}, {REPEATS.format(240)},
kept as (select rid, string_agg(substr(x, 2 * lag_b + 1, 2 * (a - lag_b)), '' order by a) || substr(any_value(x), 2 * max(b) + 1) x, sum(b - a)::bigint removed, count(*) spans from (
  select rid, x, a, b, lag(b, 1, 0) over (partition by rid order by a) lag_b from runs400 join d using (rid)) group by rid),
passages as (select rid, sum(b - a)::bigint n from (select rid, a, b, substr(x, 2 * a + 1, 2 * (b - a)) r from runs240 join d using (rid))
  where b - a >= 400 or len(list_filter(range(0, b - a), lambda i: substr(r, 2 * i + 1, 2) not in {SPACE} and (i = 0 or substr(r, 2 * i - 1, 2) in {SPACE}))) >= 50 group by rid)
select doc_id, d.n::bigint n_bytes, coalesce(removed, 0) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(kept.x, d.x))) kept_sha256, coalesce(p.n, 0) n_passage
from d left join kept using (rid) left join passages p using (rid)"""

COMMON_LIST = ", ".join(f"'{w}'" for w in sorted(set(COMMON)))
SIGNS = """
{0}_words as (select doc_id, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') w, lower(t) plain from {0}),
{0}_content as (select *, list_filter(range(1, len(w) + 1), lambda i: w[i] not in ({1})) pos from {0}_words),
{0}_spots as (select *, list_transform(list_filter(range(1, len(pos) + 1), lambda k: pos[k] = 1 or w[pos[k] - 1] in ({1})),
  lambda k: md5(array_to_string(list_transform(pos[k : k + 2], lambda i: w[i]), ' '))[1:8]) spots from {0}_content),
{0}_signs as (select doc_id, case when len(spots) > 0 then list_sort(list_distinct(spots)) when len(w) > 0 then [md5(regexp_replace(plain, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))[1:8]] else []::varchar[] end s from {0}_spots)"""
LIKE = "case when len({0}) = 0 and len({1}) = 0 then 1.0::double when len({0}) = 0 or len({1}) = 0 then 0.0::double else len(list_intersect({0}, {1}))::double / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) end"

#: Signatures of every text and of its edited form.
SPOTSIGS = f"""
with o as (select doc_id, coalesce(text, '') t, lead(coalesce(text, '')) over w next_t, first_value(coalesce(text, '')) over w first_t,
  lead(doc_id) over w next_id, first_value(doc_id) over w first_id from documents window w as (order by doc_id nulls first rows between unbounded preceding and unbounded following)),
e as (select doc_id, coalesce(next_id, first_id) after, length(t)::bigint n_chars, substring(t, 1, length(t) - length(t) // 4) || substring(coalesce(next_t, first_t), 1, length(t) // 4) t from o),
{SIGNS.format("o", COMMON_LIST)}, {SIGNS.format("e", COMMON_LIST)}
select e.doc_id, n_chars, sha256(e.t) edited_sha256, array_to_string(a.s, '') fingerprint, array_to_string(b.s, '') edited_fingerprint, {LIKE.format("a.s", "b.s")} near_edited, {LIKE.format("a.s", "c.s")} near_next
from e join o_signs a using (doc_id) join e_signs b using (doc_id) join o_signs c on c.doc_id = e.after"""

TERMS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Scores of all pairs of items and documents with a common term.
RANKED_SEARCH = f"""
with t as (select row_number() over () rid, doc_id, {TERMS.format("text")} w from documents),
s as (select count(*)::bigint n, sum(len(w))::bigint l from t where len(w) > 0),
p as (select rid, any_value(doc_id) doc_id, any_value(len(w))::bigint n, u.term, count(*)::bigint tf from t, unnest(w) u(term) group by rid, u.term),
d as (select term, floor(1000 * ln((2 * (select n from s) + 2)::double / (2 * count(*) + 1)))::bigint w from p group by term),
i as (select item_id, text, u.term, count(*)::bigint q from (select distinct item_id, text from benchmark) b, unnest({TERMS.format("b.text")}) u(term) group by all),
c as (select i.item_id, i.text, p.rid, any_value(p.doc_id) doc_id,
  sum(i.q * d.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * (select n from s)) // (select l from s)))))::bigint score
  from i join p on i.term = p.term join d on d.term = i.term group by i.item_id, i.text, p.rid),
r as (select *, row_number() over (partition by item_id, text order by score desc, doc_id, rid)::int "rank" from c where score > 0)
select item_id, "rank", doc_id, score from r where "rank" <= 10"""

#: CRC-32 by a table of 256; a forward search over all states of a conversation, one turn a round.
CONVERSATION_REPAIR = r"""
with recursive k as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) t),
src as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) b from conversations),
named as (select *, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 f from src, k),
rows_ as (select conv_id, turn, case when f = 4 then 'user' else role end role, case when f = 1 then '' when f = 2 then translate(text, '.!?', '') else text end text, unnest(case when f = 3 then [1, 2] else [1] end) again from named where f <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) i, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') body from rows_),
told as (select *, case when body = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when body[-1:] not in ('.', '!', '?') then 'truncated' else '' end fault,
  role[1:1] ini, lag(role[1:1]) over (partition by conv_id order by i) before from placed),
counts as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count_if(fault = 'blank')::bigint blank, count_if(fault = 'duplicate')::bigint duplicate, count_if(fault = 'truncated')::bigint truncated,
  count_if(before is not null and before || ini not in ('su', 'ua', 'au'))::bigint illegal from told group by conv_id),
pre(st, letters, c, here, out) as (values (0, '', 0, 0, []::varchar[]), (0, 'I', 3, 2, ['user:']), (0, 'II', 6, 3, ['user:', 'assistant:']), (1, '', 0, 1, []), (1, 'I', 3, 2, ['user:']), (1, 'II', 6, 3, ['user:', 'assistant:']),
  (2, '', 0, 2, []), (2, 'I', 3, 3, ['assistant:']), (2, 'II', 6, 2, ['assistant:', 'user:']), (3, '', 0, 3, []), (3, 'I', 3, 2, ['user:']), (3, 'II', 6, 3, ['user:', 'assistant:'])),
edit(here, e, c, ini, "to") as (values (0, 'K', 0, 's', 1), (0, 'K', 0, 'u', 2), (1, 'K', 0, 'u', 2), (3, 'K', 0, 'u', 2), (2, 'K', 0, 'a', 3), (0, 'R', 3, null, 2), (1, 'R', 3, null, 2), (2, 'R', 3, null, 3), (3, 'R', 3, null, 2),
  (0, 'D', 4, null, 0), (1, 'D', 4, null, 1), (2, 'D', 4, null, 2), (3, 'D', 4, null, 3)),
s as (select distinct conv_id, 0::bigint i, 0 st, {'c': 0, 'a': '', 'o': []::varchar[]} b from conversations union all
  select conv_id, i, "to", min(b) from (select s.conv_id, r.i, e."to", {'c': s.b.c + p.c + e.c + case when e.e <> 'D' and r.fault = 'truncated' then 3 else 0 end, 'a': s.b.a || p.letters || e.e,
    'o': s.b.o || p.out || case when e.e = 'D' then [] else [case when e.e = 'K' then r.role when e."to" = 2 then 'user' else 'assistant' end || ':' || r.text] end} b
    from s join told r on r.conv_id is not distinct from s.conv_id and r.i = s.i + 1 join pre p on p.st = s.st join edit e on e.here = p.here and (e.ini is null or e.ini = r.ini) and (e.e = 'D' or r.fault not in ('blank', 'duplicate')))
  group by conv_id, i, "to"),
done as (select s.conv_id, min({'c': s.b.c + case st when 1 then 6 when 2 then 3 else 0 end, 'a': s.b.a || case st when 1 then 'II' when 2 then 'I' else '' end,
  'o': s.b.o || case st when 1 then ['user:', 'assistant:'] when 2 then ['assistant:'] else [] end}) b from s left join counts c on c.conv_id is not distinct from s.conv_id where s.i = coalesce(c.n, 0) group by s.conv_id)
select d.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, b.c::bigint cost, b.a audit, sha256(array_to_string(b.o, chr(10))) repaired_sha256
from done d left join counts c on c.conv_id is not distinct from d.conv_id"""

SQL = {
    "op1_ngram_join": NGRAM_JOIN, "op2_spotsigs": SPOTSIGS, "op5_mix_sources": MIX_SOURCES, "op9_suffix_dedup": SUFFIX_DEDUP,
    "op11_conversation_repair": CONVERSATION_REPAIR, "op13_ranked_search": RANKED_SEARCH,
}
