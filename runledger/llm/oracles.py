"""The operators' queries as DuckDB SQL, where SQL can say what they return.

Not here: votes of neighbours, language scores, scored contexts, token ids and pieces; they
are tested against brute force, other libraries and held-out rows instead.
"""

from __future__ import annotations

from . import quality

_SHARDING = """
with r as (
  select doc_id, cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) h, coalesce(strlen(text), 0) + 16 b
  from documents),
p as (
  select d, h >> (60 - d) k, sum(b) s from r, range(0, 61) t(d) group by all
  having sum(b) <= 64 * 1024 * 1024 or min(h) = max(h)),
f as (select doc_id, min(d) depth from r join p on p.k = r.h >> (60 - p.d) group by doc_id)
select r.doc_id, right(lpad(bin(h >> (60 - depth)), 60, '0'), depth) shard, cast(depth as int) depth,
  cast(null as bigint) page, cast(b as bigint) n_bytes, cast(s as bigint) shard_bytes
from r join f using (doc_id) join p on p.d = f.depth and p.k = r.h >> (60 - f.depth)
"""

_DECONTAMINATION = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
sized as (select item_id, w, least(13, len(w)) l from b where len(w) > 0),
win as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') g
  from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) i from sized)),
lengths as (select distinct l from win),
grams as (select doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') g
  from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i from d, lengths where len(w) >= l)),
hit as (select doc_id, item_id, i, grams.l from grams join win using (g) where grams.l = win.l),
words as (select distinct doc_id, unnest(range(i, i + l)) p from hit),
n as (select doc_id, count(*) n_hit from words group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(k, ',' order by k) s
  from (select distinct doc_id, cast(item_id as varchar) k from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) contaminated
from d left join n using (doc_id) left join items using (doc_id)
"""

_SIMILAR = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
both_ as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (
  select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= %d * (x.n + y.n - k)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, c) as (select doc_id, doc_id from d union select edge.b, reach.c from reach join edge on edge.a = reach.doc_id)
select d.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) n_shingles, min(c) component_id%s
from d join reach using (doc_id) left join n using (doc_id) group by d.doc_id
"""

_FILL_IN_MIDDLE = r"""
with d as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) x from documents),
h as (
  select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') u, cast('0x' || x[1:8] as bigint) h1, cast('0x' || x[9:16] as bigint) h2,
    cast('0x' || x[17:24] as bigint) h3, cast('0x' || x[25:32] as bigint) h4 from d),
c as (
  select *, cast(len(u) as bigint) n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end form from h),
p as (select *, array_to_string(u[1:a], '') pre, array_to_string(u[a + 1:b], '') mid, array_to_string(u[b + 1:], '') suf from c)
select doc_id, n, form, case when form != 'plain' then cast(length(pre) as bigint) end prefix_chars,
  case when form != 'plain' then cast(length(mid) as bigint) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(t) restored_sha256
from p
"""


def _quality() -> str:
    figures = {
        "symbols_per_word": "n_symbols / m", "dup_lines_per_word": "n_dup_lines / m", "repeat_share": "n_repeat_words / m",
        "long_words": "word_chars / m", "short_words": "-(word_chars / m)",
    }
    tests = ", ".join(f"('{r}', cast({c!r} as double))" for r, cutoffs in quality.RULES.items() for c in cutoffs)
    measured = " union all ".join(f"select doc_id, lang, good, '{r}' rule, {x} v from f where not base_failed" for r, x in figures.items())
    n_tests, share = sum(map(len, quality.RULES.values())), quality.ALPHA / len(quality.RULES)
    order = " ".join(f"when '{r}' then {i}" for i, r in enumerate(quality.RULES))
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
lines as (select doc_id, unnest(string_split(t, chr(10))) l from d),
dup as (select doc_id, count(*) - count(distinct l) n from lines where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d)),
twice as (select doc_id, unnest(list(i)) i from g group by doc_id, g.g having count(*) > 1),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 5)) p from twice) group by doc_id),
good as (select distinct doc_id from labels where quality = 1),
f0 as (select doc_id, lang, cast(len(w) as bigint) n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols, cast(coalesce(dup.n, 0) as bigint) n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) n_repeat_words, doc_id in (select doc_id from good) good
  from d left join dup using (doc_id) left join rep using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, cast(greatest(n_words, 1) as double) m from f0),
measured as ({measured}),
tests(rule, cutoff) as (values {tests}),
strata as (select lang, count(*) n from f where good and not base_failed group by lang),
counts as (
  select measured.lang, rule, cutoff, cast(count_if(v > cutoff) as bigint) x, cast(count(*) as bigint) n
  from measured join tests using (rule) where good group by measured.lang, rule, cutoff),
proven as (
  select lang, rule, min(cutoff) cutoff from counts
  where x < n and list_sum(list_transform(range(0, x + 1),
    lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - case when k = n then 0 else lgamma(n - k + 1) end + k * ln({share!r}) + (n - k) * ln(1 - {share!r}))))
    <= {quality.DELTA!r} / ((select count(*) from strata) * {n_tests})
  group by lang, rule),
broken as (
  select doc_id, string_agg(rule, ',' order by case rule {order} end) rules
  from measured join proven using (rule) where measured.lang is not distinct from proven.lang and v > cutoff group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rules is null kept, case when broken_all.rules is null then '' else broken_all.rules end broken_rules
from f left join broken broken_all using (doc_id)
"""


SQL = {
    "op1_sharding": _SHARDING,
    "op3_quality_rules": _quality(),
    "op5_decontamination": _DECONTAMINATION,
    "op10_jaccard_join": _SIMILAR % (75, ""),
    "op11_minhash_dedup": _SIMILAR % (85, ", d.doc_id = min(c) kept"),
    "op13_fill_in_middle": _FILL_IN_MIDDLE,
}
