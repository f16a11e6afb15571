"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from cytolake.llm import quality as Q

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quality() -> str:
    def counts(lang: str) -> str:
        return "[" + ", ".join(f"cast(len(list_filter(ws, lambda x: lower(x) = '{w}')) as double)" for w in Q.COMMON[lang]) + ", cast(len(list_filter(ws, lambda x: lower(x) not in (" + ", ".join(f"'{w}'" for w in Q.COMMON[lang]) + "))) as double)]"

    common = " ".join(f"when '{x}' then {counts(x)}" for x in Q.COMMON)
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"

    def distance(a: str, b: str, n: int) -> str:
        parts = []
        for i in range(1, n + 1):
            p, q = f"({a}[{i}] / list_sum({a}))", f"({b}[{i}] / list_sum({b}))"
            m = f"(({p} + {q}) / 2)"
            parts.append(f"(case when {p} > 0 then {p} * log2({p} / {m}) else 0 end + case when {q} > 0 then {q} * log2({q} / {m}) else 0 end) / 2")
        return f"case when list_sum({a}) > 0 and list_sum({b}) > 0 then sqrt(greatest({' + '.join(parts)}, 0)) end"

    left = lambda cls: f"cast(length(regexp_replace(t, '[^{cls}]+', '', 'g')) as double)"
    return f"""
with d as (select row_number() over () as k, doc_id, lang, coalesce(text, '') as t, trim(coalesce(text, ''), {_WS}) as b from documents),
w as (select *, case when b = '' then [] else string_split_regex(b, '[\\x20\\x09-\\x0D]+') end as ws from d),
win as (select k, i, list_aggregate(list_slice(ws, i, i + 4), 'string_agg', ' ') as s from (select k, ws, unnest(range(1, len(ws) - 3)) as i from w)),
rep as (select distinct k, i + j as at from (select k, i, unnest([0, 1, 2, 3, 4]) as j from (select k, i, count(*) over (partition by k, s) as n from win) where n > 1)),
reps as (select k, count(*) as n from rep group by k),
ln as (select k, count(*) - count(distinct x) as n from (select k, unnest(string_split(t, chr(10))) as x from w) where trim(x, {_WS}) <> '' group by k),
f as (select w.k, doc_id, case when lang in ({", ".join(f"'{x}'" for x in Q.COMMON)}) then lang end as lang, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
 cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(ln.n, 0) as bigint) as n_dup_lines, cast(coalesce(reps.n, 0) as bigint) as n_repeat_words,
 length(t) as n, {left("a-z")} as small, {left("A-Z")} as capital, {left("0-9")} as digit,
 cast(length(regexp_replace(t, '[^\\x00-\\x7F]+', '', 'g')) as double) as all_ascii,
 case lang {common} end as common from w left join reps using (k) left join ln using (k)),
g as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
 [small, capital, digit, n - word_chars, n_symbols, all_ascii - small - capital - digit - (n - word_chars) - n_symbols, n - all_ascii] as chars from f),
r as (select lang, {sums("chars", len(Q.CLASSES))} as rc, {sums("common", Q.WORDS)} as rw from g where lang is not null and not base_failed and n_words >= {Q.MIN_WORDS} group by lang),
j as (select g.*, {distance("chars", "rc", len(Q.CLASSES))} as dc, {distance("common", "rw", Q.WORDS)} as dw from g left join r using (lang))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and not coalesce(n >= {Q.MIN_CHARS} and dc > {Q.MAX_CHAR_DISTANCE}, false) and not coalesce(n_words >= {Q.MIN_WORDS} and dw > {Q.MAX_WORD_DISTANCE}, false) as kept from j"""


_CHAT = """
with c as (select row_number() over () as k, conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as t from conversations),
p as (select distinct conv_id, speaker as perspective from c where speaker <> 'system'),
s as (select c.*, perspective, case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as chat_role from c join p on c.conv_id is not distinct from p.conv_id),
h as (select *, '<|' || chat_role || case when chat_role = 'user' then ' name=' || speaker else '' end || '|>' as head from s),
g as (select *, head || t || '<|end|>' || chr(10) as segment from h),
o as (select *, row_number() over w - 1 as seq, sum(length(segment)) over w as e from g window w as (partition by conv_id, perspective order by turn nulls first, speaker, t, k rows unbounded preceding))
select conv_id, perspective, turn, cast(seq as bigint) as seq, chat_role, speaker, segment, chat_role = 'assistant' as in_loss,
 cast(e - length(segment) as bigint) as seg_start, cast(e as bigint) as seg_end,
 cast(case when chat_role = 'assistant' then e - length(segment) + length(head) end as bigint) as loss_start,
 cast(case when chat_role = 'assistant' then e - 1 end as bigint) as loss_end from o"""

_DECONTAMINATE = """
with dw as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as ws from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as ws from benchmark),
sizes as (select distinct least(13, len(ws)) as z from bw where len(ws) > 0),
iw as (select distinct item_id, z, array_to_string(list_slice(ws, i, i + z - 1), ' ') as s from (select item_id, ws, least(13, len(ws)) as z, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as i from bw where len(ws) > 0)),
wins as (select k, z, i, array_to_string(list_slice(ws, i, i + z - 1), ' ') as s from (select k, ws, z, unnest(range(1, len(ws) - z + 2)) as i from dw, sizes where len(ws) >= z)),
hits as (select k, wins.z, i, item_id from wins join iw on wins.z = iw.z and wins.s = iw.s),
covered as (select k, count(distinct pos) as n from (select k, unnest(range(i, i + z)) as pos from hits) group by k),
items as (select k, count(*) as n, string_agg(x, ',' order by x) as l from (select distinct k, cast(item_id as varchar) as x from hits) group by k)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(covered.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items,
 sha256(coalesce(l, '')) as items_sha256, coalesce(covered.n, 0) > 0 and 20 * coalesce(covered.n, 0) >= len(ws) as contaminated
from dw left join covered using (k) left join items using (k)"""


_DIVERGENCE = """
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+') as ts from documents),
w as (select k, lang, source, unnest(ts) as term from d),
kept as (select lang, term from w group by all having count(distinct k) >= 10),
v as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
full_ as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n from groups g join kept on g.lang = kept.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
tot as (select lang, source, sum(n) as t from full_ group by all),
p as (select lang, source, term, n, 1 + (1000000000 * (cast(n as hugeint) + 2)) // (cast(t as hugeint) + 2 * v) as p from full_ join tot using (lang, source) join v using (lang)),
ln as (select lang, term, sum(n) as n from c group by all),
q as (select lang, term, 1 + (1000000000 * (cast(n as hugeint) + 2)) // (cast(t as hugeint) + 2 * v) as q from ln join (select lang, sum(n) as t from ln group by lang) using (lang) join v using (lang)),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value
 from groups a join groups b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms))
select lang, source, part, item, value, cast(rank as integer) as rank from r where part = 'pair' or rank <= 10"""


def _repair() -> str:
    """An inserted turn makes a pair with a row (deleting that row instead costs less) or with another inserted
    one (leaving both out costs less), so the cheapest edits insert nothing and the recursion has no such step."""
    far = 1000000000
    more = "case when kind = 't' then 5 else 0 end"
    kept = lambda x: f"case when x = '{x}' and kind in ('g', 't') then {more} else {far} end"
    turned = f"case when kind in ('g', 't') then 1 + {more} else {far} end"
    arc = lambda s, cost, letter: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}'}}"
    least = lambda *arcs: f"list_sort([{', '.join(arcs)}])[1]"
    to_user = [x for s in ("s0", "s1", "s3") for x in (arc(s, kept("u"), "K"), arc(s, turned, "R"))]
    start = lambda cost: f"{{'c': cast({cost} as bigint), 'a': ''}}"
    code = "list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint))"
    bits = "list_reduce([xor(c, b)] || [cast(0 as bigint)] || [0, 0, 0, 0, 0, 0, 0], lambda z, j: xor(z >> 1, 3988292384 * (z & 1)))"
    crc = f"xor(list_reduce([cast(4294967295 as bigint)] || {code}, lambda c, b: {bits}), 4294967295)"
    return f"""
with recursive k as (select dense_rank() over (order by conv_id nulls first) as k, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as f from conversations),
d as (select k, turn, case f when 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
 unnest(range(0, case f when 0 then 0 when 3 then 2 else 1 end)) as copy from k),
o as (select *, row_number() over (partition by k order by turn nulls first, role, text, copy) as i, left(role, 1) as x, rtrim(text, {_WS}) as b from d),
e as (select *, row_number() over (partition by k, role, text order by i) > 1 as again, lag(x) over (partition by k order by i) as px from o),
r as (select *, case when b = '' then 'b' when again then 'd' when right(b, 1) not in ('.', '!', '?') then 't' else 'g' end as kind from e),
dp as (select k, cast(0 as bigint) as i, {start(0)} as s0, {start(far)} as s1, {start(far)} as s2, {start(far)} as s3 from (select distinct k from r)
 union all
 select dp.k, r.i, {arc("s0", 2, "D")}, {least(arc("s1", 2, "D"), arc("s0", kept("s"), "K"))}, {least(arc("s2", 2, "D"), *to_user)}, {least(arc("s3", 2, "D"), arc("s2", kept("a"), "K"), arc("s2", turned, "R"))}
 from dp join r on r.k = dp.k and r.i = dp.i + 1),
best as (select k, list_sort([s0, s3])[1] as z from dp join (select k, max(i) as i from r group by k) using (k, i)),
u as (select r.*, substr(z.a, cast(r.i as int), 1) as l, z.c as cost, z.a as audit from r join best using (k)),
v as (select *, row_number() over (partition by k order by i) - 1 as j, first(x = 's' and l = 'K') over (partition by k order by i) as s from u where l <> 'D'),
t as (select k, string_agg(case when l = 'K' then role when (j - cast(s as int)) % 2 = 0 then 'user' else 'assistant' end || ':' || text, chr(10) order by i) as t from v group by k),
g as (select k, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (where kind = 'b') as blank, count(*) filter (where kind = 'd') as duplicate,
 count(*) filter (where kind = 't') as truncated, count(*) filter (where px is not null and px || x not in ('su', 'ua', 'au')) as illegal, any_value(cost) as cost, any_value(audit) as audit from u group by k)
select conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
 cast(coalesce(cost, 0) as bigint) as cost, coalesce(audit, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct k, conv_id from k) left join g using (k) left join t using (k)"""


def _mixing(budget_share: float = 1.0, max_epochs: int = 4, seed: int = 17) -> str:
    """Shares by sorted capacities: below the level at which a parent's amount runs out, a child takes its capacity, above it level times weight."""
    from cytolake.llm.queries import DOMAINS, WEIGHTS

    domain = " ".join(f"when source in ({', '.join(repr(x) for x in v)}) then '{k}'" for k, v in DOMAINS.items())
    weight = {n: " ".join("when " + " and ".join(f"{c} = '{v}'" for c, v in zip(("domain", "lang"), k, strict=False)) + f" then {w}" for k, w in WEIGHTS.items() if len(k) == n) for n in (1, 2)}
    weight[3] = ""
    levels, keys = [], ("domain", "lang", "source")
    for n in (1, 2, 3):
        own, up = ", ".join(keys[:n]), ", ".join(keys[: n - 1])
        part = f"partition by {up}" if up else ""
        amount = f"join a{n - 1} using ({up})" if up else f"cross join (select least(sum(t) * {budget_share}, sum(t) * {max_epochs}) as a from leaf)"
        w = f"case {weight[n]} else 1.0 end" if weight[n] else "1.0"
        levels.append(
            f"""c{n} as (select {own}, {max_epochs}.0 * sum(t) as cap, {w} as w from leaf group by {own}),
o{n} as (select *, cap / w as r, (a - coalesce(sum(cap) over ({part} order by cap / w, {own} rows between unbounded preceding and 1 preceding), 0)) / sum(w) over ({part} order by cap / w, {own} rows between current row and unbounded following) as lam from c{n} {amount}),
l{n} as (select {up + ", " if up else ""}min(r) as r0, arg_min(lam, r) as lam0 from o{n} where lam <= r {"group by " + up if up else ""}),
a{n} as (select o{n}.{f", o{n}.".join(keys[:n])}, case when r0 is null or o{n}.r < r0 then cap else least(cap, lam0 * w) end as a from o{n} left join l{n} {"using (" + up + ")" if up else "on true"})"""
        )
    return f"""
with d as (select doc_id, case {domain} else 'other' end as domain, coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source,
 cast(case when trim(coalesce(text, ''), {_WS}) = '' then 0 else len(string_split_regex(trim(text, {_WS}), '[\\x20\\x09-\\x0D]+')) end as bigint) as n_tokens from documents),
leaf as (select domain, lang, source, sum(n_tokens) as t from d group by all),
{", ".join(levels)},
plan as (select domain, lang, source, cast(floor(a + 1e-6) as bigint) // cast(t as bigint) as f, cast(floor(a + 1e-6) as bigint) % cast(t as bigint) as rest from a3 join leaf using (domain, lang, source) where t > 0),
e as (select d.*, rest, unnest(range(0, f + 1)) as epoch, f from d join plan using (domain, lang, source)),
k as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch order by md5('{seed}:' || epoch || ':' || doc_id), doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as run from e)
select doc_id, domain, lang, source, cast(epoch as bigint) as epoch, n_tokens from k where epoch < f or run < rest"""


def oracle_sql() -> dict[str, str]:
    return {"op4_distribution_divergence": _quality(), "op5_source_mixing": _mixing(), "op7_benchmark_decontamination": _DECONTAMINATE, "op8_perspective_rotation": _CHAT, "op12_source_divergence": _DIVERGENCE, "op13_conversation_repair": _repair()}
