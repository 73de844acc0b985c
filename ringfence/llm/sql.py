"""DuckDB SQL of the quality rules, the manifest and the collocations."""

from __future__ import annotations

from ringfence.llm.rules import FALLING, RULES

WORD = r"[^\x20\x09-\x0D]+"


def rules_sql(risk: float = 0.05, gap: float = 0.05, price: int = 5) -> str:
    rules = " union all ".join(
        f"select '{name}' rule, 1000 * {up} v, {down} per, {list(cutoffs)}::bigint[] cutoffs, {str(name in FALLING).lower()} falling, s.* from s" for name, (up, down, cutoffs) in RULES.items())
    a = risk / len(RULES)
    return rf"""
        with d as (select row_number() over () rid, doc_id, coalesce(lang, 'und') stratum, coalesce(text, '') t from documents),
        w as (select *, regexp_extract_all(t, '{WORD}') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) ls from d),
        g as (select rid, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'x': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]}})) u from w where len(ws) > 2),
        c as (select rid, u.i i, count(*) over (partition by rid, u.x) n from g),
        again as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from c where n > 1) group by rid),
        m as (select rid, doc_id, stratum, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
                (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, len(ls) n_lines, coalesce(n, 0)::bigint n_repeat_words
            from w left join again using (rid)),
        s as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m),
        r as ({rules}),
        l as (select *, len(cutoffs) - case when per > 0 then len(list_filter(cutoffs, lambda x: case when falling then v <= x * per else v >= x * per end)) else 0 end lvl from r),
        known as (select doc_id id, min(quality) > 0 good from labels where doc_id is not null and quality is not null group by 1),
        rated as (select stratum, rule, len(cutoffs) n_cutoffs, lvl, good, substr(sha256(doc_id::varchar), 1, 1) < '8' held from l join known on id = doc_id where not base_failed),
        tests as (select *, {gap} / count(*) over () alpha from (
            select stratum, rule, n_cutoffs, count(*) filter (good and held) n from rated group by all) where n > 0),
        steps as (select t.*, j.j, count(*) filter (lvl <= j.j and good and held) k, count(*) filter (lvl <= j.j and not good and not held)
                - {price} * count(*) filter (lvl <= j.j and good and not held) gain
            from (select * from tests) t, lateral (select unnest(range(n_cutoffs)) j) j join rated r on r.stratum = t.stratum and r.rule = t.rule group by all),
        valued as (select *, case when k < n * {a} then least(1, list_sum(list_transform(range(k + 1), lambda i:
            exp(lgamma(n + 1) - (case when i = 0 then 0 else lgamma(i + 1) end) - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln(1 - {a}))))) else 1 end p from steps),
        certified as (select *, bool_and(p <= alpha) over (partition by stratum, rule order by j rows unbounded preceding) ok from valued),
        cuts as (select stratum, rule, arg_max(j, (gain, -j)) cut from certified where ok and gain > 0 group by all),
        failed as (select distinct rid from l join cuts using (stratum, rule) where lvl <= cut)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and f.rid is null kept
        from s left join failed f using (rid)"""


def _levels(name: str, first: str, leaves: str, depth: int) -> str:
    """Levels ``{name}0`` to ``{name}{depth}`` (grp, pos, node, n) from ``first``, and the folded leaves ``{name}p0`` to ... from ``leaves``."""
    parts = [f"{name}0 as materialized (select grp, pos, node, n from {first})", f"{name}p0 as materialized (select * from {leaves})"]
    for i in range(depth):
        parts.append(f"""{name}r{i} as materialized (select grp, pos // 3 run, list(node order by pos) ns, any_value(n) n from {name}{i} group by all)""")
        parts.append(f"""{name}{i + 1} as materialized (
            select grp, run pos, case when n > 1 then sha256(array_to_string(ns, '')) else ns[1] end node, case when n > 1 then (n + 2) // 3 else n end n from {name}r{i})""")
        k = "(pos % 3)"
        parts.append(f"""{name}p{i + 1} as materialized (
            select p.* exclude (pos, folded, proof), pos // 3 pos,
                case when r.n > 1 then sha256(array_to_string(ns[1:{k}], '') || folded || array_to_string(ns[{k} + 2:], '')) else folded end folded,
                case when r.n > 1 then proof || array_to_string(ns[1:{k}], '') || array_to_string(ns[{k} + 2:], '') else proof end proof
            from {name}p{i} p join {name}r{i} r on r.grp = p.grp and r.run = p.pos // 3)""")
    return ",\n".join(parts)


def manifest_sql(depth: int = 20) -> str:
    field = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = """xor(4294967295, list_reduce([4294967295::bigint] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ord((doc_id::varchar)[i])::bigint),
        lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda z: 0::bigint), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""
    return f"""
        with d as materialized (select doc_id, source, lang, n_chars, text, case when {crc} % 2 = 0 then replace(text, chr(10), '') else text end changed from documents),
        h as (select doc_id, coalesce('=' || source, '') grp, {leaf('text')} node, {leaf('changed')} tampered from d),
        leaves as materialized (select doc_id, grp, node leaf, node, tampered folded, '' proof,
            row_number() over (partition by grp order by doc_id nulls first, node, tampered) - 1 pos, count(*) over (partition by grp) n from h),
        {_levels('a', 'leaves', "(select doc_id, grp, leaf, folded, proof, pos from leaves)", depth)},
        subroots as materialized (select '' grp, grp member, node, row_number() over (order by encode(grp)) - 1 pos, count(*) over () n from a{depth}),
        members as materialized (select doc_id, leaf, s.node subroot, folded, proof, '' grp, s.pos from ap{depth} p join subroots s on s.member = p.grp),
        {_levels('b', 'subroots', 'members', depth)}
        select doc_id, leaf, subroot, node root, sha256(proof) proof_sha256, folded folded_root, folded = node verified from bp{depth} p, b{depth} b"""


COLLOCATIONS = r"""
    with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
    p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) piece from d),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from p),
    totals as (select lang, sum(len(ws)) n from w group by lang),
    f as materialized (select lang, phrase, k, count(*) f from (
            select lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase from (
                select lang, ws, k, unnest(range(1, len(ws) - k + 2)) i from w, range(1, 6) r(k) where len(ws) >= k))
        group by all having count(*) >= 100),
    cuts as (select lang, phrase, k, f a, unnest(range(1, k)) split, string_split(phrase, ' ') ws from f where k > 1),
    scored as (select c.lang, c.phrase, c.a, c.split, l.f l, r.f r, t.n, ((1000 * c.a::hugeint * t.n::hugeint) // (l.f::hugeint * r.f::hugeint))::bigint score
        from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(ws[1:split], ' ')
            join f r on r.lang = c.lang and r.phrase = array_to_string(ws[split + 1:], ' ') join totals t on t.lang = c.lang),
    best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, split) = 1),
    longer as (select lang, f, string_split(phrase, ' ') ws, k from f where k > 2),
    inner_ as (select lang, f, array_to_string(ws[1:k - 1], ' ') phrase from longer union select lang, f, array_to_string(ws[2:], ' ') from longer),
    own as (select b.* from best b where not exists (select 1 from inner_ i where i.lang = b.lang and i.phrase = b.phrase and i.f >= b.a))
    select lang, rank, phrase, a, l, r, n::bigint n, score from (
        select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank from own) where rank <= 2000"""
