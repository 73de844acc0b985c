"""The sequential fit as recursive SQL: the independent oracle of the models' values."""

from __future__ import annotations

# Rows a scanning key looks ahead in one round; it bounds the work of a round, not the result.
AHEAD = 2000


def _sims(row: str, sv: str, sigma: float) -> str:
    gap = f"list_sum(list_transform(list_zip({row}, s), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"list_transform({sv}, lambda s: exp({-0.5 / (sigma * sigma)!r} * {gap}))"


def _score(sims: str, alpha: str, radius: str) -> str:
    best = f"list_max({sims})"
    return f"case when {best} < 1e-8 or {best} > 1 - 1e-8 then -1.0 else {radius} - list_dot_product({sims}, {alpha}) end"


def _without(items: str, place: str) -> str:
    return f"list_concat({items}[:{place} - 1], {items}[{place} + 1:])"


def _safe(pivot: str) -> str:
    return f"case when abs({pivot}) < 1e-12 then 1e-12 else {pivot} end"


def boundary_walk(numbered: str, sigma: float, ahead: int = AHEAD) -> str:
    """Table expressions for ``with recursive`` that end in ``walk``, a row per key and change of its model.

    ``numbered`` is a list of table expressions that ends in ``numbered(key, rn, v)``, the rows of a key from 1 on.
    A key scans for its next row outside, borders its inverse, cuts negative weights one by one, offers the cut
    rows again and settles; ``spot`` is the row it has reached and ``mode`` 'scan' where the model is settled.
    """
    border = """list_append(
        list_transform(list_zip(l.inv, g.c), lambda p: list_append(list_transform(list_zip(p[1], g.c), lambda q: q[1] + p[2] * q[2] / g.gain), -p[2] / g.gain)),
        list_append(list_transform(g.c, lambda c: -c / g.gain), 1 / g.gain))"""
    shrink = f"""list_transform({_without('l.inv', 'd.worst')}, lambda row: list_transform(
        list_zip({_without('row', 'd.worst')}, {_without('l.inv[d.worst]', 'd.worst')}),
        lambda q: q[1] - row[d.worst] * q[2] / {_safe('l.inv[d.worst][d.worst]')}))"""
    return f"""{numbered},
    ends as (select key, max(rn) as n from numbered group by key),
    walk as (
      select key, 0::bigint as step, 1::bigint as spot, [v] as sv, [[1.0::double]] as inv, [1.0::double] as alpha, 1.0::double as radius,
             []::double[][] as gone, 'scan' as mode, 1::bigint as added, 0::bigint as removed
      from numbered where rn = 1
      union all
      (with live as (select w.*, e.n from walk w join ends e using (key) where w.mode <> 'scan' or w.spot < e.n),
      near as (select l.key, r.rn, r.v, l.alpha, l.radius, {_sims('r.v', 'l.sv', sigma)} as f
               from live l join numbered r on r.key = l.key and r.rn > l.spot and r.rn <= l.spot + {ahead} where l.mode = 'scan'),
      hits as (select key, min(rn) as rn, arg_min(v, rn) as v, arg_min(f, rn) as f from near where {_score('f', 'alpha', 'radius')} > 0 group by key),
      again as (select key, spot, alpha, radius, gone[1] as v, {_sims('gone[1]', 'sv', sigma)} as f from live where mode = 'retry'),
      offered as (select key, rn, v, f from hits
                  union all select key, spot, v, f from again where {_score('f', 'alpha', 'radius')} > 0),
      turned as (select o.*, list_transform(l.inv, lambda row: list_dot_product(row, o.f)) as c from offered o join live l using (key)),
      grown as (select key, rn, v, c, {_safe('(1 - list_dot_product(f, c))')} as gain from turned),
      cutting as (select key, list_position(alpha, list_min(alpha)) as worst from live where mode = 'prune' and list_min(alpha) < 0),
      changed as (
        select l.key, l.step + 1 as step, l.alpha, l.radius, l.mode as was, g.key is not null as grew, d.worst is not null as shrank,
               coalesce(g.rn, case when l.mode = 'scan' then least(l.spot + {ahead}, l.n) else l.spot end) as spot,
               case when g.key is not null then list_append(l.sv, g.v) when d.worst is not null then {_without('l.sv', 'd.worst')} else l.sv end as sv,
               case when g.key is not null then {border} when d.worst is not null then {shrink} else l.inv end as inv,
               case when d.worst is not null then list_append(l.gone, l.sv[d.worst]) when l.mode = 'retry' then l.gone[2:] else l.gone end as gone,
               l.added + (g.key is not null)::bigint as added, l.removed + (d.worst is not null)::bigint as removed
        from live l left join grown g using (key) left join cutting d using (key)),
      weighed as (select * replace (case when grew or shrank then list_transform(inv, lambda row: list_sum(row)) else alpha end as alpha) from changed),
      moved as (select *, case when was = 'scan' and not grew then 'scan'
                               when was <> 'retry' and (shrank or list_min(alpha) < 0) then 'prune'
                               when len(gone) > 0 then 'retry' else 'settle' end as next from weighed)
      select key, step, spot, sv, inv,
             case when next = 'settle' and abs(list_sum(alpha)) >= 1e-12 then list_transform(alpha, lambda a: a / list_sum(alpha)) else alpha end as alpha,
             case when next <> 'settle' then radius when abs(list_sum(alpha)) < 1e-12 then 0.0 else 1 / list_sum(alpha) end as radius,
             gone, case when next = 'settle' then 'scan' else next end as mode, added, removed
      from moved)),
    fitted as (select key, max(spot) as seen, arg_max(sv, step) as sv, arg_max(alpha, step) as alpha, arg_max(radius, step) as radius
               from walk group by key)"""


def model_digest(numbered: str, sigma: float, key: str | None, dims: int) -> str:
    """Size, radius, weights and weighted centre of every key's model."""
    center = ", ".join(f"round(list_sum(list_transform(list_zip(alpha, sv), lambda p: p[1] * p[2][{i}])), 6) as c{i}" for i in range(1, dims + 1))
    return f"""with recursive {boundary_walk(numbered, sigma)}
    select {f'key as {key}, ' if key else ''}len(sv)::bigint as n_sv, round(radius, 8) as radius, seen,
           round(list_sum(list_transform(alpha, lambda a: a * a)), 8) as weight_sq, round(list_max(alpha), 8) as weight_top, {center} from fitted"""


def batch_counts(numbered: str, sigma: float, key: str, rows: int, first: int | None = None) -> str:
    """Rows, accepted, removed and support vectors of every batch; the ``first`` one may be of another length."""
    first = first or rows
    batch = f"case when {{0}} <= {first} then 0 else 1 + (({{0}} - 1 - {first}) // {rows}) end"
    return f"""with recursive {boundary_walk(numbered, sigma)},
    batches as (select key, {batch.format('rn')} as batch, count(*) as processed, max(rn) as upto from numbered group by 1, 2),
    state as (select key, spot, max(added) as added, max(removed) as removed, arg_max(len(sv), step) as n_sv from walk group by 1, 2),
    reached as (select b.key, b.batch, b.processed, s.added, s.removed, s.n_sv from batches b asof join state s on s.key = b.key and s.spot <= b.upto)
    select key as {key}, batch::bigint as batch, processed, n_sv::bigint as n_sv,
           added - coalesce(lag(added) over w, 0) as added, removed - coalesce(lag(removed) over w, 0) as removed
    from reached window w as (partition by key order by batch)"""


def radius_trace(numbered: str, sigma: float, key: str) -> str:
    """Radius after every row that followed the first."""
    return f"""with recursive {boundary_walk(numbered, sigma)},
    state as (select key, spot, arg_max(radius, step) as radius from walk group by 1, 2)
    select r.key as {key}, 0::bigint as chunk, (r.rn - 2)::bigint as seq, round(s.radius, 8) as radius
    from numbered r asof join state s on s.key = r.key and s.spot <= r.rn where r.rn > 1"""
