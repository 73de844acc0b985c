"""The same queries as SQL over the whole tables, for the correctness check."""

from __future__ import annotations

from ringfence.plans.boundary_sql import batch_counts, boundary_walk, model_digest, radius_trace

ITEM_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ITEM_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

EVENTS_K = "select *, cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) as double) as k from events"
SCORED_EVENTS = f"select *, case when k < 10 then 1 else 0 end as label from ({EVENTS_K})"
HASH = "cast('0x' || substr(md5('42#' || cast({} as varchar)), 1, 13) as bigint)"

# class means of the vectors, and every vector scored against them
CENTERS = """
cells as (select label, vec_id, generate_subscripts(embedding, 1) as pos, unnest(embedding)::double as v from embeddings),
centers as (select label, pos, avg(v) as m from cells group by 1, 2),
gaps as (select c.vec_id, c.label as own, m.label as ref, sum((c.v - m.m) * (c.v - m.m)) as d2
         from cells c join centers m using (pos) group by 1, 2, 3)
"""
FIXED = CENTERS + """,
fixed as (select vec_id, any_value(own) as label, max(exp(-d2 / 2)) as best, 0.6 - avg(exp(-d2 / 2)) as raw from gaps group by 1),
scored as (select vec_id, label, best, raw, case when best < 1e-8 or best > 1 - 1e-8 then -1.0 else raw end as score from fixed)
"""
RANKED = FIXED + """,
ranked as (select vec_id, round(score, 3) as score, case when label = 0 then 1 else 0 end as label from scored),
cell as (select score, sum(label) as pos, sum(1 - label) as neg from ranked group by 1),
run as (select score, pos, neg, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
        sum(pos) over () as p, sum(neg) over () as n from cell)
"""

PREP = {
    "l_quantity": "greatest(l_quantity, 0)",
    "l_extendedprice": "ln(1 + greatest(l_extendedprice, 0))",
    "l_discount": "max(l_discount) over () - l_discount",
    "l_tax": "l_tax",
}

# prepared and standardised line items, numbered per key for the sequential fit
ITEM_VECTORS = (
    f"ready as (select {ITEM_KEYS}, l_returnflag, {', '.join(f'{e}::double as {c}' for c, e in PREP.items())} from lineitem), "
    f"z as (select {ITEM_KEYS}, l_returnflag, {', '.join(f'(({c} - avg({c}) over ()) / stddev_pop({c}) over ()) as {c}' for c in PREP)} from ready)"
)


def _top(name: str, cov: str, squarings: int = 14) -> str:
    """Table expressions ending in ``name(v, value)``: the first eigenvector of ``cov(m)``, its largest entry positive.

    The matrix is squared until only its first eigenvector is left of it.
    """
    trace = "list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i]))"
    return f"""{name}_power as (
        select 0 as i, m from {cov}
        union all
        select i + 1, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b)))
        from (select i, list_transform(m, lambda a: list_transform(a, lambda x: x / {trace})) as m from {name}_power where i < {squarings})),
    {name}_column as (select c from (select unnest(m) as c from {name}_power where i = {squarings}) order by list_dot_product(c, c) desc limit 1),
    {name}_unit as (select list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) as u from {name}_column),
    {name}_sign as (select list_transform(u, lambda x: x * case when list_max(u) >= -list_min(u) then 1 else -1 end) as v from {name}_unit),
    {name} as (select v, list_dot_product(v, list_transform(m, lambda row: list_dot_product(row, v))) as value from {name}_sign, {cov})"""


def _plane(coords: str) -> str:
    """Table expressions ending in ``middle(m)`` and the directions ``one`` and ``two`` of ``coords(id, pos, x)``."""
    return f"""{coords},
    middle as (select list(m order by pos) as m from (select pos, avg(x) as m from coords group by 1)),
    moments as (select a.pos as i, b.pos as j, covar_samp(a.x, b.x) as c from coords a join coords b using (id) group by 1, 2),
    cov as (select list(r order by i) as m from (select i, list(c order by j) as r from moments group by 1)),
    {_top('one', 'cov')},
    rest as (select list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - value * v[i] * v[j])) as m from cov, one),
    {_top('two', 'rest')}"""


PLANE = _plane("coords as (select vec_id as id, generate_subscripts(embedding, 1) as pos, unnest(embedding)::double as x from embeddings)")
ITEM_PLANE = _plane(f"""{ITEM_VECTORS}, vectors as (select {ITEM_KEYS}, row_number() over () as id, [{', '.join(PREP)}] as v from z),
    coords as (select id, generate_subscripts(v, 1) as pos, unnest(v) as x from vectors)""")


def _numbered(key: str) -> str:
    return f"""{ITEM_VECTORS},
    numbered as (select {key} as key, [{', '.join(PREP)}] as v, row_number() over (partition by {key} order by {ITEM_KEYS}) as rn from z)"""


BY_FLAG, ALL_ITEMS = _numbered("l_returnflag"), _numbered("0")
BY_LABEL = "numbered as (select label as key, embedding::double[] as v, row_number() over (partition by label order by vec_id) as rn from embeddings)"


def _corr(a: str, b: str) -> str:
    return f"case when stddev_pop({a}) = 0 or stddev_pop({b}) = 0 then null else corr({a}, {b}) end"


def _matrix() -> str:
    return " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, round({_corr(a, b)}, 6) as r from lineitem"
        for a in ITEM_FEATURES for b in ITEM_FEATURES
    )


def _auc(cells: str, by: str = "") -> str:
    """Rank AUC from (by, score, label) rows, ties at half."""
    keys, part = (f"{by}, ", f"partition by {by} ") if by else ("", "")
    group = f"group by {by}" if by else ""
    return f"""
    select {keys}sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) as auc,
           sum(pos) as n_pos, sum(neg) as n_neg
    from (select {keys}score, pos, neg, coalesce(sum(neg) over ({part}order by score rows between unbounded preceding and 1 preceding), 0) as below
          from (select {keys}score, count(*) filter (where label = 1) as pos, count(*) filter (where label <> 1) as neg
                from ({cells}) group by {keys}score)) {group}"""


PRF = """
    count(*) as n_rows,
    coalesce(count(*) filter (where p = 1 and label = 1) / nullif(count(*) filter (where p = 1), 0)::double, 0) as precision,
    coalesce(count(*) filter (where p = 1 and label = 1) / nullif(count(*) filter (where label = 1), 0)::double, 0) as recall,
    coalesce(2.0 * count(*) filter (where p = 1 and label = 1)
             / nullif(count(*) filter (where p = 1) + count(*) filter (where label = 1), 0), 0) as f1,
    count(*) filter (where p = 1) / count(*)::double as flag_rate
"""
EVENT_PREDICTIONS = f"select *, case when value > 50 then 1 else 0 end as p from ({SCORED_EVENTS})"


def _windows(seconds: int, carry: bool) -> str:
    """Window features of events by type; ``carry`` looks for the last stall in earlier windows too."""
    over = "over (partition by event_type order by w)" if carry else ""
    return f"""
    with base as (select *, floor(epoch_us(ts) / {seconds}e6)::bigint as w from ({EVENTS_K})),
    steps as (select *, abs(value - lag(value) over (partition by event_type, w order by ts, event_id)) as step from base),
    agg as (select event_type, w, count(*) as n_samples, avg(value) as quality_mean, stddev_samp(value) as quality_std,
                   avg(step) as quality_mad, avg(k) as bitrate_mean,
                   avg(case when value < 0.1 then 1.0 else 0.0 end) as stall_ratio,
                   max(case when value < 0.1 then epoch_us(ts) end) as stall
            from steps group by 1, 2)
    select event_type, w * {seconds} as window_start, n_samples, round(quality_mean, 8) as quality_mean,
           round(quality_std, 8) as quality_std, round(quality_mad, 8) as quality_mad,
           round(bitrate_mean, 8) as bitrate_mean, round(stall_ratio, 8) as stall_ratio,
           round(((w + 1) * {seconds}e6 - {'max(stall)' if carry else 'stall'} {over}) / 1e6, 8) as tsl_end
    from agg"""


SQL: dict[str, str] = {
    "prep_clip_log_invert": f"select {ITEM_KEYS}, "
    + ", ".join(f"round({e}, 6) as {c}" for c, e in PREP.items()) + " from lineitem",
    "prep_both_bounds": "select event_id, round(least(greatest(value, 1), 100), 6) as value from events",
    "prep_caps": f"""select {ITEM_KEYS}, round(ln(1 + least(greatest(l_extendedprice, 0), 20000)), 6) as l_extendedprice,
        round(ln(1 + least(greatest(l_quantity, 0), 30)), 6) as l_quantity,
        round(ln(1 + least(greatest(l_discount, 0), 0.05)), 6) as l_discount from lineitem""",
    "scale_population": f"select {ITEM_KEYS}, " + ", ".join(
        f"round(({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end, 4) as {c}"
        for c in ITEM_FEATURES) + " from lineitem",
    "scaler_table": " union all ".join(
        f"select '{c}' as feature, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as scale from lineitem"
        for c in ITEM_FEATURES),
    "label_rule": "select doc_id, case when quality <= 0 then 1 else 0 end as label from labels",
    "label_rule_strict": "select case when l_quantity < 50 then 1 else 0 end::bigint as label, count(*) as n from lineitem group by 1",
    "window_features": _windows(86400, True),
    "csv_roundtrip": "select l_returnflag, count(*) as n, "
    + ", ".join(f"round(sum({c}), 2) as {c}" for c in ITEM_FEATURES) + " from lineitem group by 1",
    "present_tables": """select 'customer' as dataset, count(*) as n, round(sum(c_acctbal), 2) as balance from customer
        union all select 'supplier', count(*), round(sum(s_acctbal), 2) from supplier""",
    "flatten_arrays": """
        with pair as (select vec_id, embedding, list_filter(embedding, lambda v: v > 0) as up from embeddings),
        cut as (select vec_id, embedding[1:least(len(embedding), len(up))] as a, up[1:least(len(embedding), len(up))] as b from pair)
        select vec_id, 'embeddings.parquet' as file, 'embeddings' as content, generate_subscripts(a, 1) - 1 as pos,
               round(unnest(a)::double, 6) as embedding, round(unnest(b)::double, 6) as up from cut""",
    "metric_records": f"""select event_type as dataset, round(f1, 6) as f1, round(precision, 6) as precision,
        round(recall, 6) as recall, round(flag_rate * 100, 6) as flag_rate, 50.0::double as threshold, null::double as auc
        from (select event_type, {PRF} from ({EVENT_PREDICTIONS}) group by event_type)""",
    "schema_consistency": """select array_to_string(list_sort(regexp_extract_all(props, '"([a-z_]+)":', 1)), ',') as key_set,
        count(*) as n_rows from events group by 1""",
    "array_profile": """select label, 'embedding' as key, count(*) as n_values, round(min(v), 6) as v_min, round(max(v), 6) as v_max,
        round(avg(v), 6) as v_mean, round(stddev_pop(v), 6) as v_std
        from (select label, unnest(embedding)::double as v from embeddings) group by 1""",
    "array_head": """select vec_id, 'embedding' as key, len(embedding) as size, round(embedding[1]::double, 6) as v1,
        round(embedding[5]::double, 6) as v5 from embeddings""",
    "union_sets": """select source, nation, count(*) as n, round(sum(balance), 2) as balance from (
        select 'customer' as source, c_nationkey as nation, c_acctbal as balance from customer
        union all select 'supplier', s_nationkey, s_acctbal from supplier) group by 1, 2""",
    "normal_only": f"select {ITEM_KEYS}, l_tax from lineitem where not (l_tax < 0.01)",
    "membership": """select o_orderkey, o_custkey from orders
        where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""",
    "membership_list": "select event_id, event_type from events where event_type in ('click', 'view')",
    "holdout_last_groups": """
        with last as (select user_id from events group by 1 order by min(event_id) desc limit 3)
        select event_id, case when user_id in (select user_id from last) then 'test' else 'train' end as part from events""",
    "holdout_tail": """select event_id, case when row_number() over (order by ts, event_id) - 1 >= floor(0.8 * count(*) over ())
        then 'test' else 'train' end as part from events""",
    "min_group": f"select {ITEM_KEYS} from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 having count(*) >= 5)",
    "distinct_groups": "select distinct user_id from events where user_id is not null",
    "group_split": f"""
        with g as (select o_custkey, {HASH.format('o_custkey')} as h from (select distinct o_custkey from orders)),
        r as (select o_custkey, row_number() over (order by h) as rn, ceil(0.2 * count(*) over () - 1e-9) as want from g)
        select o_orderkey, case when rn <= want then 'test' else 'train' end as part from orders join r using (o_custkey)""",
    "group_kfold": """
        with recursive g as (select o_custkey, count(*) as n from orders group by 1),
        o as (select n, row_number() over (order by n desc, o_custkey) as rn from g),
        r(rn, loads, sizes) as (
            select 0::bigint, [0, 0, 0, 0, 0]::bigint[], [0, 0, 0, 0, 0]::bigint[]
            union all
            select o.rn, list_transform(r.loads, lambda x, i: x + case when i = list_position(r.loads, list_min(r.loads)) then o.n else 0 end),
                   list_transform(r.sizes, lambda x, i: x + case when i = list_position(r.loads, list_min(r.loads)) then 1 else 0 end)
            from r join o on o.rn = r.rn + 1),
        last as (select loads, sizes from r order by rn desc limit 1)
        select unnest([0, 1, 2, 3, 4])::bigint as fold, unnest(loads) as n_rows, unnest(sizes) as n_groups from last""",
    "sample_rows": f"select event_id, value from events order by {HASH.format('event_id')}, event_id limit 2000",
    "minibatches": "select event_id, ((row_number() over (order by ts, event_id) - 1) // 50)::bigint as batch_id from events",
    "pseudo_groups": "select o_orderkey, ((row_number() over (order by o_orderkey) - 1) // 100)::bigint as pseudo_group from orders",
    "sigma_median": f"""
        with s as (select vec_id, embedding::double[] as e from embeddings order by {HASH.format('vec_id')}, vec_id limit 2000),
        d as (select list_distance(a.e, b.e) as d from s a join s b on a.vec_id < b.vec_id)
        select round(greatest(1e-6, median(d) / sqrt(2.0)), 6) as sigma, (select count(*) from s) as sample_rows from d where d > 0""",
    "score_fixed_refs": f"""with {FIXED} select vec_id, round(score, 6) as score, round(raw, 6) as raw_score,
        round(best, 6) as max_sim, case when best < 1e-8 then 'far' when best > 1 - 1e-8 then 'duplicate' else 'scored' end as zone
        from scored""",
    "score_joined_refs": f"""with {CENTERS}
        select vec_id, round(0.6 - exp(-d2 / 1.28), 6) as score, round(exp(-d2 / 1.28), 6) as max_sim, 'scored' as zone
        from gaps where own = ref""",
    "threshold_quantile": f"with {FIXED} select label, round(quantile_cont(score, 0.9), 6) as tau from scored group by 1",
    "threshold_flags": f"""with {FIXED}, t as (select quantile_cont(score, 0.9) as tau from scored)
        select vec_id, round(tau, 6) as tau, case when score > tau then 1 else 0 end::bigint as is_anomaly from scored, t""",
    "fit_by_key_flags": f"""with recursive {boundary_walk(BY_FLAG, 1.66)},
        sims as (select n.key, f.radius, f.alpha, list_transform(f.sv, lambda s: exp(list_distance(s, n.v) ** 2 / (-2 * 1.66 * 1.66))) as k
                 from numbered n join fitted f using (key)),
        scored as (select key, case when list_max(k) < 1e-8 or list_max(k) > 1 - 1e-8 then -1.0 else radius - list_dot_product(k, alpha) end as score from sims),
        taus as (select key, quantile_cont(score, 0.9) as tau from scored group by 1)
        select key as l_returnflag, count(*) as n_rows, count(*) filter (where score > tau) as n_flagged, round(max(tau), 6) as tau,
               round(sum(score), 3) as total_score from scored join taus using (key) group by 1""",
    "fit_models": model_digest(BY_FLAG, 1.66, "l_returnflag", 4),
    "fit_single": model_digest(ALL_ITEMS, 1.66, None, 4),
    "update_models": model_digest(BY_FLAG, 1.66, "l_returnflag", 4),
    "fit_batches": batch_counts(BY_FLAG, 1.66, "l_returnflag", 100),
    "train_in_batches": batch_counts(BY_FLAG, 1.66, "l_returnflag", 1000, 2000),
    "pca2": f"""with recursive {ITEM_PLANE},
        moved as (select {ITEM_KEYS}, list_transform(list_zip(vectors.v, m), lambda p: p[1] - p[2]) as x from vectors, middle)
        select {ITEM_KEYS}, round(list_dot_product(x, one.v), 5) as pc1, round(list_dot_product(x, two.v), 5) as pc2 from moved, one, two""",
    "pca_models": f"""with recursive {boundary_walk(BY_LABEL, 1.0)}, {PLANE},
        spots as (select label, vec_id, 'row' as kind, null::double as weight, embedding::double[] as x from embeddings
                  union all select key, null, 'support', unnest(alpha), unnest(sv) from fitted),
        moved as (select label, vec_id, kind, weight, list_transform(list_zip(x, m), lambda p: p[1] - p[2]) as x from spots, middle)
        select label, vec_id, kind, round(weight, 6) as weight, round(list_dot_product(x, one.v), 6) as pc1, round(list_dot_product(x, two.v), 6) as pc2
        from moved, one, two""",
    "fit_trace": radius_trace(BY_LABEL, 1.0, "label"),
    "roc_auc": f"with {FIXED}, ranked as (select round(score, 3) as score, case when label = 0 then 1 else 0 end as label from scored) "
    f"select round(auc, 6) as auc, n_pos::bigint as n_pos, n_neg::bigint as n_neg from ({_auc('select * from ranked')})",
    "avg_precision": f"""with {RANKED} select round(sum(pos * tp / (tp + fp)) / max(p), 6) as ap, max(p)::bigint as n_pos from run""",
    "roc_points": f"""with {RANKED}
        select round(score, 3) as threshold, round(fp / n, 6) as fpr, round(tp / p, 6) as tpr from run
        union all select null, 0.0, 0.0""",
    "roc_corners": f"""with {RANKED},
        n as (select *, lead(pos) over (order by score desc) as next_pos, lead(neg) over (order by score desc) as next_neg from run)
        select round(score, 3) as threshold, round(fp / n, 6) as fpr, round(tp / p, 6) as tpr from n
        where next_pos is null or next_pos <> pos or next_neg <> neg
        union all select null, 0.0, 0.0""",
    "pr_points": f"""with {RANKED}
        select round(score, 3) as threshold, round(tp / (tp + fp), 6) as precision, round(tp / p, 6) as recall from run
        union all select null, 1.0, 0.0""",
    "prf1": f"""select event_type, n_rows, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
        round(flag_rate, 6) as flag_rate from (select event_type, {PRF} from ({EVENT_PREDICTIONS}) group by event_type)""",
    "auc_by_group": f"""select user_id, round(auc, 6) as auc, (n_pos + n_neg)::bigint as n_rows
        from ({_auc(f'select user_id, value as score, label from ({SCORED_EVENTS})', 'user_id')}) where n_pos + n_neg >= 5""",
    "session_p95_auc": "select round(auc, 6) as auc, n_pos::bigint as n_pos, n_neg::bigint as n_neg from (" + _auc(
        f"""select quantile_cont(value, 0.95) as score, max(case when k < 2 then 1 else 0 end) as label
            from ({EVENTS_K}) group by user_id""") + ")",
    "class_guard": """select count(*) filter (where toxic = 1) as n_pos, count(*) filter (where toxic = 0) as n_neg,
        case when min(toxic) = max(toxic) then 1 else 0 end::bigint as single_class from labels""",
    "spread_of_metrics": f"""
        with m as (select user_id, {PRF} from ({EVENT_PREDICTIONS}) group by user_id),
        l as (select 'precision' as metric, precision as v from m union all select 'recall', recall from m
              union all select 'f1', f1 from m union all select 'flag_rate', flag_rate from m)
        select metric, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std from l group by 1""",
    "corr_matrix": _matrix(),
    "target_correlation": " union all ".join(
        f"select '{c}' as feature, round({_corr(c, 'l_quantity')}, 6) as r from lineitem" for c in ITEM_FEATURES[1:]),
    "class_means": "select case when l_quantity < 25 then 1 else 0 end::bigint as label, "
    + ", ".join(f"round(avg({c}), 4) as {c}" for c in ITEM_FEATURES[1:]) + " from lineitem group by 1",
    "split_profile": """select l_linestatus, count(*) as n_rows, count(*) filter (where l_quantity >= 25) as n_good,
        count(*) filter (where l_quantity < 25) as n_bad, min(l_quantity) as target_min, max(l_quantity) as target_max,
        round(avg(l_quantity), 4) as target_mean from lineitem group by 1""",
    "diagnosis": "with c as (" + " union all ".join(
        f"select '{c}' as feature, {_corr(c, 'l_quantity')} as r from lineitem" for c in ITEM_FEATURES[1:]) + """)
        select case when max(abs(r)) < 0.1 then 1 else 0 end::bigint as weak_correlations,
               case when (select count(*) from lineitem where l_quantity >= 25) < 100 then 1 else 0 end::bigint as few_good_rows,
               case when min(r) < -0.5 then 1 else 0 end::bigint as strong_negative,
               case when max(r) < 0.3 then 1 else 0 end::bigint as all_weak,
               arg_min(feature, r) as min_feature, round(min(r), 6) as min_r, round(max(r), 6) as max_r,
               (select count(*) from lineitem where l_quantity >= 25) as n_good from c""",
    "feature_screen": "with f as (select *, l_extendedprice * (1 - l_discount) as net, l_extendedprice + 300 * l_quantity as mix from lineitem), c as ("
    + " union all ".join(
        f"select '{c}' as feature, corr({c}, mix) as r from f" for c in ("l_extendedprice", "net", "l_discount", "l_tax", "l_quantity"))
    + "), p as (" + " union all ".join(
        f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from f"
        for a in ("l_extendedprice", "net", "l_discount", "l_tax", "l_quantity")
        for b in ("l_extendedprice", "net", "l_discount", "l_tax", "l_quantity") if a != b)
    + """), beaten as (select distinct x.feature from p join c x on x.feature = p.a join c y on y.feature = p.b
        where abs(p.r) > 0.9 and abs(y.r) > 0.2 and (abs(y.r) > abs(x.r) or (abs(y.r) = abs(x.r) and y.feature < x.feature)))
        select feature, round(r, 6) as r,
               case when abs(r) <= 0.2 or feature in (select feature from beaten) then 0 else 1 end::bigint as kept,
               case when abs(r) <= 0.2 then 'weak' when feature in (select feature from beaten) then 'redundant' else 'ok' end as reason
        from c""",
    "compare_pivot": """select o_orderpriority, """ + ", ".join(
        f"round(avg(o_totalprice) filter (where o_orderstatus = '{s}'), 4) as \"{s}\"" for s in "FOP")
    + " from orders group by 1",
    "summary_stats": """
        with l as (select 'o_totalprice' as metric, try_cast(o_totalprice as double) as v from orders
                   union all select 'o_orderpriority', try_cast(o_orderpriority as double) from orders)
        select metric, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, round(min(v), 4) as min, round(max(v), 4) as max
        from l group by 1""",
    "latency_summary": """select event_type, round(avg(value) * 1000, 4) as mean_ms, round(quantile_cont(value, 0.99) * 1000, 4) as p99_ms,
        round(count(value) / sum(value), 4) as rows_per_s from events group by 1""",
    "report_order": "select event_type, user_id, round(avg(value), 8) as m from events group by 1, 2",
    "buffer_last_n": """select event_type, event_id, age from (select event_type, event_id,
        row_number() over (partition by event_type order by ts desc, event_id desc) as age from events) where age <= 500""",
    "ewma_threshold": """
        with recursive o as (select event_id, user_id, ln(1 + value) as s, row_number() over (partition by user_id order by ts, event_id) as rn from events),
        r as (select event_id, user_id, rn, 3.0::double as used, case when s > 3.0 then 3.0 else 0.9 * 3.0 + 0.1 * s end::double as after,
                     case when s > 3.0 then 0 else 1 end::bigint as accepted from o where rn = 1
              union all
              select o.event_id, o.user_id, o.rn, r.after, case when o.s > r.after then r.after else 0.9 * r.after + 0.1 * o.s end,
                     case when o.s > r.after then 0 else 1 end from r join o on o.user_id = r.user_id and o.rn = r.rn + 1)
        select event_id, round(used, 6) as tau_used, round(after, 6) as tau_after, accepted from r""",
    "stream_window_counts": """select event_type, (floor(epoch_us(ts) / 86400e6) * 86400)::bigint as window_start, count(*) as n,
        round(sum(value), 2) as total from events group by 1, 2""",
    "stream_window_features": _windows(3600, True),
    "stream_score_only": f"""
        with p as (select event_id, event_type, ln(1 + greatest(value, 0)) as v, (epoch_us(ts) % 86400000000) / 3.6e9 as k from events),
        z as (select event_id, event_type, (v - avg(v) over ()) / stddev_pop(v) over () as v,
                     (k - avg(k) over ()) / stddev_pop(k) over () as k from p),
        c as (select event_type, avg(v) as v, avg(k) as k from z group by 1),
        s as (select z.event_id, max(exp(-((z.v - c.v) ** 2 + (z.k - c.k) ** 2) / 2)) as best,
                     0.5 - avg(exp(-((z.v - c.v) ** 2 + (z.k - c.k) ** 2) / 2)) as raw from z join c on true group by 1),
        f as (select event_id, case when best < 1e-8 or best > 1 - 1e-8 then -1.0 else raw end as score from s)
        select event_id, round(score, 6) as score, case when score > 0 then 1 else 0 end::bigint as is_anomaly from f""",
}
