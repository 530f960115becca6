"""Reports over the break census: axes, detectability, power, correlations, contributions, gates of one panel."""

from __future__ import annotations

from stillwater.functions.kernels import cum, d, lag, roll
from stillwater.operators.evaluation import by_step

LEAST_SEGMENT = 10

#: How each broken series changed at its break; segments shorter than LEAST_SEGMENT on either side are left out.
CENSUS = (
    f"seg as (select i.id, i.tau_index, t, y, x, e, {lag('e').replace('partition by id', 'partition by i.id, y')} as e1 from inn i where i.tau_index is not null), "
    "seg_m as (select id, y, avg(e) as me from seg group by id, y), "
    "seg_s as (select s.id, s.tau_index, s.y, count(*) as n, avg(x) as mx, avg(e) as me, var_samp(x) as vx, var_samp(e) as ve, avg(case when abs(e) > 2 then 1e0 else 0e0 end) as ex, sum((e - me) * (e1 - me)) as c1, sum((e - me) * (e - me)) as c0, sum(power(e - me, 4)) as c4 from seg s join seg_m m on s.id = m.id and s.y = m.y group by s.id, s.tau_index, s.y), "
    "seg_k as (select *, case when c0 > 0 then c1 / c0 end as rho, case when n > 3 and c0 > 0 then (n - 1e0) / ((n - 2e0) * (n - 3e0)) * ((n + 1e0) * (c4 / n / (c0 / n * c0 / n) - 3) + 6) end as kurt from seg_s), "
    "census as (select a.id, a.tau_index, a.n as n_pre, b.n as n_post, (b.mx - a.mx) / greatest(sqrt(a.vx), 1e-8) as delta_mean_x, (b.me - a.me) / greatest(sqrt(a.ve), 1e-8) as delta_mean_e, "
    "ln(greatest(b.vx, 1e-12)) - ln(greatest(a.vx, 1e-12)) as delta_logvar_x, ln(greatest(b.ve, 1e-12)) - ln(greatest(a.ve, 1e-12)) as delta_logvar_e, b.rho - a.rho as delta_rho1, b.kurt - a.kurt as delta_kurt, b.ex - a.ex as delta_exceed, "
    f"{' + '.join(f'phi{k}' for k in range(1, 11))} as sum_phi, h.ar_r2 from seg_k a join seg_k b on a.id = b.id and a.y = 0 and b.y = 1 join h0 h on a.id = h.id where a.n >= {LEAST_SEGMENT} and b.n >= {LEAST_SEGMENT})"
)
DELTAS = ("delta_mean_x", "delta_mean_e", "delta_logvar_x", "delta_logvar_e", "delta_rho1", "delta_kurt", "delta_exceed", "sum_phi")
#: Axes of a break by their census column, in the order that settles ties.
AXES = {"variance": "delta_logvar_e", "dependence": "delta_rho1", "exceedance": "delta_exceed", "kurtosis": "delta_kurt", "mean": "delta_mean_e"}
_FORM = ("delta_logvar_e", "delta_rho1", "delta_kurt", "delta_exceed")


def _parts(value: str, source: str, n: int, name: str, within: str = "") -> str:
    """{name}: rows of source with `part` from 0 to n - 1 by the quantiles of value (right-closed), inside each group of `within`."""
    cuts = ", ".join(f"round({{pct}}(round({value}, 9), {k / n!r}), 9) as q{k}" for k in range(1, n))
    part = " + ".join(f"case when round({value}, 9) > q{k} then 1 else 0 end" for k in range(1, n))
    on = f"join {name}_q on s.{within} = {name}_q.g" if within else f"cross join {name}_q"
    group = f" group by {within}" if within else ""
    return f"{name}_q as (select {f'{within} as g, ' if within else ''}{cuts} from {source} where {value} is not null{group}), {name} as (select s.*, {part} as part from {source} s {on} where {value} is not null)"


_SDS = f"sds as (select {', '.join(f'stddev_pop({c}) as sd_{k}' for k, c in AXES.items())} from census)"
_Z = {k: f"(case when sd_{k} > 0 then abs({c}) / sd_{k} else 0e0 end)" for k, c in AXES.items()}
DOMINANT = (
    f"{CENSUS}, {_SDS}, axes0 as (select id, {', '.join(f'coalesce({z}, -1e0) as z_{k}' for k, z in _Z.items())} from census cross join sds), "
    f"axes1 as (select *, greatest({', '.join(f'z_{k}' for k in AXES)}) as axis_mag from axes0), "
    f"dominant as (select id, case {' '.join(f"when z_{k} = axis_mag then '{k}'" for k in AXES)} end as axis, axis_mag from axes1)"
)
_SD4 = f"sd4 as (select {', '.join(f'stddev_pop({c}) as s{i}' for i, c in enumerate(_FORM))} from census)"
DIVERGENCE = f"{CENSUS}, {_SD4}, diverged as (select c.*, sqrt({' + '.join(f'case when s{i} > 0 then coalesce(power({c} / s{i}, 2), 0e0) else 0e0 end' for i, c in enumerate(_FORM))}) as divergence from census c cross join sd4)"
T_MAX = 50
DETECT = (
    f"{DIVERGENCE}, found as (select *, least(greatest({T_MAX} - tau_index, 0), n_post) as m_bucket, divergence * sqrt(cast(least(greatest({T_MAX} - tau_index, 0), n_post) as double)) as detectability from diverged), "
    f"early as (select id, avg(case when y = 1 then score_a end) - avg(case when y = 0 then score_a end) as gap from scores where t <= {T_MAX} group by id), "
    f"both_d as (select f.*, gap from found f join early e on f.id = e.id where gap is not null), {_parts('detectability', 'both_d', 5, 'quint')}"
)
DEV = "dev as (select id, t, y, tau_index, score_a - avg(score_a) over (partition by t) as xs_dev from scores)"


def normal_cdf(z: str) -> str:
    """The normal distribution function by Abramowitz and Stegun's formula 26.2.17 (error below 7.5e-8)."""
    k = f"(1e0 / (1e0 + 0.2316419e0 * abs({z})))"
    tail = f"(exp(-0.5e0 * {z} * {z}) * 0.3989422804014327e0 * {k} * (0.319381530e0 + {k} * (-0.356563782e0 + {k} * (1.781477937e0 + {k} * (-1.821255978e0 + {k} * 1.330274429e0)))))"
    return f"(case when {z} >= 0 then 1e0 - {tail} else {tail} end)"


Z_ALPHA = 1.6448536269514722  # one-sided 5 %

#: Contributions of a closed-form score's terms, one column a term.
TERMS = {
    "accum_mean": f"0.4e0 * abs({roll('e_vol', 50, 'avg')})", "accum_var": f"0.3e0 * abs({roll('e2', 50, 'avg')} - 1)", "cusum_mean": f"0.2e0 * abs({cum('e_vol', 'avg')})",
    "meta_t": "0.001e0 * t", "meta_h0_rho1_abs_e": "0.5e0 * rho1_abs_e", "dep_rho1": f"0.3e0 * abs({roll('coalesce(e_vol * v1, 0e0)', 50, 'avg')})",
}
CONTRIBUTIONS = (
    f"wide as (select id, t, y, {', '.join(f'round({v}, 9) as {k}' for k, v in TERMS.items())} from inn), "
    f"tall as ({' union all '.join(f"select '{k}' as feature, id, t, y, {k} as v from wide" for k in TERMS)})"
)
FAMILY = "case when left(feature, 8) = 'meta_h0_' then 'meta_h0' when left(feature, 5) = 'meta_' then 'meta_time' else split_part(feature, '_', 1) end"
_BUCKET = "case when t <= 50 then 't<=50' when t <= 150 then '50<t<=150' when t <= 400 then '150<t<=400' else 't>400' end"
SHARES = f"{CONTRIBUTIONS}, by_t as (select feature, t, stddev_pop(v) as sd, avg(abs(v)) as mag, cast(sum(y) * (count(*) - sum(y)) as double) as w from tall group by feature, t)"

QUERIES: dict[str, tuple[str, str]] = {
    "census": (CENSUS, f"select id, tau_index, n_pre, n_post, {', '.join(f'round({c}, 6) as {c}' for c in (*DELTAS, 'ar_r2'))} from census"),
    "census_correlations": (
        CENSUS,
        "select " + ", ".join(f"round({{pct}}({c}, 0.5), 6) as median_{c}" for c in DELTAS) + ", round(avg(case when abs(delta_mean_e) > 0.3 then 1e0 else 0e0 end), 6) as frac_mean_shift, round(avg(case when abs(delta_logvar_e) > 0.3 then 1e0 else 0e0 end), 6) as frac_var_shift, "
        + ", ".join(f"round(corr({a}, {b}), 6) as corr_{a}_{b}" for i, a in enumerate(DELTAS) for b in DELTAS[i + 1 :]) + ", count(*) as n_series from census",
    ),
    "dominant_axis": (DOMINANT, "select id, axis, round(axis_mag, 6) as axis_mag from dominant"),
    "axis_join": (f"{DOMINANT}, strong as (select id from dominant where axis_mag >= 1)", "select s.id, s.t, d.axis, case when k.id is null then 0 else 1 end as is_strong from scores s left join dominant d on s.id = d.id left join strong k on s.id = k.id where s.y = 1"),
    "axis_members": (f"{DOMINANT}", "select s.id, count(*) as n_rows from scores s where s.id in (select id from dominant where axis = 'variance') group by s.id"),
    "auc_by_axis": (
        f"{DOMINANT}, {_parts('axis_mag', 'dominant', 3, 'third', 'axis')}, groups as (select distinct axis, part from third), broken as (select distinct id from scores where y = 1), "
        "clean as (select s.t, s.y, s.score_a from scores s left join broken b on s.id = b.id where b.id is null), "
        "framed as (select axis, part, t, y, score_a from clean cross join groups union all select axis, part, s.t, s.y, s.score_a from scores s join third d on s.id = d.id where s.y = 1), "
        f"{by_step('score_a', 'ax', 'framed', 'axis, part, t', '')}, sizes as (select axis, part, count(*) as n_series from third group by axis, part)",
        "select a.axis, a.part as tercile, round(sum(w * auc) / sum(w), 6) as ts_auc, max(n_series) as n_series from ax a join sizes z on a.axis = z.axis and a.part = z.part group by a.axis, a.part",
    ),
    "step_response_tercile": (
        f"{DIVERGENCE}, {_parts('divergence', 'diverged', 3, 'third')}, {DEV}, resp as (select part, t - 1 - s.tau_index as shift, avg(xs_dev) as m from dev s join third d on s.id = d.id where t - 1 - s.tau_index between -30 and 200 group by part, t - 1 - s.tau_index), "
        "control as (select avg(xs_dev) as c from dev s left join (select distinct id from scores where y = 1) b on s.id = b.id where b.id is null)",
        "select part as tercile, shift, round(m, 6) as mean_dev, round(avg(m) over (partition by part order by shift rows between 2 preceding and 2 following), 6) as smoothed, round(c, 6) as control_level from resp cross join control",
    ),
    "step_response_pivot": (
        f"{DIVERGENCE}, {_parts('divergence', 'diverged', 3, 'third')}, {DEV}, resp as (select part, t - 1 - s.tau_index as shift, xs_dev from dev s join third d on s.id = d.id where t - 1 - s.tau_index between -30 and 200)",
        "select shift, round(avg(case when part = 0 then xs_dev end), 6) as low, round(avg(case when part = 1 then xs_dev end), 6) as middle, round(avg(case when part = 2 then xs_dev end), 6) as high from resp group by shift",
    ),
    "detectability": (DETECT, "select id, tau_index, n_post, m_bucket, round(divergence, 6) as divergence, round(detectability, 6) as detectability, round(gap, 6) as gap, part as quintile from quint"),
    "detectability_quintiles": (DETECT, "select part as quintile, count(*) as n, round({pct}(detectability, 0.5), 6) as detect_median, round({pct}(divergence, 0.5), 6) as divergence_median, round({pct}(m_bucket, 0.5), 6) as m_median, round({pct}(gap, 0.5), 6) as gap_median, round(avg(case when gap <= 0 then 1e0 else 0e0 end), 6) as frac_not_up from quint group by part"),
    "census_gap_join": (DETECT, "select c.id, round(c.delta_logvar_e, 6) as delta_logvar_e, round(e.gap, 6) as gap from census c join early e on c.id = e.id where e.gap is not null"),
    "power_envelope": (
        f"{CENSUS}, {by_step('score_a')}, size0 as (select {{pct}}(abs(delta_mean_e), 0.5) as delta from census), obs as (select bucket, sum(w * auc) / sum(w) as auc from steps group by bucket), "
        "post as (select bucket, {pct}(cast(t - tau_index as double), 0.5) as m from scores where y = 1 group by bucket)",
        f"select o.bucket, round(auc, 6) as auc_obs, round(m, 6) as median_m, round({normal_cdf(f'(delta * sqrt(greatest(m, 0e0)) - {d(Z_ALPHA)})')}, 6) as power_env, round({normal_cdf(f'(delta * sqrt(greatest(m, 0e0)) - {d(Z_ALPHA)})')} - auc, 6) as gap from obs o left join post p on o.bucket = p.bucket cross join size0",
    ),
    "xs_contribution": (f"{SHARES}, tot as (select feature, sum(sd * w) / sum(w) as xs, avg(mag) as mean_abs from by_t group by feature)", f"select feature, {FAMILY} as family, round(mean_abs, 6) as mean_abs, round(xs, 6) as xs_share, row_number() over (order by round(xs, 9) desc, feature) as place from tot"),
    "xs_contribution_bucket": (f"{SHARES}", f"select {_BUCKET} as t_bucket, feature, {FAMILY} as family, round(sum(sd * w) / sum(w), 6) as xs_share from by_t group by {_BUCKET}, feature having sum(w) > 0"),
    "contribution_top": (f"{SHARES}, tot as (select feature, round(sum(sd * w) / sum(w), 9) as xs from by_t group by feature)", "select feature, round(xs, 6) as xs_share from tot order by xs desc, feature limit 3"),
    "contribution_family": (f"{SHARES}, tot as (select feature, {_BUCKET} as b, sum(sd * w) / sum(w) as xs from by_t group by feature, {_BUCKET} having sum(w) > 0)", f"select {FAMILY} as family, round(sum(case when b = 't<=50' then xs end), 6) as t050, round(sum(case when b = '50<t<=150' then xs end), 6) as t150, round(sum(case when b = '150<t<=400' then xs end), 6) as t400 from tot group by {FAMILY}"),
    "gate_eval": ("tm as (select t, avg(score_a) as m, {pct}(score_a, 0.5) as md from scores group by t)", "select round(min(case when t >= 50 then md end), 6) as min_median_after_50, min(case when t >= 50 then md end) >= 0.65 as passes from tm"),
}
