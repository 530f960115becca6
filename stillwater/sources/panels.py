"""Panels of series derived from the driver's tables, the history fit and the online steps, as named SQL relations.

Each relation is one piece of SQL, the same for Spark and for the oracle.  The
oracle gets a statement with just the relations that it needs; Spark reads the
stored ones (see stored.py), so a query is one scan and no shuffle on id.
"""

from __future__ import annotations

import re

from stillwater.functions.kernels import PART, clip, cum, d, ewma

HISTORY = 300
ORDER = 10  # autoregressive lags
LEAST_HISTORY = 50
SEASONS = (6, 128)
SEASONAL_ACF, LEAST_GAIN = 0.25, 0.02
LAGS = range(1, ORDER + 1)


def _gram(columns: list[str], source: str) -> str:
    """Counts, sums and products of `columns` and y per id."""
    pairs = [f"sum({a} * {b}) as s_{a}_{b}" for i, a in enumerate(columns) for b in columns[i:]]
    return f"select id, count(*) as n, sum(y) as s_y, sum(y * y) as s_y_y, {', '.join(f'sum({a}) as s_{a}, sum({a} * y) as s_{a}_y' for a in columns)}, {', '.join(pairs)} from {source} group by id"


def least_squares(name: str, columns: list[str], source: str, mean: str) -> dict[str, str]:
    """Relations that end in `name`(id, n, intercept, b_<column>..., rss): regression of y on columns with an intercept.

    y and the columns are measured from `mean` (a column of source that is
    constant per id); the centred products are factored by Cholesky's method, one
    column a step, and solved backwards.  A column that the ones before it
    explain gets the coefficient zero.
    """
    p = len(columns)
    out = {f"{name}_gram": _gram(columns, source).replace("select id,", f"select id, min({mean}) as mid,", 1)}
    centred = [f"s_{a}_{b} - s_{a} * s_{b} / n as c_{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]
    centred += [f"s_{a}_y - s_{a} * s_y / n as c_{i}_{p}" for i, a in enumerate(columns)]
    out[f"{name}_cov"] = f"select id, n, mid, s_y / n as m_y, s_y_y - s_y * s_y / n as c_{p}_{p}, {', '.join(f's_{a} / n as m_{i}' for i, a in enumerate(columns))}, {', '.join(centred)} from {name}_gram"
    last = f"{name}_cov"
    for k in range(p):
        left = lambda i: "".join(f" - l_{i}_{j} * l_{k}_{j}" for j in range(k))  # noqa: B023, E731
        pivot = f"c_{k}_{k}{left(k)}"
        out[f"{name}_d{k}"] = f"select *, case when {pivot} > 1e-10 * c_{k}_{k} then sqrt({pivot}) end as l_{k}_{k} from {last}"
        out[f"{name}_l{k}"] = f"select *, {', '.join(f'coalesce((c_{k}_{i}{left(i)}) / l_{k}_{k}, 0e0) as l_{i}_{k}' for i in range(k + 1, p + 1))} from {name}_d{k}"
        last = f"{name}_l{k}"
    for k in reversed(range(p)):
        out[f"{name}_b{k}"] = f"select *, coalesce((l_{p}_{k}{''.join(f' - l_{j}_{k} * b_{columns[j]}' for j in range(k + 1, p))}) / l_{k}_{k}, 0e0) as b_{columns[k]} from {last}"
        last = f"{name}_b{k}"
    intercept = f"mid + m_y{''.join(f' - b_{a} * (mid + m_{i})' for i, a in enumerate(columns))}"
    out[name] = f"select id, n, {intercept} as intercept, greatest(c_{p}_{p}{''.join(f' - l_{p}_{k} * l_{p}_{k}' for k in range(p))}, 0e0) as rss, {', '.join(f'b_{a}' for a in columns)} from {last}"
    return out


_X = [f"x{k}" for k in LAGS]
_DOT = " + ".join(f"phi{k} * x{k}" for k in LAGS)
_SEASON = SEASONS[1] + 10

RELATIONS: dict[str, str] = {
    "panel0": """select l_suppkey as id, cast(row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as int) as tt,
         cast(l_quantity as double) as x0, case when l_suppkey % 2 = 1 then cast(40 + (l_suppkey * 37) % 150 as int) end as tau_index from lineitem""",
    "panel": f"""select id, tt, case when tt <= {HISTORY} then 1 else 2 end as period,
         case when tau_index is not null and tt - {HISTORY} - 1 >= tau_index then case when id % 3 = 0 then x0 * 2 when id % 3 = 1 then x0 + 20 else x0 * (1 - 2 * (tt % 2)) end else x0 end as x, tau_index from panel0""",
    "online": f"select id, tt - {HISTORY} as t, x, tau_index, case when tau_index is not null and tt - {HISTORY} - 1 >= tau_index then 1 else 0 end as y from panel where period = 2",
    "lagged": f"select id, tt, period, x, tau_index, {', '.join(f'lag(x, {k}) over (partition by id order by tt) as x{k}' for k in LAGS)} from panel",
    "moments": "select id, count(*) as n_h, avg(x) as mu0, greatest(coalesce(stddev_samp(x), 1e0), 1e-8) as sigma0, greatest(coalesce(var_samp(x), 1e0), 1e-12) as var_x from panel where period = 1 group by id",
    "design": f"select l.id, mu0, x - mu0 as y, {', '.join(f'x{k} - mu0 as x{k}' for k in LAGS)} from lagged l join moments m on l.id = m.id where period = 1 and x{ORDER} is not null and n_h > {ORDER + 5}",
    **least_squares("ar", _X, "design", "mu0"),
    "plain": f"select m.id, n_h, mu0, sigma0, var_x, coalesce(1 - a.rss / (a.n - 1) / var_x, 0e0) as r2, coalesce(1 - a.rss / (a.n - 1) / var_x, 0e0) >= {d(LEAST_GAIN)} as fits, intercept, {', '.join(f'b_x{k}' for k in LAGS)} from moments m left join ar a on m.id = a.id",
    "fit0": f"select id, n_h, mu0, sigma0, var_x, r2 as ar_r2, case when fits then intercept else mu0 end as c, {', '.join(f'case when fits then b_x{k} else 0e0 end as phi{k}' for k in LAGS)} from plain",
    "resid0": f"select l.id, tt, x - c - ({_DOT}) as r from lagged l join fit0 f on l.id = f.id where period = 1 and x{ORDER} is not null",
    # the season: the lag whose autocorrelation of the residuals is furthest from zero, the first of equals
    "level": f"select id, avg(r) as m, count(*) as n from resid0 group by id having count(*) > {_SEASON}",
    "around": "select r.id, tt, r - m as r from resid0 r join level v on r.id = v.id",
    "acf": f"select a.id, b.tt - a.tt as k, sum(a.r * b.r) as num from around a join around b on a.id = b.id and b.tt - a.tt between {SEASONS[0]} and {SEASONS[1]} group by a.id, b.tt - a.tt",
    "power": "select id, sum(r * r) as den from around group by id",
    "season": f"select id, k as season from (select a.id, k, row_number() over (partition by a.id order by abs(num / den) desc, k) as place from acf a join power p on a.id = p.id where den > 0 and abs(num / den) > {d(SEASONAL_ACF)}) q where place = 1",
    "design2": f"select l.id, mu0, l.x - mu0 as y, {', '.join(f'x{k} - mu0 as x{k}' for k in LAGS)}, b.x - mu0 as xs from lagged l join season s on l.id = s.id join moments m on l.id = m.id join panel b on l.id = b.id and l.tt - s.season = b.tt where l.period = 1 and x{ORDER} is not null",
    **least_squares("sar", [*_X, "xs"], "design2", "mu0"),
    "fit": f"select f.id, n_h, mu0, sigma0, season, coalesce(1 - s.rss / (s.n - 1) / var_x, ar_r2) as ar_r2, coalesce(s.intercept, c) as c, coalesce(b_xs, 0e0) as phi_season, {', '.join(f'coalesce(b_x{k}, phi{k}) as phi{k}' for k in LAGS)} from fit0 f left join sar s on f.id = s.id left join season q on f.id = q.id",
    "seasoned": "select l.*, b.x as xs from (select l.*, c, phi_season, mu0, sigma0, n_h, season, " + ", ".join(f"phi{k}" for k in LAGS) + " from lagged l join fit f on l.id = f.id) l left join panel b on l.id = b.id and l.tt - l.season = b.tt",
    "resid": f"select id, tt as t, x - c - ({_DOT}) - coalesce(phi_season * xs, 0e0) as r from seasoned where period = 1 and tt > greatest({ORDER}, coalesce(season, 0))",
    "scale": "select id, greatest(coalesce(stddev_samp(r), 1e0), 1e-8) as sigma_e from resid group by id",
    "ehist0": "select r.id, t, r / sigma_e as e from resid r join scale s on r.id = s.id",
    "ehist": f"select id, t, e, lag(e) over ({PART}) as e1 from ehist0",
    "level_e": "select id, avg(e) as me, avg(abs(e)) as ma from ehist group by id",
    "shape": """select h.id, count(*) as n_e, {pct}(e, 0.01) as q01, {pct}(e, 0.05) as q05, {pct}(e, 0.10) as q10, {pct}(e, 0.25) as q25, {pct}(e, 0.5) as q50, {pct}(e, 0.75) as q75, {pct}(e, 0.9) as q90, {pct}(e, 0.95) as q95, {pct}(e, 0.99) as q99,
         {pct}(abs(e), 0.95) as qa95, {pct}(abs(e), 0.99) as qa99, coalesce(sum((e - me) * (e1 - me)) / nullif(sum((e - me) * (e - me)), 0), 0e0) as rho1_e, coalesce(sum((abs(e) - ma) * (abs(e1) - ma)) / nullif(sum((abs(e) - ma) * (abs(e) - ma)), 0), 0e0) as rho1_abs_e,
         greatest(coalesce(stddev_samp(e * e1), 1e0), 1e-8) as sigma_u, avg(e * e) as m2, avg(e * e * e * e) as m4 from ehist h join level_e v on h.id = v.id group by h.id""",
    "h0": "select f.id, n_h, n_e, mu0, sigma0, c, season, phi_season, " + ", ".join(f"phi{k}" for k in LAGS) + ", ar_r2, sigma_e, q01, q05, q10, q25, q50, q75, q90, q95, q99, qa95, qa99, rho1_e, rho1_abs_e, sigma_u, m2, m4 from fit f join scale s on f.id = s.id join shape q on f.id = q.id",
    "inn0": f"select l.id, cast(l.tt - l.n_h as int) as t, l.x, l.tau_index, (x - l.c - ({_DOT.replace('phi', 'l.phi')}) - coalesce(l.phi_season * xs, 0e0)) / sigma_e as e_raw, l.n_h, n_e, l.mu0, l.sigma0, q10, q25, q50, q75, qa95, qa99, rho1_abs_e, sigma_u from seasoned l join h0 h on l.id = h.id where period = 2",
    "inn1": f"select *, {clip('e_raw', -8, 8)} as e from inn0",
    "inn2": f"select *, case when rho1_abs_e > 0.15 then e / sqrt(greatest({ewma('e * e', 0.06, 1.0)}, 1e-12)) else e end as e_vol from inn1",
    "inn": f"select *, e * e as e2, lag(e_vol) over ({PART}) as v1, lag(e) over ({PART}) as e1, case when tau_index is not null and t - 1 >= tau_index then 1 else 0 end as y from inn2",
    # two detectors: score_a an EWMA z-score, score_b the largest mean CUSUM, squashed
    "scored0": f"select id, t, y, tau_index, abs({ewma('(x - mu0) / sigma0', 0.05)}) / sqrt(0.05e0 / 1.95e0 * (1 - power(0.9025e0, t))) as za, {cum('0.5e0 * e_vol - 0.125e0')} as cp, {cum('-0.5e0 * e_vol - 0.125e0')} as cn from inn",
    "scored1": f"select *, cp - least(0e0, {cum('cp', 'min')}) as sp, cn - least(0e0, {cum('cn', 'min')}) as sn from scored0",
    "scores": "select id, t, y, tau_index, round(tanh(za / 3e0), 9) as score_a, round(1e0 / (1e0 + exp(-(0.4e0 * sqrt(2e0 * greatest(sp, sn))))), 9) as score_b, case when t <= 50 then 't<=50' when t <= 150 then '50<t<=150' when t <= 400 then '150<t<=400' else 't>400' end as bucket from scored1",
}

#: Regressions: Spark solves each series' normal equations from its sums (stored.py), the oracle factors them in SQL.
SOLVED = {"ar": _X, "sar": [*_X, "xs"]}
#: Relations that Spark computes from another one's rows, a series at a time (stored.py); the oracle joins and aggregates.
BY_SERIES = {"season": "resid0"}

#: Relations that Spark keeps as tables, each from the ones before it.
STORED = ("panel", "season", "fit", "resid", "ehist", "h0", "inn", "scores")


def used(sql: str) -> set[str]:
    """The relations that a statement reads."""
    return {name for name in re.findall(r"(?:from|join) (\w+)", sql) if name in RELATIONS}


def needed(sql: str, have: tuple[str, ...] = ()) -> list[str]:
    """The relations that a statement needs, in order; those in `have` are there already and are not followed."""
    found, todo = set(), used(sql)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo |= set() if name in have else used(RELATIONS[name])
    return [name for name in RELATIONS if name in found]


def statement(body: str, dialect: str, more: str = "", have: tuple[str, ...] = ()) -> str:
    """A full statement in the dialect ('spark' or 'duckdb'); a relation in `have` reads a frame of its name."""
    parts = []
    for name in needed(f"{more} {body}", have):
        sql = f"select * from {{{name}}}" if name in have else RELATIONS[name]
        parts.append(f"{name} as {'materialized ' if dialect == 'duckdb' else ''}({sql})")
    sql = ("with " if parts or more else "") + ", ".join([*parts, *([more] if more else [])]) + "\n" + body
    return sql.replace("{pct}", "percentile" if dialect == "spark" else "quantile_cont")


__all__ = ["HISTORY", "BY_SERIES", "RELATIONS", "SOLVED", "STORED", "d", "least_squares", "needed", "statement"]
