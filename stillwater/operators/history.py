"""Operators on a series' history: fit, quantiles, fingerprint, precursors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from stillwater.functions.kernels import PART, d, ewma, lag, r6
from stillwater.sources import panels, stored

_Q = ("q01", "q05", "q10", "q25", "q50", "q75", "q90", "q95", "q99", "qa95", "qa99")

HURST = (
    "sizes as (select 1 as m union all select 2 union all select 4 union all select 8 union all select 16), rn as (select id, e, row_number() over (partition by id order by t) - 1 as i, count(*) over (partition by id) as n from ehist), blk as (select id, m, cast(floor(i / m) as int) as b, avg(e) as a, count(*) as c, max(n) as n from rn cross join sizes group by id, m, cast(floor(i / m) as int)), vm as (select id, m, var_samp(a) as v, count(*) as nb from blk where c = m group by id, m having count(*) >= 8), "
    "f_hurst as (select id, case when count(*) >= 3 then 1 + regr_slope(ln(v), ln(cast(m as double))) / 2 else 0.5e0 end as hurst from vm where v > 0 group by id)"
)
HILL = "ord as (select id, abs(e) as a, row_number() over (partition by id order by abs(e) desc) as k, greatest(10, cast(floor(0.05e0 * count(*) over (partition by id)) as int)) as m from ehist), cut as (select id, a as floor_a from ord where k = m + 1), f_hill as (select o.id, avg(ln(o.a / c.floor_a)) as hill_xi from ord o join cut c on o.id = c.id where o.k <= o.m and c.floor_a > 0 group by o.id)"
VOLVOL = f"rb as (select id, e, cast(floor((row_number() over ({PART}) - 1) / 50) as int) as b from ehist), bv as (select id, b, var_samp(e) as v from rb group by id, b having count(*) = 50), f_vol as (select id, stddev_samp(v) / avg(v) as volvol from bv group by id)"
RATIO = "f_iqr as (select id, (q75 - q25) / nullif(q99 - q01, 0) as iqr_tail_ratio from h0)"


def acf_ctes(lags: int = 10) -> str:
    """f_acf: first autocorrelation of e^2, mean and portmanteau of those of |e|, and their decay over lags (from 3 lags)."""
    ctes = "ac0 as (select id, t, abs(e) - avg(abs(e)) over (partition by id) as a, e * e - avg(e * e) over (partition by id) as q from ehist), "
    ctes += f"ac1 as (select id, a, q, {lag('q')} as q1, {', '.join(f'{lag("a", k)} as a{k}' for k in range(1, lags + 1))} from ac0), "
    ctes += f"ac2 as (select id, count(*) as n, sum(q * q1) / sum(q * q) as rq, {', '.join(f'sum(a * a{k}) / sum(a * a) as r{k}' for k in range(1, lags + 1))} from ac1 group by id), "
    ctes += f"ac3 as ({' union all '.join(f'select id, {k}e0 as k, abs(r{k}) as r from ac2' for k in range(1, lags + 1))}), "
    ctes += "ac4 as (select id, case when count(*) >= 3 then regr_slope(ln(r), ln(k)) end as decay from ac3 where r > 1e-6 group by id), "
    r = [f"r{k}" for k in range(1, lags + 1)]
    mass, box = " + ".join(f"abs({x})" for x in r), " + ".join(f"{x} * {x} / (n - {k})" for k, x in enumerate(r, 1))
    return ctes + f"f_acf as (select ac2.id, rq as acf_e2_l1, ({mass}) / {lags} as acf_abs_mass, decay as acf_decay, n * (n + 2e0) * ({box}) / {lags} as ljungbox_abs from ac2 left join ac4 on ac2.id = ac4.id)"


#: ln of the periodogram against ln of the frequency, by direct sums (the oracle's way; Spark transforms each series).
SPECTRUM = (
    "sp_e as (select id, row_number() over (partition by id order by t) - 1 as i, count(*) over (partition by id) as n, e - avg(e) over (partition by id) as x from ehist), "
    "sp_k as (select id, n, i + 1 as k from sp_e where i + 1 <= floor(n / 2)), "
    f"sp_p as (select k.id, k.k, k.n, power(sum(x * cos({d(2 * np.pi)} * ((k.k * e.i) % k.n) / k.n)), 2) + power(sum(x * sin({d(2 * np.pi)} * ((k.k * e.i) % k.n) / k.n)), 2) as p from sp_k k join sp_e e on k.id = e.id group by k.id, k.k, k.n), "
    "f_spec as (select id, case when max(n) >= 64 and count(*) >= 16 then regr_slope(ln(p), ln(cast(k as double) / n)) else 0e0 end as spectral_slope from sp_p where p > 0 group by id)"
)
SPECTRAL = (SPECTRUM, f"select id, {r6('spectral_slope', 'spectral_slope')} from f_spec")


def spectral_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, spectral_slope: one fast transform a series, in a grouped map (a series' history is of bounded length)."""

    def slope(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("t")["e"].to_numpy()
        out, n = 0.0, len(x)
        if n >= 64:
            power, freq = np.abs(np.fft.rfft(x - x.mean())) ** 2, np.fft.rfftfreq(n)
            use = (freq > 0) & (power > 0)
            if use.sum() >= 16:
                out = float(np.polyfit(np.log(freq[use]), np.log(power[use]), 1)[0])
        return pd.DataFrame({"id": g["id"].iloc[:1], "spectral_slope": [round(out, 6) + 0.0]})

    return stored.run(spark, sf_dir, "select id, t, e from ehist").groupBy("id").applyInPandas(slope, "id long, spectral_slope double")


def precursors(window: int = 40, tail: float = 0.4) -> tuple[str, str]:
    """Slopes over the history's tail of rolling first autocorrelation, log variance and skewness, and the autocorrelation's change.

    Windows start every half window; fewer than four give zeros.
    """
    stride = max(window // 2, 1)
    ctes = (
        f"pc_e as (select id, row_number() over (partition by id order by t) - 1 as i, count(*) over (partition by id) as n, e from ehist), "
        f"pc_t as (select id, i - cast(floor(n * {d(1 - tail)}) as int) as j, n - cast(floor(n * {d(1 - tail)}) as int) as size, e from pc_e where i >= cast(floor(n * {d(1 - tail)}) as int)), "
        f"pc_s as (select id, cast(floor(j / {stride}) as int) as k, size from pc_t where j % {stride} = 0 and j + {window} <= size), "
        f"pc_w as (select s.id, s.k, t.j, t.e, avg(t.e) over (partition by s.id, s.k) as m, lag(t.e) over (partition by s.id, s.k order by t.j) as e1 from pc_s s join pc_t t on s.id = t.id and t.j >= s.k * {stride} and t.j < s.k * {stride} + {window}), "
        "pc_v as (select id, k, sum((e - m) * (e1 - m)) / nullif(sum((e - m) * (e - m)), 0) as ac, var_samp(e) as v, sum(power(e - m, 3)) / count(*) as c3 from pc_w group by id, k), "
        "pc_x as (select *, count(*) over (partition by id) as w, coalesce(ac, 0e0) as a, ln(greatest(v, 1e-12)) as lv, c3 / power(sqrt(greatest(v, 1e-12)), 3) as sk from pc_v), "
        "pc as (select id, regr_slope(a, k / (w - 1e0)) as s_a, regr_slope(lv, k / (w - 1e0)) as s_v, regr_slope(sk, k / (w - 1e0)) as s_s, max(case when k = w - 1 then a end) - max(case when k = 0 then a end) as change from pc_x where w >= 4 group by id)"
    )
    pick = lambda x, name: r6(f"coalesce({x}, 0e0)", name)
    return ctes, f"select h.id, {pick('s_a', 'precursor_ac1_slope')}, {pick('s_v', 'precursor_var_slope')}, {pick('s_s', 'precursor_skew_slope')}, {pick('change', 'precursor_ac1_last_minus_first')} from h0 h left join pc on h.id = pc.id"


FINGERPRINT = ("hurst", "hill_xi", "acf_e2_l1", "acf_abs_mass", "acf_decay", "ljungbox_abs", "volvol", "iqr_tail_ratio")
_NU = "case when m4 / (m2 * m2) - 3 <= 0 then 50e0 else greatest(5e0, least(50e0, 4 + 6 / (m4 / (m2 * m2) - 3))) end"
FINGERPRINTS = f"{HURST}, {HILL}, {acf_ctes()}, {VOLVOL}, {RATIO}"
_JOINED = "h0 h left join f_hurst fa on h.id = fa.id left join f_hill fb on h.id = fb.id left join f_acf fc on h.id = fc.id left join f_vol fd on h.id = fd.id left join f_iqr fe on h.id = fe.id"


def statements() -> dict[str, tuple[str, str]]:
    return {
        "h0_moments": ("", "select id, n_h, round(mu0, 6) as mu0, round(sigma0, 6) as sigma0, round(sigma_e, 6) as sigma_e from h0"),
        "h0_ar10": ("", f"select id, round(c, 6) as c, {', '.join(f'round(phi{k}, 6) + 0e0 as phi{k}' for k in panels.LAGS)}, round(ar_r2, 6) as ar_r2 from fit"),
        "h0_season": ("", "select id, season, round(phi_season, 6) as phi_season from fit"),
        "h0_quantiles": ("", f"select id, {', '.join(f'round({q}, 6) as {q}' for q in _Q)} from h0"),
        "h0_dependence": ("", "select id, round(rho1_e, 6) as rho1_e, round(rho1_abs_e, 6) as rho1_abs_e, round(sigma_u, 6) as sigma_u from h0"),
        "h0_tail": ("", f"select id, round({_NU}, 6) as nu_hat from h0"),
        "h0_robust_scale": ("med as (select id, {pct}(r, 0.5) as m from resid group by id)", "select r.id, round(greatest(1.4826e0 * {pct}(abs(r.r - m.m), 0.5), 1e-8), 6) as sigma_e_rob from resid r join med m on r.id = m.id group by r.id"),
        "h0_sorted": ("", "select id, cast(row_number() over (partition by id order by e, t) as int) as place, round(e, 6) as sorted_e, row_number() over (partition by id order by t desc) <= 10 as seeds_lags from ehist"),
        "history_evol": ("hv0 as (select h.id, cast(row_number() over (partition by h.id order by h.t) as int) as t, e, rho1_abs_e from ehist h join (select id as id_h, rho1_abs_e from h0) q on h.id = q.id_h)", f"select id, t, {r6(f'case when rho1_abs_e > 0.15 then e / sqrt(greatest({ewma("e * e", 0.06, 1.0)}, 1e-12)) else e end', 'e_vol')} from hv0"),
        "fingerprint_hill": (HILL, "select id, round(hill_xi, 6) as hill_xi from f_hill"),
        "fingerprint_hurst": (HURST, "select id, round(hurst, 6) as hurst from f_hurst"),
        "fingerprint_volvol": (f"{VOLVOL}, {RATIO}", "select e.id, round(volvol, 6) as volvol, round(iqr_tail_ratio, 6) as iqr_tail_ratio from f_iqr e left join f_vol d on e.id = d.id"),
        "fingerprint_acf": (acf_ctes(), f"select id, {r6('acf_e2_l1', 'acf_e2_l1')}, {r6('acf_abs_mass', 'acf_abs_mass')}, {r6('acf_decay', 'acf_decay')}, {r6('ljungbox_abs', 'ljungbox_abs', 4)} from f_acf"),
        "precursors": precursors(),
        "history_features": (f"{FINGERPRINTS}", f"select h.id, {', '.join(r6(x, x) for x in FINGERPRINT)}, {r6(_NU, 'nu_hat')}, {r6('rho1_e', 'rho1_e')}, {r6('rho1_abs_e', 'rho1_abs_e')}, {r6('ar_r2', 'ar_r2')}, {r6('sigma_e / sigma0', 'sigma_ratio')}, case when h.id % 2 = 1 then 1 else 0 end as has_break from {_JOINED}"),
        "meta_features": (
            FINGERPRINTS,
            f"select i.id, i.t, i.t as meta_t, {r6('ln(1e0 + i.t)', 'meta_ln1p_t')}, h.n_h as meta_h0_n_h, {r6(_NU, 'meta_h0_nu_hat')}, {r6('h.rho1_e', 'meta_h0_rho1_e')}, {r6('h.rho1_abs_e', 'meta_h0_rho1_abs_e')}, {r6('h.ar_r2', 'meta_h0_ar_r2')}, {', '.join(r6(x, f'meta_h0_{x}') for x in FINGERPRINT)} from online i join {_JOINED.replace('h0 h', 'h0 h on i.id = h.id', 1)}",
        ),
    }


__all__ = ["SPECTRAL", "spectral_slope", "statements"]
