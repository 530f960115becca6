"""Feature families of the online phase, one select list each, over `inn` (one row per online step)."""

from __future__ import annotations

import math

from stillwater.functions.kernels import bernoulli_gain, clip, cum, d, ewma, lag, r6, roll, seen, warm

LAMBDAS = (0.05, 0.1, 0.3)
WINDOWS = (10, 25, 50, 100, 250)
P2 = 0.04550026389635842  # P(|Z| > 2)


def _name(prefix: str, w: int) -> str:
    return f"{prefix}_w{w:03d}"


def accum_mean() -> list[str]:
    out = [r6(warm(f"sqrt(t) * {cum('e_vol', 'avg')}"), "accum_welford_mean_z")]
    out += [r6(warm(f"{ewma('e_vol', k)} / {d(math.sqrt(k / (2 - k)))}"), f"accum_ewma_mean_z_l{round(k * 1000):03d}") for k in LAMBDAS]
    return out + [r6(warm(f"{roll('e_vol', w, 'avg')} * sqrt({seen(w)})"), _name("accum_window_mean_z", w)) for w in WINDOWS]


def accum_var() -> list[str]:
    out = [r6(warm(f"ln(greatest({ewma('e2', k, 1.0)}, 1e-12))"), f"accum_ewma_var_ln_l{round(k * 1000):03d}") for k in LAMBDAS]
    out += [r6(warm(f"ln(greatest({roll('e2', w, 'avg')}, 1e-12))"), _name("accum_window_var_ln", w)) for w in WINDOWS]
    return out + [r6(warm(f"ln(greatest({cum('e', 'var_pop')}, 1e-12))"), "accum_welford_var_ln")]


def accum_exceed() -> list[str]:
    hit = "case when abs(e) > 2 then 1e0 else 0e0 end"
    out = [r6(warm(roll(hit, w, "avg")), _name("accum_window_exceed2_frac", w)) for w in (50, 250)]
    out.append(r6(warm(f"({ewma(hit, 0.1)} - {d(P2)}) / {d(math.sqrt(P2 * (1 - P2) * 0.1 / 1.9))}"), "accum_ewma_exceed2_z"))
    out.append(r6(warm(f"{cum('case when abs(e_raw) > qa99 then 1e0 else 0e0 end')} / t"), "accum_global_exceed99_frac"))
    return out + [r6(cum("abs(e_raw)", "max"), "accum_global_max_abs_eraw")]


def accum_sign() -> list[str]:
    return [r6(warm(f"({roll('case when e_vol > 0 then 1e0 else 0e0 end', w, 'avg')} - 0.5) / sqrt(0.25e0 / {seen(w)})"), _name("accum_window_sign_z", w)) for w in (50, 250)]


def accum_rho1() -> list[str]:
    u, m2 = cum("coalesce(e_vol * v1, 0e0)"), f"({cum('e_vol', 'var_pop')} * t)"
    whole = f"case when {m2} > 1e-9 then atanh({clip(f'{u} / {m2}', -0.999, 0.999)}) * sqrt(greatest(t - 3, 1)) end"
    wu, wv = roll("coalesce(e_vol * v1, 0e0)", 100), roll("e_vol * e_vol", 100)
    part = f"case when least(t - 1, 100) > 3 and {wv} > 0 then atanh({clip(f'{wu} / {wv}', -0.999, 0.999)}) * sqrt(least(t - 1, 100) - 3) end"
    return [r6(warm(whole), "accum_global_rho1_fz"), r6(warm(part), "accum_window_rho1_fz_w100")]


def accum_shape() -> list[str]:
    e2, e4 = roll("e2", 100, "avg"), roll("e2 * e2", 100, "avg")
    return [
        r6(warm(roll("case when e_vol > q25 and e_vol < q75 then 1e0 else 0e0 end", 100, "avg")), "accum_window_qcross_mid_frac_w100"),
        r6(warm(roll("case when e_vol < q10 then 1e0 else 0e0 end", 100, "avg")), "accum_window_qcross_low_frac_w100"),
        r6(warm(f"{roll('e_vol * e_vol * e_vol', 250, 'avg')} * sqrt({seen(250)} / 6e0)"), "accum_window_skew_z_w250"),
        r6(warm(f"sqrt(greatest({e4} - {e2} * {e2}, 0e0)) / ({e2} + 1e-6)"), "accum_window_volvol_cv_w100"),
    ]


def cusum_steps() -> dict[str, str]:
    """Increments of the fifteen reflected sums, S_t = max(0, S_{t-1} + inc_t)."""
    out = {}
    for k in (0.25, 0.5, 1.0):
        for sign, side in (("", "pos"), ("-", "neg")):
            out[f"cusum_mean_{side}_d{round(k * 100):03d}"] = f"({sign}{d(k)} * e_vol - {d(k * k / 2)})"
    for r, side in ((1.5, "up"), (2.5, "up"), (0.5, "down")):
        out[f"cusum_var_{side}_r{round(r * 100):03d}"] = f"0.5e0 * ({d(1 - 1 / r)} * e2 - {d(math.log(r))})"
    for q, p0, p1 in (("95", 0.05, 0.15), ("99", 0.01, 0.05)):
        hit, miss = bernoulli_gain(p0, p1)
        out[f"cusum_exceed_q{q}"] = f"case when abs(e_raw) > qa{q} then {hit} else {miss} end"
    for side, p1 in (("pos", 0.65), ("neg", 0.35)):
        hit, miss = bernoulli_gain(0.5, p1)
        out[f"cusum_sign_{side}"] = f"case when e_vol > 0 then {hit} else {miss} end"
    for sign, side in (("", "pos"), ("-", "neg")):
        out[f"cusum_dep_{side}"] = f"coalesce({sign}0.3e0 * e_vol * v1 / sigma_u - 0.045e0, 0e0)"
    return out


AGED = ("cusum_mean_pos_d050", "cusum_mean_neg_d050", "cusum_var_up_r150", "cusum_sign_pos", "cusum_sign_neg", "cusum_exceed_q95")


def cusum_ctes() -> str:
    """csum, low, cus: running sums, their running minima, and reflected sums (a running sum less its lowest value so far, or 0)."""
    steps = cusum_steps()
    a = ", ".join(f"{cum(v)} as {k}" for k, v in steps.items())
    b = ", ".join(f"{k} - least(0e0, {cum(k, 'min')}) as {k}, case when {k} <= least(0e0, {cum(k, 'min')}) then t end as z_{k}" for k in steps)
    return f"csum as (select id, t, {a} from inn), cus as (select id, t, {b} from csum)"


def conformal_ctes() -> str:
    """Mid-rank p-values against the history (ties by half), then bets on them."""

    def ranks(value: str, name: str) -> str:
        span = "partition by id order by v range between unbounded preceding and current row"
        return (
            f"u_{name} as (select id, 0 as t, {value.replace('E', 'e')} as v, 1e0 as w from ehist union all select id, t, {value.replace('E', 'e_raw')} as v, 0e0 as w from inn), "
            f"r_{name} as (select id, t, v, w, sum(w) over ({span}) as upto, sum(w) over (partition by id, v) as tie, sum(w) over (partition by id) as n from u_{name}), "
            f"p_{name} as (select id, t, upto - tie / 2 as below, n from r_{name} where w = 0)"
        )

    bets = (0.05, 0.1, 0.2, 0.4)
    logs = []
    for kind in ("p_abs", "p_right", "p_left"):
        logs += [f"{cum(f'{d(math.log(k))} + {d(k - 1)} * ln({kind})')} as {kind}_{i}" for i, k in enumerate(bets)]
    return (
        f"{ranks('abs(E)', 'abs')}, {ranks('E', 'raw')}, pv as (select a.id, a.t, (a.n - a.below + 0.5) / (a.n + 1) as p_abs, (r.n - r.below + 0.5) / (r.n + 1) as p_right, (r.below + 0.5) / (r.n + 1) as p_left "
        f"from p_abs a join p_raw r on a.id = r.id and a.t = r.t), bet as (select id, t, {', '.join(logs)} from pv), "
        f"low as (select *, {', '.join(f'p_abs_{i} - least(0e0, {cum(f"p_abs_{i}", "min")}) as s_{i}' for i in range(4))} from bet)"
    )


def _logsum(names: list[str]) -> str:
    top = f"greatest({', '.join(names)})"
    return f"{top} + ln({' + '.join(f'exp({n} - {top})' for n in names)}) - {d(math.log(len(names)))}"


def conformal() -> list[str]:
    out = [r6(_logsum([f"{k}_{i}" for i in range(4)]), f"conformal_logm_{v}") for k, v in (("p_abs", "abs"), ("p_right", "right"), ("p_left", "sign"))]
    return out + [r6(_logsum([f"s_{i}" for i in range(4)]), "conformal_logm_abs_reset")]


def ranktwo() -> list[str]:
    out = [r6(warm(f"({roll('p_right', w, 'avg')} - 0.5) * sqrt(12e0 * {seen(w)})"), _name("ranktwo_wilcoxon_z", w)) for w in (25, 100)]
    return out + [r6(warm(f"({roll('p_abs', w, 'avg')} - 0.5) * sqrt(12e0 * {seen(w)})"), _name("ranktwo_dispersion_z", w)) for w in (25, 100)]


def ranktwo_chi2() -> list[str]:
    bins = ("e <= q25", "e > q25 and e <= q50", "e > q50 and e <= q75", "e > q75")
    out = []
    for w in (25, 100):
        n = f"({seen(w)} / 4e0)"
        out.append(r6(warm(" + ".join(f"power({roll(f'case when {b} then 1e0 else 0e0 end', w)} - {n}, 2) / {n}" for b in bins)), _name("ranktwo_shape_chi2", w)))
    return out


def _rho(v: str, k: int, w: int) -> str:
    m, q = roll(v, w, "avg"), roll(f"({v}) * ({v})", w, "avg")
    return f"case when {q} - {m} * {m} <= 1e-12 then 0e0 else ({roll(f'({v}) * v_{k}', w, 'avg')} - {m} * {m}) / ({q} - {m} * {m}) end"


def dependence_from(value: str) -> str:
    return f"lagd as (select id, t, {value} as v, {', '.join(f'{lag(value, k)} as v_{k}' for k in range(1, 6))} from inn)"


def dependence(name: str, windows: tuple[int, ...]) -> list[str]:
    return [r6(warm(_rho("v", 1, w)), _name(f"dep_{name}rho1", w)) for w in windows]


def dependence_mass(name: str) -> list[str]:
    return [r6(warm(" + ".join(f"power(coalesce({_rho('v', k, 100)}, 0e0), 2)" for k in range(1, 6)), 10), f"dep_mass_{name}_w100")]


def varloc() -> list[str]:
    z = {w: f"((ln(greatest({roll('e2', w, 'avg')}, 1e-12)) + 1e0 / {seen(w)}) / sqrt(2e0 / {seen(w)}))" for w in WINDOWS}
    top = f"greatest({', '.join(z.values())})"
    recent = f"ln(greatest({roll('e2', 25, 'avg')}, 1e-12)) - ln(greatest(avg(e2) over (partition by id order by t rows between 124 preceding and 25 preceding), 1e-12))"
    best = " ".join(f"when {v} >= {top} then {d(math.log(w))}" for w, v in z.items())
    return [r6(warm(top), "varloc_max_z"), r6(warm(f"least({', '.join(z.values())})"), "varloc_min_z"), r6(warm(f"case {best} end"), "varloc_argmax_lnscale"), r6(f"case when t >= 125 then {recent} end", "varloc_recent_vs_lagged")]


def jumps() -> list[str]:
    out = []
    for w in (50, 100):
        rv, bv = roll("e2", w, "avg"), f"({d(math.pi / 2)} * {roll('abs(e) * abs(coalesce(e1, 0e0))', w, 'avg')})"
        up, down = roll("case when e > 0 then e2 else 0e0 end", w), roll("case when e < 0 then e2 else 0e0 end", w)
        out += [
            r6(warm(f"greatest({rv} - {bv}, 0e0) / ({rv} + 1e-12)"), _name("jump_ratio", w)),
            r6(warm(f"ln(({rv} + 1e-12) / ({bv} + 1e-12))"), _name("jump_rvbv_ln", w)),
            r6(warm(f"({up} - {down}) / ({up} + {down} + 1e-12)"), _name("jump_semivar_asym", w)),
            r6(warm(roll("sign(coalesce(e1, 0e0)) * abs(e)", w, "avg")), _name("jump_leverage", w)),
        ]
    return out


def bridge_ctes(value: str, centre: float = 0.0) -> str:
    """Values and their running sum.  The bridge does not see a constant, so values are taken from about their mean and the sum stays small."""
    return f"bsum as (select id, t, v, {cum('v')} as s from (select id, t, {value} - {d(centre)} as v from inn) q)"


def bridge(name: str) -> list[str]:
    """Cramer-von Mises functional of the bridge of partial sums inside each window, from rolling sums of the running sum."""
    out = []
    for w in (50, 100):
        n = f"cast({seen(w)} as double)"
        s0, a, b = f"(s - {roll('v', w)})", roll("s", w), roll("s * s", w)
        k1 = f"({roll('t * s', w)} - (t - {n}) * {a})"
        p = roll("v", w)
        total = f"({b} - 2 * {s0} * {a} + {n} * {s0} * {s0} - 2 * {p} / {n} * ({k1} - {s0} * {n} * ({n} + 1) / 2) + {p} * {p} * ({n} + 1) * (2 * {n} + 1) / (6 * {n}))"
        var = roll("v", w, "var_pop")
        out.append(r6(f"case when t >= 20 and {var} > 1e-12 then {total} / ({n} * {n} * {var}) end", _name(f"mrep_{name}", w)))
    return out


def hedge() -> list[str]:
    return [r6(f"{ewma('(x - mu0)', 0.1)} / sigma0", "hedge_ewma_z"), r6(f"case when t > 1 and {roll('x', 100, 'var_pop')} > 0 then ln({roll('x', 100, 'var_pop')}) end", "hedge_window_var_ln")]


def haar(levels: int = 5) -> tuple[str, list[str]]:
    """(ctes, selects): energies of dyadic Haar coefficients; a coefficient completes every 2^j steps."""
    ctes, out = [], []
    for j in range(1, levels + 1):
        n, h = 2**j, 2 ** (j - 1)
        ctes.append(f"c{j} as (select id, cast(floor((t - 1) / {n}) as int) + 1 as k, sum(case when (t - 1) % {n} < {h} then e_vol else -e_vol end) / {d(math.sqrt(n))} as w, count(*) as m from inn group by id, cast(floor((t - 1) / {n}) as int) + 1 having count(*) = {n})")
        ctes.append(f"g{j} as (select id, k, power(0.95e0, k) * (1e0 + sum(0.05e0 * w * w * power(0.95e0, -k)) over (partition by id order by k rows between unbounded preceding and current row)) as g from c{j})")
        out.append(f"g{j}.g as g{j}")
    return ", ".join(ctes), out
