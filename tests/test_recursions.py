"""Window families against step-by-step recursions in numpy, on series that numpy whitens itself."""

import math

import numpy as np
import pytest

from stillwater.operators import families as f
from stillwater.plans import catalog
from stillwater.sources import panels, stored

SF = "/root/testdata/sf0.001"


def fitted(hist, online, order=10):
    """(coefficients, intercept, residuals of the history, raw online residuals), both standardised, by least squares."""
    x = np.column_stack([np.ones(len(hist) - order)] + [hist[order - k : len(hist) - k] for k in range(1, order + 1)])
    y = hist[order:]
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    r2 = 1 - (y - x @ coef).var(ddof=1) / hist.var(ddof=1)
    if r2 < 0.02:
        coef = np.concatenate(([hist.mean()], np.zeros(order)))
    resid = y - x @ coef
    both = np.concatenate((hist, online))
    raw = np.array([both[i] - coef[0] - sum(coef[k] * both[i - k] for k in range(1, order + 1)) for i in range(len(hist), len(both))])
    sd = resid.std(ddof=1)
    return coef[1:], coef[0], resid / sd, raw / sd, r2


@pytest.fixture(scope="module")
def series(spark):
    rows = stored.run(spark, SF, "select id, tt, period, x from panel where id <= 3").toPandas().sort_values(["id", "tt"])
    out = {}
    for i, g in rows.groupby("id"):
        hist, online = g.x[g.period == 1].to_numpy(), g.x[g.period == 2].to_numpy()
        phi, c, eh, raw, r2 = fitted(hist, online)
        e = np.clip(raw, -8, 8)
        a = np.abs(eh) - np.abs(eh).mean()
        vol, v, ev = float(a[1:] @ a[:-1] / (a @ a)) > 0.15, 1.0, []
        for z in e:
            v = 0.94 * v + 0.06 * z * z
            ev.append(z / math.sqrt(max(v, 1e-12)) if vol else z)
        out[i] = {"hist": hist, "x": online, "phi": phi, "c": c, "r2": r2, "eh": eh, "raw": raw, "e": e, "ev": np.array(ev), "su": (eh[1:] * eh[:-1]).std(ddof=1)}
    return out


@pytest.fixture(scope="module")
def got(spark):
    kept = {}

    def take(name):
        if name not in kept:
            kept[name] = catalog.QUERIES[name](spark, SF).where("id <= 3").toPandas()
        return kept[name]

    return take


def same(table, i, column, want, least=1, digits=2e-6):
    g = table[table.id == i].sort_values("t")
    have = g[column].to_numpy(float)
    want = np.asarray(want, float).copy()
    want[: least - 1] = np.nan
    assert np.allclose(have, want[g.t.to_numpy() - 1], atol=digits, equal_nan=True), column


def rolled(x, w, fn):
    return [fn(x[max(0, k - w + 1) : k + 1]) for k in range(len(x))]


def ewma(x, rate, y):
    out = []
    for v in x:
        y = (1 - rate) * y + rate * v
        out.append(y)
    return np.array(out)


def reflected(steps):
    s, out = 0.0, []
    for v in steps:
        s = max(0.0, s + v)
        out.append(s)
    return np.array(out)


def test_fit_is_least_squares(series, got):
    ar, white = got("h0_ar10").set_index("id"), got("whiten")
    for i, s in series.items():
        assert np.allclose([ar.loc[i, f"phi{k}"] for k in range(1, 11)], s["phi"], atol=2e-6) and ar.loc[i, "c"] == pytest.approx(s["c"], abs=2e-6)
        assert ar.loc[i, "ar_r2"] == pytest.approx(s["r2"], abs=2e-6)
        same(white, i, "e_raw", s["raw"])
        same(got("vol_adjust"), i, "e_vol", s["ev"])


def test_moments_and_windows(series, got):
    for i, s in series.items():
        e, ev, n = s["e"], s["ev"], np.arange(1, len(s["e"]) + 1)
        mean, var, shape = got("accum_mean"), got("accum_var"), got("accum_shape")
        same(mean, i, "accum_welford_mean_z", np.sqrt(n) * np.cumsum(ev) / n, 5)
        same(mean, i, "accum_ewma_mean_z_l300", ewma(ev, 0.3, 0.0) / math.sqrt(0.3 / 1.7), 5)
        same(mean, i, "accum_window_mean_z_w025", [np.mean(w) * math.sqrt(len(w)) for w in rolled(ev, 25, list)], 5)
        same(var, i, "accum_ewma_var_ln_l050", np.log(ewma(e * e, 0.05, 1.0)), 5)
        same(var, i, "accum_window_var_ln_w010", np.log(rolled(e * e, 10, np.mean)), 5)
        same(got("accum_sign"), i, "accum_window_sign_z_w050", [(np.mean(w > 0) - 0.5) / math.sqrt(0.25 / len(w)) for w in rolled(ev, 50, np.array)], 5)
        q25, q75 = np.quantile(s["eh"], [0.25, 0.75])
        same(shape, i, "accum_window_qcross_mid_frac_w100", rolled((ev > q25) & (ev < q75), 100, np.mean), 5)
        same(shape, i, "accum_window_skew_z_w250", [np.mean(w**3) * math.sqrt(len(w) / 6) for w in rolled(ev, 250, np.array)], 5)
        whole, total, m2, m = [], 0.0, 0.0, 0.0
        for t, v in enumerate(ev, 1):
            total += v * ev[t - 2] if t > 1 else 0.0
            d = v - m
            m += d / t
            m2 += d * (v - m)
            whole.append(math.atanh(np.clip(total / m2, -0.999, 0.999)) * math.sqrt(max(t - 3, 1)) if m2 > 1e-9 else np.nan)
        same(got("accum_rho1"), i, "accum_global_rho1_fz", whole, 5)
        hit = np.abs(e) > 2
        same(got("accum_exceed"), i, "accum_window_exceed2_frac_w050", rolled(hit, 50, np.mean), 5)


def test_cusums(series, got):
    for i, s in series.items():
        e, ev, raw = s["e"], s["ev"], np.abs(s["raw"])
        bank = got("cusum_bank")
        same(bank, i, "cusum_mean_neg_d050", reflected(-0.5 * ev - 0.125))
        same(bank, i, "cusum_var_up_r250", reflected(0.5 * ((1 - 1 / 2.5) * e * e - math.log(2.5))))
        q = np.quantile(np.abs(s["eh"]), 0.95)
        same(bank, i, "cusum_exceed_q95", reflected(np.where(raw > q, math.log(0.15 / 0.05), math.log(0.85 / 0.95))))
        same(bank, i, "cusum_sign_pos", reflected(np.where(ev > 0, math.log(1.3), math.log(0.7))))
        u = np.concatenate(([0.0], 0.3 * ev[1:] * ev[:-1] / s["su"] - 0.045))
        same(bank, i, "cusum_dep_pos", reflected(u))


def test_conformal_bets_and_rank_tests(series, got):
    for i, s in series.items():
        n = len(s["eh"])

        def upper(hist, x):
            lo, hi = np.searchsorted(np.sort(hist), x, "left"), np.searchsorted(np.sort(hist), x, "right")
            return (n - (lo + hi) / 2 + 0.5) / (n + 1)

        raw = s["raw"]
        p_abs, p_right = upper(np.abs(s["eh"]), np.abs(raw)), upper(s["eh"], raw)
        eps = np.array([0.05, 0.1, 0.2, 0.4])
        gain = np.log(eps) + (eps - 1) * np.log(p_abs[:, None])
        mix = lambda m: np.log(np.exp(m).mean(1))
        same(got("conformal_logm"), i, "conformal_logm_abs", mix(np.cumsum(gain, 0)))
        same(got("conformal_logm"), i, "conformal_logm_abs_reset", mix(np.column_stack([reflected(gain[:, k]) for k in range(4)])))
        same(got("ranktwo_z"), i, "ranktwo_wilcoxon_z_w025", [(np.mean(w) - 0.5) * math.sqrt(12 * len(w)) for w in rolled(p_right, 25, list)], 5)
        cut = np.quantile(s["eh"], [0.25, 0.5, 0.75])
        chi = [sum((np.sum(np.searchsorted(cut, w) == b) - len(w) / 4) ** 2 / (len(w) / 4) for b in range(4)) for w in rolled(s["e"], 25, np.array)]
        same(got("ranktwo_chi2"), i, "ranktwo_shape_chi2_w025", chi, 5, 1e-5)


def test_scales_dependence_jumps_and_bridge(series, got):
    for i, s in series.items():
        e, ev = s["e"], s["ev"]
        level, energy, g, k = ev, np.full(len(ev), np.nan), 1.0, 0
        for t in range(2, len(ev) + 1, 2):
            g, k = 0.95 * g + 0.05 * ((level[t - 2] - level[t - 1]) / math.sqrt(2)) ** 2, k + 1
            energy[t - 1 : t + 1] = math.log(max(g, 1e-12)) if k >= 3 else np.nan
        same(got("haar_energy"), i, "haar_energy_ln_s0", energy)
        a = np.abs(e)

        def rho(k, w):
            now, before = a[max(0, k - w + 1) : k + 1], a[max(0, k - w) : k]
            before = before if k - w >= 0 else np.concatenate(([np.nan], before))
            m, q = now.mean(), (now**2).mean()
            return 0.0 if q - m * m <= 1e-12 else (np.nanmean(now * before) - m * m) / (q - m * m)

        same(got("dep_absrho1"), i, "dep_absrho1_w050", [rho(k, 50) if k else np.nan for k in range(len(a))], 5)
        e1 = np.concatenate(([0.0], e[:-1]))
        rv, bv = np.array(rolled(e * e, 50, np.mean)), np.pi / 2 * np.array(rolled(a * np.abs(e1), 50, np.mean))
        same(got("jumps"), i, "jump_ratio_w050", np.maximum(rv - bv, 0) / (rv + 1e-12), 5)
        z = {w: [(math.log(max(np.mean(v), 1e-12)) + 1 / len(v)) / math.sqrt(2 / len(v)) for v in rolled(e * e, w, list)] for w in f.WINDOWS}
        same(got("varloc"), i, "varloc_max_z", np.max(list(z.values()), 0), 5)

        def bridge(w):
            p, n = np.cumsum(w), len(w)
            return ((p - np.arange(1, n + 1) / n * p[-1]) ** 2).sum() / (n * n * np.var(w)) if np.var(w) > 1e-12 else np.nan

        same(got("kpss_bridge_scale"), i, "mrep_scale_w050", rolled(e * e, 50, bridge), 20)


def test_order_patterns_l_moments_and_spectrum(series, got):
    for i, s in series.items():
        e, raw = s["e"], s["raw"]
        pats = [None, None] + [tuple(np.argsort(np.argsort(e[k - 2 : k + 1], kind="stable"), kind="stable")) for k in range(2, len(e))]
        pe, irrev = [], []
        for k in range(len(e)):
            own = pats[max(2, k - 49) : k + 1]
            c = np.unique([str(p) for p in own], return_counts=True)[1] if own else np.ones(1)
            pe.append(-(c / c.sum() * np.log(c / c.sum())).sum() / math.log(6) if len(own) >= 20 else np.nan)
            own = pats[max(2, k - 99) : k + 1]
            kinds = {p for p in own} | {p[::-1] for p in own}
            irrev.append(0.5 * sum(abs(own.count(p) - own.count(p[::-1])) for p in kinds) / len(own) if len(own) >= 20 else np.nan)
        same(got("ordinal"), i, "ord_pe_m3_w050", pe)
        same(got("ordinal"), i, "ord_irrev_m3_w100", irrev)
        skew = []
        for w in rolled(raw, 50, np.sort):
            n, k = len(w), np.arange(len(w))
            if n < 5:
                skew.append(np.nan)
                continue
            b0, b1, b2 = w.mean(), (k * w).sum() / n / (n - 1), (k * (k - 1) * w).sum() / n / (n - 1) / (n - 2)
            skew.append((6 * b2 - 6 * b1 + b0) / (2 * b1 - b0))
        same(got("lmoments"), i, "lmom_lskew_w050", skew, 5)
        turn, x, slow, centre = np.exp(1j * np.pi * (np.arange(6) + 0.5) / 6), np.zeros(6, complex), np.zeros(6), []
        for v in e:
            x = 0.88 * x * turn + v
            slow = 0.97 * slow + 0.03 * np.abs(x) ** 2
            centre.append((slow / slow.sum() * (np.arange(6) + 0.5) / 6).sum())
        same(got("spectral"), i, "spec_centroid_slow", centre, math.ceil(1 / 0.12 + 1 / 0.03))
        up = reflected(0.5 * ((1 - 1 / 1.5) * e * e - math.log(1.5)))
        same(got("trajectory"), i, "traj_cvar_slope", ewma(np.concatenate(([0.0], np.diff(up))), 0.1, 0.0), 5)
        same(got("trajectory"), i, "traj_cvar_area", reflected(up - 2), 5)
        near = [sum(e[k - j] for j in range(1, 6) if k >= j) for k in range(len(e))]
        u = [v * n / (math.sqrt(min(max(k, 1), 5)) * s["su"]) for k, (v, n) in enumerate(zip(e, near))]
        same(got("mismatch_score"), i, "mismatch_score_cusum_pos", reflected([0.0] + [0.3 * v - 0.045 for v in u[1:]]), 5)


def test_calibrated_variance(series, got):
    for i, s in series.items():
        for w in (10, 50):
            null = np.log(np.maximum(np.convolve(s["eh"] ** 2, np.ones(w) / w, "valid"), 1e-12))
            wt = len(s["eh"]) / w / (len(s["eh"]) / w + 10)
            mu = wt * null.mean() + (1 - wt) * -1 / w
            sd = math.sqrt(wt * null.var(ddof=1) + (1 - wt) * 2 / w)
            want = []
            for k, v in enumerate(rolled(s["e"] ** 2, w, np.mean), 1):
                n = min(k, w)
                want.append((math.log(max(v, 1e-12)) - (-1 / n + mu + 1 / w)) / (sd / math.sqrt(2 / w) * math.sqrt(2 / n)))
            same(got("calibrate_variance"), i, f"accum_window_var_ln_w{w:03d}_cal", want, 10, 1e-5)


def test_a_season_is_found_and_fitted(spark):
    rng = np.random.default_rng(4)
    t = np.arange(700)
    rows = [(1, int(k) + 1, 1 if k < 400 else 2, float(v), None) for k, v in zip(t, 3 * np.sin(2 * np.pi * t / 40) ** 9 + rng.normal(0, 0.3, 700))]
    rows += [(2, int(k) + 1, 1 if k < 400 else 2, float(v), None) for k, v in zip(t, rng.normal(0, 1, 700))]
    rows += [(3, int(k) + 1, 1 if k < 400 else 2, 5.0, None) for k in t]
    panel = stored.Panel(spark.createDataFrame(rows, "id long, tt int, period int, x double, tau_index int"))
    fit = panel.run("select * from fit").toPandas().set_index("id")
    lag = int(fit.loc[1, "season"])
    assert lag % 20 in (0, 1, 19) and np.isnan(fit.loc[2, "season"]) and abs(fit.loc[3, "phi1"]) == 0 and fit.loc[3, "c"] == pytest.approx(5)
    x = np.array([r[3] for r in rows[:400]])
    d = np.column_stack([np.ones(400 - lag)] + [x[lag - k : 400 - k] for k in (*range(1, 11), lag)])
    coef = np.linalg.lstsq(d, x[lag:], rcond=None)[0]
    assert np.allclose(coef, [fit.loc[1, "c"], *(fit.loc[1, f"phi{k}"] for k in range(1, 11)), fit.loc[1, "phi_season"]], atol=1e-6)
    resid = x[lag:] - d @ coef
    e = panel.run("select e from ehist where id = 1 order by t").toPandas().e.to_numpy()
    assert np.allclose(e, resid / resid.std(ddof=1), atol=1e-6)


def test_histories_that_cannot_be_used_are_refused(spark):
    def panel(history, online):
        return spark.range(history + online).selectExpr("1L as id", "cast(id + 1 as int) as tt", f"case when id < {history} then 1 else 2 end as period", "cast(id % 7 as double) as x", "cast(null as int) as tau_index")

    with pytest.raises(ValueError, match="fewer than 50"):
        stored.check(panel(49, 10))
    with pytest.raises(ValueError, match="online steps"):
        stored.check(panel(60, 1901))
    stored.check(panel(50, 1900))


def test_a_changed_input_is_read_anew(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    one = catalog.QUERIES["scan_panel"](spark, str(tmp_path)).count()
    rows.where("l_suppkey <= 5").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert 0 < catalog.QUERIES["scan_panel"](spark, str(tmp_path)).count() < one


def test_statements_hold_only_what_they_need():
    assert panels.needed("select 1 from online") == ["panel0", "panel", "online"]
    assert "design" not in catalog.SQL["label_break"] and "design" in catalog.SQL["whiten"]
