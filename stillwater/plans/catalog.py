"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stillwater.functions.kernels import PART, cum, r6
from stillwater.operators import bootstrap, calibration, evaluation, history, optional, recursive, reports
from stillwater.operators import families as f
from stillwater.plans import features, gates, model, scoring
from stillwater.sources import panels, sinks, stored


def _pick(parts: list[str], source: str = "inn", ids: str = "id, t") -> str:
    return f"select {ids}, {', '.join(parts)} from {source}"


def _families() -> dict[str, tuple[str, str]]:
    """name -> (further CTEs, final select) of the online feature families."""
    cus, conf = f.cusum_ctes(), f.conformal_ctes()
    steps = list(f.cusum_steps())
    age = [f"cast(t - coalesce({cum('z_' + k, 'max')}, 0) as int) as {k.replace('cusum_', 'cusum_age_')}" for k in f.AGED]
    haar, _ = f.haar()
    joins = " ".join(f"left join g{j} on i.id = g{j}.id and cast(floor(i.t / {2**j}) as int) = g{j}.k" for j in range(1, 6))
    return {
        "accum_mean": ("", _pick(f.accum_mean())),
        "accum_var": ("", _pick(f.accum_var())),
        "accum_exceed": ("", _pick(f.accum_exceed())),
        "accum_sign": ("", _pick(f.accum_sign())),
        "accum_rho1": ("", _pick(f.accum_rho1())),
        "accum_shape": ("", _pick(f.accum_shape())),
        "cusum_bank": (cus, _pick([r6(k, k) for k in steps], "cus")),
        "cusum_age": (cus, _pick(age, "cus")),
        "conformal_logm": (conf, _pick(f.conformal(), "low")),
        "ranktwo_z": (conf, _pick(f.ranktwo(), "pv")),
        "ranktwo_chi2": ("", _pick(f.ranktwo_chi2())),
        "dep_absrho1": (f.dependence_from("abs(e)"), _pick(f.dependence("abs", (50, 100)), "lagd")),
        "dep_sqrho1": (f.dependence_from("e2"), _pick(f.dependence("sq", (50, 100)), "lagd")),
        "dep_mass_abs": (f.dependence_from("abs(e)"), _pick(f.dependence_mass("abs"), "lagd")),
        "dep_mass_evol": (f.dependence_from("e_vol"), _pick(f.dependence_mass("evol"), "lagd")),
        "varloc": ("", _pick(f.varloc())),
        "jumps": ("", _pick(f.jumps())),
        "kpss_bridge_level": (f.bridge_ctes("e", 0), _pick(f.bridge("level"), "bsum")),
        "kpss_bridge_scale": (f.bridge_ctes("e2", 1), _pick(f.bridge("scale"), "bsum")),
        "haar_energy": (haar, f"select i.id, i.t, {', '.join(f'case when floor(i.t / {2**j}) >= 3 then round(ln(greatest(g{j}.g, 1e-12)), 6) end as haar_energy_ln_s{j - 1}' for j in range(1, 6))} from inn i {joins}"),
        "hedge": ("", _pick(f.hedge())),
    }


def _statements(dialect: str) -> dict[str, tuple[str, str]]:
    cus, conf = f.cusum_ctes(), f.conformal_ctes()
    steps = list(f.cusum_steps())
    families = _families() | optional.statements(dialect)
    return {
        "scan_panel": ("", "select id, tt as time, period, round(x, 6) as value from panel"),
        "held_out_panel": ("", f"select id, t - 1 as time, round(x, 6) as value, y as target from online where id in (select id from panel where period = 1 group by id having count(*) >= {panels.LEAST_HISTORY})"),
        "label_break": ("", "select id, t, y from online"),
        "thin_rows": ("", "select id, t, y, case when t <= 100 then 1 when t <= 400 then 2 else 4 end as thin_weight from online where t <= 100 or (t <= 400 and t % 2 = 0) or t % 4 = 0"),
        "whiten": ("", "select id, t, round(e_raw, 6) + 0e0 as e_raw, round(e, 6) + 0e0 as e from inn"),
        "vol_adjust": ("", "select id, t, round(e_vol, 6) + 0e0 as e_vol from inn"),
        "null_calibrate": (
            f"hv as (select id, t, ln(greatest(avg(e * e) over ({PART} rows between 49 preceding and current row), 1e-12)) as s, row_number() over ({PART}) as k from ehist), nul as (select id, avg(s) as mu, stddev_samp(s) as sd, cast(count(*) as double) / 50 as n_eff from hv where k >= 50 group by id), sp as (select id, n_eff / (n_eff + 10) * mu + 10 / (n_eff + 10) * (-0.02e0) as mu, sqrt(n_eff / (n_eff + 10) * sd * sd + 10 / (n_eff + 10) * 0.04e0) as sd from nul), "
            f"raw as (select id, t, ln(greatest(avg(e2) over ({PART} rows between 49 preceding and current row), 1e-12)) as s from inn)",
            "select r.id, r.t, case when r.t >= 10 then round((r.s - p.mu) / p.sd, 6) end as accum_window_var_ln_w050_cal from raw r join sp p on r.id = p.id",
        ),
        "fallback_score": (f"{cus}, {conf}", f"select c.id, c.t, s.y, round(1 / (1 + exp(-(0.4e0 * sqrt(2 * greatest({', '.join('c.' + k for k in steps)})) + 0.3e0 * ({f._logsum([f'l.s_{i}' for i in range(4)])})))), 6) as score from cus c join low l on c.id = l.id and c.t = l.t join scores s on c.id = s.id and c.t = s.t"),
        **families, **history.statements(), **evaluation.QUERIES, **reports.QUERIES, **calibration.statements(dialect),
        "feature_row": features.feature_row(families),
        "training_rows": features.training_rows(families),
    }


def _query(name: str, more: str, body: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stored.run(spark, sf_dir, body, more)

    run.__name__ = name
    return run


_SPARK, _ORACLE = _statements("spark"), _statements("duckdb") | {"fingerprint_spectral": history.SPECTRAL}
QUERIES = (
    {name: _query(name, *parts) for name, parts in _SPARK.items()}
    | {"bootstrap_ci": bootstrap.bootstrap_ci, "adoption_rule": bootstrap.adoption_rule, "fingerprint_spectral": history.spectral_slope, "calibrate_mmd": recursive.calibrate_mmd}
    | features.queries(_families() | optional.statements("spark"))
    | recursive.QUERIES | scoring.QUERIES | model.QUERIES | gates.QUERIES | sinks.QUERIES
)
SQL = {name: panels.statement(body, "duckdb", more) for name, (more, body) in _ORACLE.items()} | {name: panels.statement(body, "duckdb", more) for name, (more, body) in (sinks.ORACLE | model.ORACLE).items()}
