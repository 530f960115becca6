"""Behavioural gates: the full closed-form score over scenario panels, judged by its trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stillwater.plans import scoring
from stillwater.sources import scenarios, stored

#: The gates' thresholds by scenario, and the largest drift of a flat trajectory.
GATES = {
    "t1": {"median_min": 0.65, "control_median_max": 0.25, "t_from": 50}, "t2": {"mean_prebreak_max": 0.35}, "t3": {"gap_min": 0.15, "t_offset": 200}, "t4": {"median_min": 0.75, "control_median_max": 0.20, "t_offset": 15},
    "t5": {"gap_min": 0.35, "t_offset": 100}, "t5b": {"gap_min": 0.20, "t_offset": 200}, "t6": {"mean_max": 0.40}, "t7": {"gap_min": 0.20, "t_offset": 150}, "t8": {"gap_min": 0.15, "t_offset": 200},
    "t9": {"final_max": 0.35, "decay_min": 0.1}, "t10": {"mean_max": 0.40}, "t11": {}, "t12": {}, "t12b": {}, "t13": {"decay_min": 0.15},
}
DRIFT = 1e-4
CONTROLLED = ("t1", "t3", "t4", "t5", "t5b", "t7", "t8")
RELATIVE = ("t2", "t6", "t9", "t10", "t13")


def _rule(name: str, relative: bool) -> str:
    """The gate of one scenario as a condition over its own (a), its control's (c) and its reference's (r) statistics."""
    g, (_, tau, _) = GATES[name], scenarios.SCENARIOS[name]
    less = lambda x: f"a.{x} - r.{x}" if relative else f"a.{x}"
    flat = f"abs(a.slope) <= {DRIFT!r}D"
    if name == "t1":
        return f"a.low >= {g['median_min']} and c.high <= {g['control_median_max']}"
    if name == "t2":
        return f"{less('before')} <= {g['mean_prebreak_max']} and abs(a.slope_before) <= {DRIFT!r}D"
    if name == "t4":
        return f"a.med >= {g['median_min']} and c.med <= {g['control_median_max']}"
    if name in CONTROLLED:
        return f"a.med - c.med >= {g['gap_min']}"
    if name in ("t6", "t10"):
        return f"{less('final')} <= {g['mean_max']} and {flat}"
    if name == "t9":
        return f"{less('final')} <= {g['final_max']} and a.m210 - a.m250 >= {g['decay_min']}"
    if name == "t11":
        return "a.m10 > a.m4"
    if name == "t13":
        return f"(a.d260 - a.d600){' - (r.d260 - r.d600)' if relative else ''} >= {g['decay_min']}"
    return flat


def _at(name: str) -> int:
    tau, offset = scenarios.SCENARIOS[name][1], GATES[name].get("t_offset")
    return (tau or 0) + (offset or 0)


def judged(rows: DataFrame, relative: bool = False) -> DataFrame:
    """rows(scenario, seed, t, score) -> scenario, passes, all_finite and the statistics that decide.

    Scenarios end in `_ctrl` and `_ref` where they are twins.  A trajectory with a
    null or non-finite score fails its gate.  relative: levels are gaps to the
    reference panel, where a gate has one.
    """
    spark = rows.sparkSession
    at = " ".join(f"when name = '{k}' then {_at(k)}" for k in GATES)
    stats = f"""with s as (select *, regexp_replace(scenario, '_(ctrl|ref)$', '') as name from {{rows}}),
      k as (select *, case {at} end as at, case name when 't2' then 594 end as pre from s),
      tm as (select scenario, name, t, max(at) as at, max(pre) as pre, avg(score) as m, percentile(score, 0.5) as d, count_if(score is null or isnan(score)) as odd from k group by scenario, name, t),
      pre as (select scenario, percentile(m, 0.5) as before from (select scenario, seed, avg(score) as m from k where t <= pre group by scenario, seed) q group by scenario),
      st as (select scenario, max(name) as name, min(case when t >= 50 then d end) as low, max(case when t >= 50 then d end) as high, max(case when t = at then d end) as med, max_by(m, t) as last, max(case when t = 999 then m end) as m999, max(case when t = 210 then m end) as m210, max(case when t = 250 then m end) as m250,
        max(case when t = 260 then d end) as d260, max(case when t = 600 then d end) as d600, max(case when t = 10 then m end) as m10, max(case when t = 4 then m end) as m4, regr_slope(m, cast(t as double)) as slope, regr_slope(case when t <= pre then m end, cast(t as double)) as slope_before, sum(odd) as odd from tm group by scenario),
      x as (select st.*, case when name = 't9' then m999 else last end as final, before from st left join pre on st.scenario = pre.scenario)
    select a.scenario, a.odd + coalesce(c.odd, 0) + coalesce(r.odd, 0) = 0 as all_finite, a.odd + coalesce(c.odd, 0) + coalesce(r.odd, 0) = 0 and coalesce(case a.name {' '.join(f"when '{k}' then {_rule(k, relative and k in RELATIVE)}" for k in GATES)} end, false) as passes,
      round(a.low, 6) as low, round(a.med, 6) as med, round(c.med, 6) as control_med, round(a.final, 6) as final, round(a.slope, 9) as slope
    from x a left join x c on c.scenario = concat(a.name, '_ctrl') left join x r on r.scenario = concat(a.name, '_ref') where a.scenario = a.name"""
    return spark.sql(stats, rows=rows)


def scenario_scores(spark: SparkSession, names: list[str], seeds: int) -> DataFrame:
    """scenario, seed, t, score of the full closed-form score."""
    drawn = scenarios.scenario_panel(spark, names, seeds)
    code = " ".join(f"when '{n}' then {i}" for i, n in enumerate(names))
    panel = drawn.selectExpr(f"cast((case scenario {code} end) * {seeds} + seed as bigint) as id", f"case when period = 1 then t else t + {scenarios.HISTORY} end as tt", "period", "x", "cast(null as int) as tau_index")
    panel = stored.Panel(panel)
    score = scoring.full_score(scoring.joined(panel.run))
    back = " ".join(f"when {i} then '{n}'" for i, n in enumerate(names))
    return score.selectExpr(f"case cast(floor(id / {seeds}) as int) {back} end as scenario", f"id % {seeds} as seed", "t", "score")


def gates(spark: SparkSession, sf_dir: str, seeds: int = 3) -> DataFrame:
    """Every scenario's gate, by the absolute rules that fit a score between 0 and 1.  The panel is drawn, not read."""
    names = [*GATES, *(f"{n}_ctrl" for n in CONTROLLED)]
    return judged(scenario_scores(spark, names, seeds))


QUERIES = {"scenario_gates": gates}
