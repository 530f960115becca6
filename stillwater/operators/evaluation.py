"""Evaluation operators over scored panels: AUC by step, weights, curves, joins of score tables, centring."""

from __future__ import annotations

from stillwater.functions.kernels import clip, cum, d


def _bin(score: str) -> str:
    """A coarse place of a score, in the order of scores: splits a step's rows between tasks."""
    return f"cast(floor(32e0 * {score} / (1e0 + abs({score}))) as int)"


def counted(score: str, name: str, source: str = "scores", keys: str = "t", more: str = "") -> str:
    """{name}_n: positive and negative rows (p, q) per step and distinct score, with how many of both lie below (p_low, q_low).

    Rows are counted per distinct score before anything is ordered.  Order then
    goes by ranges of scores: the sums of whole ranges first, the sums inside a
    range after them, so a step with very many rows is not one task's.
    """
    both = lambda x: f"coalesce(sum({x}) over (partition by {keys}, bin order by s rows between unbounded preceding and 1 preceding), 0e0)"
    up = lambda x: f"coalesce(sum({x}) over (partition by {keys} order by bin rows between unbounded preceding and 1 preceding), 0e0)"
    same = " and ".join(f"n.{k.strip()} = o.{k.strip()}" for k in [*keys.split(","), "bin"])
    return (
        f"{name}_k as (select {keys}{more}, {score} as s, {_bin(score)} as bin, cast(sum(y) as double) as p, cast(count(*) - sum(y) as double) as q from {source} group by {keys}{more}, {score}), "
        f"{name}_b as (select {keys}, bin, sum(p) as p, sum(q) as q from {name}_k group by {keys}, bin), "
        f"{name}_o as (select {keys}, bin, {up('p')} as p_up, {up('q')} as q_up from {name}_b), "
        f"{name}_i as (select *, {both('p')} as p_in, {both('q')} as q_in from {name}_k), "
        f"{name}_n as (select n.*, p_up + p_in as p_low, q_up + q_in as q_low from {name}_i n join {name}_o o on {same})"
    )


def by_step(score: str, name: str = "steps", source: str = "scores", keys: str = "t", more: str = ", bucket") -> str:
    """Average-rank AUC of each step; steps with one class only are left out."""
    return (
        f"{counted(score, name, source, keys, more)}, "
        f"{name} as (select {keys}{more}, cast(sum(p) as bigint) as n_pos, cast(sum(q) as bigint) as n_neg, sum(p) * sum(q) as w, sum(p * (q_low + q / 2e0)) / (sum(p) * sum(q)) as auc from {name}_n group by {keys}{more} having sum(p) > 0 and sum(q) > 0)"
    )


def percentile_rank(score: str, name: str, source: str = "scores") -> str:
    """{name}(t, s, rank): average rank of a score inside its step, as a share of the step's rows."""
    return (
        f"{counted(score, name, source)}, {name}_t as (select t, sum(p + q) as n from {name}_k group by t), "
        f"{name} as (select a.t, s, (p_low + q_low + (p + q + 1) / 2e0) / n as rank from {name}_n a join {name}_t b on a.t = b.t)"
    )


#: Two score tables that differ in rows and labels, as two runs' out-of-fold files do.
TWO_RUNS = "run_a as (select id, t, y, score_a as s from scores where (id + t) % 11 <> 3), run_b as (select id, t, case when id % 17 = 4 and t % 10 = 0 then 1 - y else y end as y, score_b as s from scores where (id + 3 * t) % 13 <> 5)"
#: Four score tables that stand for runs with unlike seeds: two of each of two groups.
SEEDS = "seeds as (select 'base' as grp, 1 as seed, id, t, y, bucket, score_a as s from scores union all select 'base', 2, id, t, y, bucket, round((score_a + score_b) / 2, 9) from scores union all select 'next', 1, id, t, y, bucket, score_b from scores union all select 'next', 2, id, t, y, bucket, round(sqrt(score_a * score_b), 9) from scores)"

#: The base rate by step in bins of 20, and its line between bin centres, constant outside them.
CURVE = (
    "curve0 as (select cast(floor(t / 20) as int) as k, (sum(y) + 5e0) / (count(*) + 10e0) as rate from scores group by cast(floor(t / 20) as int)), "
    "curve as (select k * 20 + 10e0 as c, rate, lead(k * 20 + 10e0) over (order by k) as c2, lead(rate) over (order by k) as r2, row_number() over (order by k) as place from curve0), "
    "moments_t as (select distinct t from scores), "
    "line as (select t, case when t < c or c2 is null then rate else rate + (r2 - rate) * (t - c) / (c2 - c) end as rate from moments_t join curve on (t >= c or place = 1) and (c2 is null or t < c2)), "
    f"base as (select t, ln({clip('rate', 1e-6, 1 - 1e-6)} / (1 - {clip('rate', 1e-6, 1 - 1e-6)})) as offset_t from line)"
)

#: Score centring: the detector of score_a runs over the last steps of the history as if they were online; mean and spread come from what lies before them.
TAIL = 100
CENTRING = (
    f"tail_n as (select id, count(*) as n from panel where period = 1 group by id having count(*) >= {TAIL + 64}), "
    f"tail_fit as (select p.id, n, avg(x) as mu, greatest(stddev_samp(x), 1e-8) as sd from panel p join tail_n m on p.id = m.id where period = 1 and tt <= n - {TAIL} group by p.id, n), "
    f"tail_x as (select p.id, cast(tt - (n - {TAIL}) as int) as t, (x - mu) / sd as z from panel p join tail_fit f on p.id = f.id where period = 1 and tt > n - {TAIL}), "
    f"tail_z as (select id, t, abs(power(0.95e0, t) * {cum('0.05e0 * z * power(0.95e0, -t)')}) / sqrt(0.05e0 / 1.95e0 * (1 - power(0.9025e0, t))) as za from tail_x), "
    f"baseline as (select id, t, ln(p / (1 - p)) as b from (select id, t, {clip('round(tanh(za / 3e0), 9)', 1e-9, 1 - 1e-9)} as p from tail_z) q), "
    f"last_b as (select id, b as b_end from baseline where t = {TAIL}), "
    f"raw as (select s.id, s.t, y, bucket, score_a, ln(p / (1 - p)) - offset_t as raw from (select *, {clip('score_a', 1e-9, 1 - 1e-9)} as p from scores) s join base o on s.t = o.t), "
    "withb as (select r.*, coalesce(b, b_end) as b from raw r left join baseline l on r.id = l.id and r.t = l.t left join last_b e on r.id = e.id), "
    "centre as (select avg(b) as m from withb where b is not null), "
    "centred as (select id, t, y, bucket, score_a, raw, b, " + ", ".join(f"round(raw - {k}e0 * (b - m), 7) as b{round(k * 100):03d}" for k in (1.0, 0.25, 0.5, 0.75)) + ", " + ", ".join(f"round(case when t <= {t0} then raw - (b - m) else raw end, 7) as to{t0}" for t0 in (50, 100, 200)) + " from withb cross join centre where b is not null)"
).replace("1.0e0", "1e0")
VARIANTS = ("score_a", "b100", "b025", "b050", "b075", "to50", "to100", "to200")

#: Paired bootstrap: bootstrap.py runs it on Spark and draws the same series; here all of it is SQL, for the oracle.
REPLICATES, PRIME = 500, 2147483647
MIXES = ((48271, 69621, 1), (16807, 1, 31), (39373, 742938285, 630360016), (62089911, 950706376, 1226874159))
IDS = "ids as (select id, cast(row_number() over (order by id) - 1 as bigint) as k, count(*) over () as n from (select distinct id from scores) i)"
DELTAS = (
    "lines as (select 'overall' as bucket union all select 't<=50' union all select '50<t<=150' union all select '150<t<=400' union all select 't>400'), "
    "dl as (select rep, coalesce(bucket, 'overall') as bucket, sum(ub) / sum(w) - sum(ua) / sum(w) as delta from us group by grouping sets ((rep, bucket), (rep)) having sum(w) > 0), "
    "ci as (select l.bucket, max(case when rep = 0 then delta end) as point, {pct}(case when rep > 0 then delta end, 0.025) as low, {pct}(case when rep > 0 then delta end, 0.975) as high, avg(case when rep > 0 then delta end) as mean, "
    "stddev_samp(case when rep > 0 then delta end) as sd, count(case when rep > 0 then delta end) as n from lines l left join dl on l.bucket = dl.bucket group by l.bucket)"
)
INTERVALS = "select bucket, round(point, 6) as point_delta, round(low, 6) as low, round(high, 6) as high, round(mean, 6) as mean_delta, round(case when n = 1 then 0e0 else sd end, 6) as sd_delta, n, low > 0 or high < 0 as excludes_zero from ci"
ADOPTION = "select bucket, coalesce((low > 0 or high < 0) and point > 0, false) as adopt from ci"


def bootstrap_ctes() -> str:
    digits = "digit as (" + " union all ".join(f"select cast({i} as bigint) as v" for i in range(10)) + ")"
    mixed = f"m0 as (select rep, k, n, (rep * 1000003 + k * 7919 + 12345) % {PRIME} as h from rp cross join ids)"
    for i, (a, b, c) in enumerate(MIXES):
        mixed += f", m{i + 1} as (select rep, k, n, (h * h % {PRIME} * {a} + rep * {b} + k * {c}) % {PRIME} as h from m{i})"
    return (
        f"{IDS}, {digits}, rp as (select a.v * 100 + b.v * 10 + c.v + 1 as rep from digit a cross join digit b cross join digit c where a.v * 100 + b.v * 10 + c.v < {REPLICATES}), {mixed}, "
        f"draw as (select rep, h % n as k, count(*) as mult from m{len(MIXES)} group by rep, h % n union all select 0, k, 1 from ids), "
        "bt as (select d.rep, s.t, s.bucket, s.y, s.score_a, s.score_b, d.mult, cast(d.mult * (1 - s.y) as double) as x from scores s join ids i on s.id = i.id join draw d on i.k = d.k), "
        "won as (select rep, t, bucket, y, mult, sum(x) over (partition by rep, t order by score_a) - sum(x) over (partition by rep, t, score_a) / 2e0 as ra, sum(x) over (partition by rep, t order by score_b) - sum(x) over (partition by rep, t, score_b) / 2e0 as rb from bt), "
        "us as (select rep, t, bucket, sum(y * mult * ra) as ua, sum(y * mult * rb) as ub, cast(sum(y * mult) as double) * cast(sum((1 - y) * mult) as double) as w from won group by rep, t, bucket), " + DELTAS
    )


_MEAN = "tm as (select t, avg(score_a) as m, {pct}(score_a, 0.5) as md, sum(case when score_a is null or score_a <> score_a or abs(score_a) > 1e300 then 1 else 0 end) as odd from scores group by t)"
_META = "meta as (select id, max(y) as hb, max(t) as t_max, min(case when y = 1 then t end) as tau from scores group by id)"
_TAU_BUCKET = "case when hb = 1 then least(cast(floor(3e0 * tau / t_max) as int), 2) else -1 end"

QUERIES: dict[str, tuple[str, str]] = {
    "ts_auc": (by_step("score_a"), "select round(sum(w * auc) / sum(w), 6) as ts_auc, count(*) as n_steps from steps"),
    "ts_auc_or_half": (by_step("score_b"), "select coalesce(round(sum(w * auc) / sum(w), 6), 0.5e0) as ts_auc from steps"),
    "ts_auc_bucket": (by_step("score_a"), "select coalesce(bucket, 'all') as bucket, round(sum(w * auc) / sum(w), 6) as ts_auc, cast(sum(w) as bigint) as weight from steps group by grouping sets ((bucket), ())"),
    "auc_by_step": (by_step("score_a"), "select t, round(auc, 6) as auc_t, n_pos, n_neg, cast(w as bigint) as w_t from steps"),
    "auc_by_bin": (by_step("score_a") + ", bins as (select cast(floor(t / 10) as int) * 10 + 5 as t_bin, sum(w * auc) / sum(w) as a, sum(w) as w from steps group by 1)", "select t_bin, round(a, 6) as ts_auc_bin, cast(w as bigint) as weight_bin from (select *, sum(w) over (order by t_bin) / sum(w) over () as share from bins) q where share <= 0.99"),
    "step_counts": ("", "select t, cast(sum(y) as bigint) as n_pos, count(*) as n_alive, cast(count(*) - sum(y) as bigint) as n_neg from scores group by t"),
    "step_response": ("", "select t - 1 - tau_index as shift, round(avg(score_a), 6) as mean_score, round({pct}(score_a, 0.5), 6) as median_score, count(*) as n from scores where tau_index is not null group by t - 1 - tau_index"),
    "xs_spread": ("xsd as (select t, bucket, stddev_samp(score_a) as sd, sum(y) * (count(*) - sum(y)) as w from scores group by t, bucket)", "select bucket, round(sum(w * sd) / sum(w), 6) as spread, count(*) as n_steps from xsd where w > 0 group by bucket"),
    "intra_series_gap": ("dev as (select id, y, score_a - avg(score_a) over (partition by t) as x from scores), gap as (select id, avg(case when y = 1 then x end) - avg(case when y = 0 then x end) as g from dev group by id)", "select round({pct}(g, 0.5), 6) as median_gap, count(g) as n_series from gap"),
    "rank_average": (
        f"{TWO_RUNS}, {percentile_rank('s', 'ra', 'run_a')}, {percentile_rank('s', 'rb', 'run_b')}",
        "select a.id, a.t, a.y, round((x.rank + z.rank) / 2, 9) as score from run_a a join run_b b on a.id = b.id and a.t = b.t join ra x on a.t = x.t and a.s = x.s join rb z on b.t = z.t and b.s = z.s",
    ),
    "row_weights": (
        "cnt as (select t, sum(y) as np, count(*) - sum(y) as nn from scores where t <= 100 or (t <= 400 and t % 2 = 0) or t % 4 = 0 group by t), "
        "raw as (select s.id, s.t, y, case when s.t <= 100 then 1 when s.t <= 400 then 2 else 4 end as thin, (case when y = 1 then least(nn + 5, 50 * (np + 5)) else least(np + 5, 50 * (nn + 5)) end) * (case when s.t <= 100 then 1e0 when s.t <= 400 then 2e0 else 4e0 end) as w from scores s join cnt c on s.t = c.t), mean as (select avg(w) as m from raw)",
        "select id, t, y, thin, round(w / m, 6) as weight from raw cross join mean",
    ),
    "base_rate_curve": ("", "select cast(floor(t / 20) as int) * 20 + 10 as center, round((sum(y) + 5e0) / (count(*) + 10e0), 9) as rate from scores group by cast(floor(t / 20) as int) * 20 + 10"),
    "base_rate_logit": (CURVE, "select id, s.t, y, round(offset_t, 6) as base_logit from scores s join base b on s.t = b.t"),
    "series_meta": (_META, f"select id, hb as has_break, t_max, tau, {_TAU_BUCKET} as tau_bucket from meta"),
    "series_table": (
        f"{_META}, ranked as (select *, row_number() over (partition by hb, {_TAU_BUCKET} order by (id * 48271 + 12345) % 2147483647, id) as place from meta)",
        f"select id, tau, t_max, hb as has_break, t_max - tau + 1 as post_len, case when tau is null then 'none' when tau <= 50 then 't<=50' when tau <= 150 then '50<t<=150' when tau <= 400 then '150<t<=400' else 't>400' end as tau_bucket, place <= 3 as example from ranked",
    ),
    "kfold_assign": (_META, f"select id, hb as has_break, {_TAU_BUCKET} as tau_bucket, cast((row_number() over (partition by hb, {_TAU_BUCKET} order by (id * 2654435761) % 1000003, id) - 1) % 5 as int) as fold from meta"),
    "score_histogram": (
        "hist_n as (select bucket, y, least(cast(floor(score_a * 30) as int), 29) as bin, count(*) as n from scores group by bucket, y, least(cast(floor(score_a * 30) as int), 29)), hist_t as (select bucket, y, sum(n) as total from hist_n group by bucket, y)",
        "select a.bucket, a.y, bin, n, round(n * 30e0 / total, 9) as density from hist_n a join hist_t b on a.bucket = b.bucket and a.y = b.y",
    ),
    "paired_compare": (by_step("score_a", "sa") + ", " + by_step("score_b", "sb"), "select a.bucket, round(sum(b.w * b.auc) / sum(b.w) - sum(a.w * a.auc) / sum(a.w), 6) as delta, count(*) as n_steps from sa a join sb b on a.t = b.t group by a.bucket"),
    "bootstrap_ci": (bootstrap_ctes(), INTERVALS),
    "adoption_rule": (bootstrap_ctes(), ADOPTION),
    "seed_spread": (
        f"{SEEDS}, {by_step('s', 'sa', 'seeds', 'grp, seed, t', '')}, one as (select grp, seed, sum(w * auc) / sum(w) as v from sa group by grp, seed), by_grp as (select grp, avg(v) as m, stddev_samp(v) as sd, count(*) as n from one group by grp)",
        "select a.grp, round(a.m, 6) as mean_auc, round(a.sd, 6) as sd_auc, a.n, round(b.m - c.m, 6) as difference, round(sqrt(b.sd * b.sd / b.n + c.sd * c.sd / c.n), 6) as se_difference from by_grp a cross join (select * from by_grp where grp = 'next') b cross join (select * from by_grp where grp = 'base') c",
    ),
    "seed_mean": (f"{SEEDS}", "select grp, id, t, max(y) as y, round(avg(s), 9) as score from seeds group by grp, id, t having count(*) = 2 and min(y) = max(y)"),
    "seed_alignment": (
        f"{SEEDS}, one as (select id, t from seeds where grp = 'base' and seed = 1 and (id + t) % 19 <> 2), two as (select id, t from seeds where grp = 'base' and seed = 2 and (id + t) % 23 <> 4)",
        "select count(*) as n_rows, sum(case when b.id is null then 1 else 0 end) as only_first, sum(case when a.id is null then 1 else 0 end) as only_second, sum(case when a.id is null or b.id is null then 1 else 0 end) = 0 as aligned from one a full outer join two b on a.id = b.id and a.t = b.t",
    ),
    "xs_redundancy": ("xc as (select t, corr(score_a, score_b) as c, count(*) as n, stddev_pop(score_a) as sa, stddev_pop(score_b) as sb from scores group by t)", "select round(max(abs(c)), 6) as max_corr, case when max(abs(c)) < 0.90 then 'distinct' when max(abs(c)) < 0.97 then 'close' else 'redundant' end as verdict from xc where n >= 10 and sa >= 1e-12 and sb >= 1e-12"),
    "trajectory_stats": (_MEAN, "select round(min(md), 6) as min_median, round(max(md), 6) as max_median, round(regr_slope(m, cast(t as double)), 9) as slope, round(max(case when t = 100 then m end), 6) as mean_at_100, round(max(case when t = 100 then md end), 6) as median_at_100, sum(odd) = 0 as all_finite, count(*) as n_steps from tm"),
    "postprocess_free": ("", "select id, t, score_a as score from scores"),
    "postprocess_hold": ("", f"select id, t, round({cum('score_a', 'max')}, 9) as score from scores"),
    "postprocess_soft": ("", f"select id, t, round({cum('score_a + 0.02e0 * t', 'max')} - 0.02e0 * t, 9) as score from scores"),
    "baseline_ewma_z": ("", "select id, t, y, score_a as score from scores"),
    "oof_join_check": (
        f"{TWO_RUNS}, pairs as (select count(*) as n, sum(case when a.y <> b.y then 1 else 0 end) as bad from run_a a join run_b b on a.id = b.id and a.t = b.t), na as (select count(*) as n from run_a), nb as (select count(*) as n from run_b)",
        "select p.n as n_rows, cast(bad as bigint) as mismatches, na.n - p.n as dropped_first, nb.n - p.n as dropped_second from pairs p cross join na cross join nb",
    ),
    "prediction_truth_join": ("truth as (select id, t, y as target from scores)", "select s.id, s.t - 1 as time_online, s.score_a as prediction, t.target from scores s left join truth t on s.id = t.id and s.t = t.t"),
    "sample_rows": ("", "select id, t, y, score_a from scores order by (id * 48271 + t * 69621 + 12345) % 2147483647, id, t limit 1000"),
    "systematic_sample": ("", "select id from (select id, row_number() over (order by id) as place, count(*) over () as n from (select distinct id from scores) i) q where (place - 1) % greatest(cast(floor(n / 20e0) as int), 1) = 0 order by id limit 20"),
    "history_length_filter": ("long_enough as (select id, count(*) as n from panel where period = 1 group by id)", f"select id, n as n_h, n >= {TAIL + 64} as enough_for_tail, n >= 50 as enough_for_fit from long_enough where n >= {TAIL + 64}"),
    "centring_baseline": (f"{CURVE}, {CENTRING}", "select id, t, round(b, 6) as baseline_raw from baseline"),
    "score_centring": (f"{CURVE}, {CENTRING}", f"select id, t, y, round(raw, 6) as raw_online, round(b, 6) as baseline_raw, {', '.join(VARIANTS[1:])} from centred"),
    "centring_precheck": (
        f"{CURVE}, {CENTRING}, pre as (select id, avg(raw) as o, count(*) as n_pre from raw where t <= {TAIL} and y = 0 group by id), lev as (select id, avg(b) as h from baseline group by id)",
        "select round(corr(o, h), 6) as level_corr, round(stddev_samp(o), 6) as sd_online, round(stddev_samp(h), 6) as sd_history, round(sqrt(avg((o - h) * (o - h))), 6) as rmse, count(*) as n_series, corr(o, h) >= 0.3 as passes from pre p join lev l on p.id = l.id",
    ),
}
_bands = " union all ".join(f"select '{n}' as band, {hi} as t_hi" for n, hi in (("t<=50", 50), ("t<=150", 150), ("t<=400", 400), ("all", 1000000000)))
_long = " union all ".join(f"select '{v}' as variant, t, y, {v} as s from centred" for v in VARIANTS)
QUERIES["centring_auc"] = (
    f"{CURVE}, {CENTRING}, long_s as ({_long}), {by_step('s', 'sv', 'long_s', 'variant, t', '')}, bands as ({_bands})",
    "select variant, band, round(sum(w * auc) / sum(w), 6) as ts_auc from sv join bands on t <= t_hi group by variant, band",
)

__all__ = ["QUERIES", "by_step", "counted", "d", "percentile_rank"]
