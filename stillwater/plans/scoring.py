"""Scores and locators that join window families with the recursive filter (no SQL oracle: the filter has no relational form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.operators import families as f
from stillwater.operators import recursive
from stillwater.sources import stored


def _window_part() -> tuple[str, str]:
    """(select, CTEs) of id, t, top (largest CUSUM), bets (log of the resetting conformal bets), age (of the mean CUSUM)."""
    steps = list(f.cusum_steps())
    age = f"t - coalesce({f.cum('z_cusum_mean_pos_d050', 'max')}, 0)"
    bets = f._logsum([f"l.s_{i}" for i in range(4)])
    more = f"{f.cusum_ctes()}, {f.conformal_ctes()}, aged as (select id, t, greatest({', '.join(steps)}) as top, {age} as age from cus)"
    return f"select a.id, a.t, a.top, cast(a.age as double) as age, {bets} as bets from aged a join low l on a.id = l.id and a.t = l.t", more


def joined(run) -> DataFrame:
    """run(body, ctes) -> frame over a panel's relations; the window part with the filter's odds and age."""
    bayes = recursive.run_block(run(recursive.RESIDUALS, ""), "bayes_filter").select("id", "t", "bayes_lo_h0025", "bayes_age_map_h0100")
    return run(*_window_part()).join(bayes, ["id", "t"])


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(lambda body, more: stored.run(spark, sf_dir, body, more))


def full_score(rows: DataFrame) -> DataFrame:
    """id, t, score of joined rows."""
    raw = 0.9 * F.col("bayes_lo_h0025") + 0.4 * F.sqrt(2 * F.col("top")) + 0.3 * F.col("bets")
    return rows.select("id", "t", F.round(1 / (1 + F.exp(-raw)), 6).alias("score"))


def fallback_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed-form break probability with all its terms: filter odds, largest CUSUM, conformal bets."""
    return full_score(_joined(spark, sf_dir))


def meta_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the filter's and the CUSUM's ages of the change are apart, and the smaller one."""
    a, b = F.col("bayes_age_map_h0100"), F.col("age")
    return _joined(spark, sf_dir).select("id", "t", F.abs(a - b).alias("meta_locator_diff"), F.least(a, b).alias("meta_locator_min"))


QUERIES = {"fallback_full": fallback_full, "meta_locator": meta_locator}
