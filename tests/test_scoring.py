import numpy as np
import pytest

from stillwater.operators import recursive
from stillwater.plans import catalog, scoring
from stillwater.sources import scenarios

SF = "/root/testdata/sf0.001"


def test_full_score_adds_the_filter_term(spark):
    full = scoring.fallback_full(spark, SF).toPandas()
    part = catalog.QUERIES["fallback_score"](spark, SF).toPandas()
    odds = recursive.QUERIES["bayes_filter"](spark, SF).select("id", "t", "bayes_lo_h0025").toPandas()
    m = full.merge(part, on=["id", "t"]).merge(odds, on=["id", "t"])
    assert len(m) == len(full) == len(part)
    m = m[m["score_x"].between(0.02, 0.98) & m["score_y"].between(0.02, 0.98)]
    logit = lambda p: np.log(p / (1 - p))
    assert len(m) and np.allclose(logit(m["score_x"]) - logit(m["score_y"]), 0.9 * m["bayes_lo_h0025"], atol=2e-4)


def test_locator_compares_both_ages(spark):
    got = scoring.meta_locator(spark, SF).toPandas()
    assert len(got) and (got["meta_locator_diff"] >= 0).all() and (got["meta_locator_min"] < got["t"]).all()


@pytest.mark.parametrize("name", sorted(scenarios.SCENARIOS))
def test_scenario_shape_and_determinism(name):
    n, tau, _ = scenarios.SCENARIOS[name]
    a, b = scenarios.generate(name, 3), scenarios.generate(name, 3)
    assert len(a[0]) == scenarios.HISTORY and len(a[1]) == n and a[2] == tau
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert scenarios.generate(f"{name}_ctrl", 3)[2] is None


def test_scenario_effects():
    h, x, tau = scenarios.generate("t4", 1)
    assert x[tau - 1 :].mean() - x[: tau - 1].mean() == pytest.approx(1.5, abs=0.25)
    h, x, tau = scenarios.generate("t5", 1)
    assert x[tau - 1 :].std() / x[: tau - 1].std() == pytest.approx(1.5, abs=0.2)
    h, x, tau = scenarios.generate("t7", 1)
    assert np.corrcoef(x[tau:-1], x[tau + 1 :])[0, 1] > 0.45 and x.std() == pytest.approx(1, abs=0.2)


def test_scenario_panel(spark):
    d = scenarios.scenario_panel(spark, ["t11", "t11_ctrl"], 3).where("period = 2").toPandas()
    assert len(d) == 60 and d.loc[d["scenario"] == "t11_ctrl", "tau"].isna().all()
    assert d[(d["scenario"] == "t11") & (d["seed"] == 2)].sort_values("t")["x"].to_numpy() == pytest.approx(scenarios.generate("t11", 2)[1])
