import math

import numpy as np
import pyarrow as pa
import pytest

from stillwater.plans import features, gates, model
from stillwater.sources import scenarios, sinks

SF = "/root/testdata/sf0.001"


def table(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0] - (x[:, 1] > 0.5)))).astype(int)
    rows = [(int(k // 30), int(k % 30) + 1, int(y[k]), 1.0, 0.0, int(k // 30 % 3), float(x[k, 0]), float(x[k, 1]) if k % 50 else None, float(x[k, 2])) for k in range(n)]
    return spark.createDataFrame(rows, "id long, t int, y int, weight double, base double, fold int, a double, b double, c double")


def logloss(d):
    p = d.pred.clip(1e-9, 1 - 1e-9)
    return -(d.y * np.log(p) + (1 - d.y) * np.log(1 - p)).mean()


def test_boosted_trees_learn_and_stay_within_their_folds(spark, tmp_path):
    rows = table(spark)
    boosters = model.train(rows, ["a", "b", "c"], folds=3, rounds=10, depth=2)
    oof = model.scored(rows, boosters).toPandas()
    assert len(oof) == 3000 and logloss(oof) < 0.57 < math.log(2)
    gain = {k: sum(b.importance()[k][0] for b in boosters) for k in "abc"}
    assert gain["a"] > gain["b"] > gain["c"]
    model.save(spark, boosters, f"{tmp_path}/m")
    again = model.load(spark, f"{tmp_path}/m")
    code = boosters[0].binned(np.array([[0.1, np.nan, 2.0], [-1.0, 0.3, 0.0]]))
    for a, b in zip(boosters, again):
        assert np.allclose(a.margin(code), b.margin(code), atol=1e-12)
    assert np.allclose(model.fuse(boosters).margin(code), np.mean([b.margin(code) for b in boosters], 0), atol=1e-9)
    mean, fused, both = (model.scored(rows, boosters, m).toPandas().sort_values(["id", "t"]).pred.to_numpy() for m in ("mean", "fused", "combined"))
    assert np.allclose((mean + fused) / 2, both) and np.abs(mean - fused).max() < 0.02


def test_training_is_the_same_however_rows_are_dealt(spark):
    rows = table(spark, 1200)
    one, two = (model.train(r, ["a", "b", "c"], folds=3, rounds=3, depth=2) for r in (rows.coalesce(1), rows.repartition(5)))
    assert [t.feature for b in one for t in b.trees] == [t.feature for b in two for t in b.trees]
    seeded = [model.train(rows, ["a", "b", "c"], folds=3, rounds=2, depth=2, seed=s) for s in (7, 7, 8)]
    assert seeded[0][0].saved() == seeded[1][0].saved() != seeded[2][0].saved()


def test_ranking_orders_the_rows_of_each_step(spark):
    """A step's own level, which a probability model follows, says nothing here; only order inside a step does."""
    rng = np.random.default_rng(3)
    n = 4000
    t, a, noise = rng.integers(1, 41, n), rng.standard_normal(n), rng.standard_normal(n)
    y = (a + noise + (t - 20) * 0.2 > 0).astype(int)
    rows = spark.createDataFrame([(int(k), int(t[k]), int(y[k]), 1.0, 0.0, int(k % 3), float(a[k]), float(t[k]), float(noise[k] * 0 + rng.random())) for k in range(n)], "id long, t int, y int, weight double, base double, fold int, a double, b double, c double")
    boosters = model.train(rows, ["a", "b", "c"], folds=3, rounds=6, depth=2, objective="rank")
    oof = model.scored(rows, boosters, "rank").toPandas()
    won = pairs = 0.0
    for _, g in oof.groupby("t"):
        p, q = g.pred[g.y == 1].to_numpy(), g.pred[g.y == 0].to_numpy()
        won, pairs = won + (p[:, None] > q).sum() + (p[:, None] == q).sum() / 2, pairs + len(p) * len(q)
    gain = {k: sum(b.importance()[k][0] for b in boosters) for k in "abc"}
    assert won / pairs > 0.75 and gain["a"] > 10 * max(gain["b"], gain["c"])


def test_feature_order_and_prefixes(spark):
    rows = spark.range(1).selectExpr("id", "1 as t", "2 as b_x", "3 as a_y", "4 as b_z")
    assert features.in_order(rows, ["a_y", "b_z"]).columns == ["id", "t", "a_y", "b_z"]
    assert features.without(rows, "b_").columns == ["id", "t", "a_y"]
    assert features.names_of("select id, t, round(cast(x as int), 6) + 0e0 as p, case when a then b end as q from r") == ["p", "q"]


def test_gates_of_constant_trajectories(spark):
    rows = [(n, s, t, v) for n, v in (("t1", 0.9), ("t1_ctrl", 0.1), ("t6", 0.7), ("t6_ref", 0.7), ("t12", 0.5), ("t13", 0.5)) for s in range(5) for t in range(1, 1001)]
    d = spark.createDataFrame(rows, "scenario string, seed int, t int, score double")
    got = {r.scenario: r.passes for r in gates.judged(d).collect()}
    assert got == {"t1": True, "t6": False, "t12": True, "t13": False}
    assert {r.scenario: r.passes for r in gates.judged(d, relative=True).collect()}["t6"]
    bad = d.unionByName(spark.createDataFrame([("t12", 9, 3, float("nan"))], d.schema))
    assert not {r.scenario: r.passes for r in gates.judged(bad).collect()}["t12"]


def test_reference_panel_and_twins():
    h, x, tau = scenarios.generate("t6_ref", 3)
    assert len(h) == scenarios.HISTORY and len(x) == 1000 and tau is None and abs(x.std() - 1) < 0.1
    for name in ("t6", "t9", "t10", "t12", "t12b", "t13"):
        a, b = scenarios.generate(name, 4), scenarios.generate(f"{name}_ctrl", 4)
        assert (a[1] == b[1]).all() and b[2] is None


def test_files_of_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0, 0.5), (1, 3, 1, 0.25)], "id long, t int, y int, oof_pred double")
    sinks.write_rows(rows, f"{tmp_path}/s")
    assert sorted(sinks.read_scores(spark, f"{tmp_path}/s", ("id", "oof_pred")).collect()) == sorted(rows.collect())
    with pytest.raises(ValueError, match="lacks fold"):
        sinks.read_scores(spark, f"{tmp_path}/s", ("fold",))
    made = []

    def make():
        made.append(1)
        return rows

    for _ in range(2):
        got = sinks.kept_or_made(spark, f"{tmp_path}/c", "id long, t int, y int, oof_pred double", make)
        assert sorted(got.collect()) == sorted(rows.collect())
    assert len(made) == 1
    (tmp_path / "x.json").write_text('{"a": {"b": 2}}')
    assert sinks.read_settings(spark, f"{tmp_path}/x.json", {"a": {"b": 1, "c": 3}, "d": 4}) == {"a": {"b": 2, "c": 3}, "d": 4}
    (tmp_path / "y.json").write_text('{"a": {"z": 2}}')
    with pytest.raises(ValueError, match="unknown setting a.z"):
        sinks.read_settings(spark, f"{tmp_path}/y.json", {"a": {"b": 1}})


def test_the_training_frame_is_made_once(spark):
    """Cuts, bins and scores each computed all features anew."""
    plan = model.frame(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_pairs_of_columns_hold_each_columns_sums():
    rng = np.random.default_rng(5)
    for width in (1, 4, 5):
        code, v = rng.integers(0, model.BINS, (500, width)).astype(np.uint8), rng.integers(0, 9, 500).astype(float)
        total = np.stack([np.bincount(c, v, model.BINS**2) for c in model._pairs(code)]).reshape(-1, model.BINS, model.BINS)
        assert (model._singles(total, width) == [np.bincount(code[:, k], v, model.BINS) for k in range(width)]).all()
        tree = model.Tree([0, width - 1, 0, 0, 0, width // 2, 0], [15, 3, 9, 1, 20, 7, 30], [0.0] * 8)
        node = np.zeros(500, int)
        for _ in range(3):
            node = 2 * node + 1 + (code[np.arange(500), np.array(tree.feature)[node]] > np.array(tree.cut)[node])
        assert (tree.leaves(code) == node - 7).all()
        assert (model._bins(pa.RecordBatch.from_arrays([model._packed(code)], names=["b"]).slice(7, 90), "b", width) == code[7:97]).all()
