import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from stillwater.functions import kernels as k
from stillwater.plans import catalog
from stillwater.sources import stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_oracle(spark, oracle, same, name):
    same(catalog.QUERIES[name](spark, SF).toPandas(), oracle(catalog.SQL[name], SF))


def series(spark, values):
    return spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate(values)], "id int, t int, x double")


def test_ewma_equals_recursion(spark):
    x = np.random.default_rng(1).standard_normal(200)
    got = spark.sql(f"select t, {k.ewma('x', 0.1, 1.0)} as y from {{p}} order by t", p=series(spark, x)).toPandas()["y"]
    y, want = 1.0, []
    for v in x:
        y = 0.9 * y + 0.1 * v
        want.append(y)
    assert np.allclose(got, want, atol=1e-9)


def test_reflected_sum_equals_recursion(spark):
    x = np.random.default_rng(2).standard_normal(300) - 0.1
    sql = f"select t, c - least(0e0, {k.cum('c', 'min')}) as s from (select id, t, {k.cum('x')} as c from {{p}}) q order by t"
    got = spark.sql(sql, p=series(spark, x)).toPandas()["s"]
    s, want = 0.0, []
    for v in x:
        s = max(0.0, s + v)
        want.append(s)
    assert np.allclose(got, want, atol=1e-9)


def test_bridge_equals_direct_formula(spark):
    from stillwater.operators import families as f

    x = np.random.default_rng(3).standard_normal(160)
    inn = series(spark, x).withColumnRenamed("x", "e")
    got = spark.sql(f"with inn as (select * from {{p}}), {f.bridge_ctes('e')} select {', '.join(f.bridge('level'))} from bsum order by t", p=inn).toPandas()["mrep_level_w050"]
    w = x[100:150]
    p, n = np.cumsum(w), 50
    assert got[149] == pytest.approx(((p - np.arange(1, n + 1) / n * p[-1]) ** 2).sum() / (n * n * w.var()), abs=1e-4)


def test_scores_are_causal(spark):
    """Cutting the future off changes nothing before the cut."""
    whole = catalog.QUERIES["cusum_bank"](spark, SF).where("t <= 40").toPandas().sort_values(["id", "t"]).reset_index(drop=True)
    cut = stored.Panel(stored.run(spark, SF, "select * from panel where tt <= 340"))
    part = cut.run("select id, t, cusum_sign_pos from cus where t <= 40", catalog.f.cusum_ctes()).toPandas().sort_values(["id", "t"]).reset_index(drop=True)
    m = whole.merge(part, on=["id", "t"])
    assert len(m) and np.allclose(m["cusum_sign_pos_x"].round(6), m["cusum_sign_pos_y"].round(6))


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_every_prediction_meets_its_truth(spark):
    """No truth is left out; a prediction without one stays, with a null target."""
    got = catalog.QUERIES["prediction_truth_join"](spark, SF).toPandas()
    assert len(got) and got.target.notna().all()
    join = catalog.evaluation.QUERIES["prediction_truth_join"][1]
    fixture = "with scores as (select 1 as id, t, t / 10e0 as score_a from range(1, 15) r(t)), truth as (select 1 as id, t, 1 as target from range(1, 14) r(t) union all select 2, 1, 0) "
    got = spark.sql(fixture.replace("r(t)", "as r(t)") + join).toPandas()
    assert len(got) == 14 and got[got.target.isna()].time_online.tolist() == [13]


@pytest.mark.parametrize("name", ["feature_row", "training_rows"])
def test_the_feature_row_joins_tables_of_few_families(spark, name):
    """All families in one stage took more memory than an executor has."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    groups = catalog.features._groups(catalog._families() | catalog.optional.statements("spark"))
    assert plan.count("Join") == len(groups) and "Window" not in plan and max(len(g) for g in groups) <= 4


def test_a_group_of_families_is_joined_where_its_series_lie(spark, monkeypatch):
    """An exchange for each family of a group made many stages; the session's settings are as before."""
    stored, plans = catalog.features.stored, []
    kept = stored.kept

    def seen(spark, sf_dir, name, make):
        if name.startswith("features"):
            plans.append(make()._jdf.queryExecution().executedPlan().toString())
        return kept(spark, sf_dir, name, make)

    monkeypatch.setattr(stored, "kept", seen)
    names = ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.codegen.wholeStage")
    before, small = [spark.conf.get(k) for k in names], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog.QUERIES["training_rows"](spark, SF)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert len(plans) > 1 and any("SortMergeJoin" in p for p in plans)
    assert not any(re.search(r"Exchange hashpartitioning\(id#\d+L?, t#", p) for p in plans)
    assert [spark.conf.get(k) for k in names] == before


def test_a_table_of_the_feature_row_has_one_row_a_series(spark, monkeypatch):
    """Tables of features had a row a step, thirteen times the input's bytes."""
    stored, sizes = catalog.features.stored, {}
    kept = stored.kept

    def seen(spark, sf_dir, name, make):
        out = kept(spark, sf_dir, name, make)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(stored, "kept", seen)
    rows = catalog.QUERIES["feature_row"](spark, SF)
    series = rows.select("id").distinct().count()
    made = {k: n for k, n in sizes.items() if k.startswith("features")}
    assert made and set(made.values()) == {series} and rows.count() > series


def test_the_feature_row_of_series_of_any_length_equals_the_oracle(spark, same, tmp_path):
    """One online step, steps beyond every window, equal values for a while, a spike, a history without an online part."""
    rng, rows = np.random.default_rng(4), []
    for key, n in enumerate([60, 300, 301, 307, 326, 700, 450, 420, 500]):
        x = rng.integers(1, 51, n).astype(float)
        if key == 6:
            x[320:350] = 7
        if key == 7:
            x[:] = np.tile([3.0, 9.0, 4.0], n)[:n] + rng.integers(0, 2, n)
        if key == 8:
            x[350] = 1e6
        rows += [(key, k, 1, 1, v) for k, v in enumerate(x)]
    frame = pd.DataFrame(rows, columns=["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    frame.assign(l_extendedprice=0.0, l_discount=0.0, l_tax=0.0, l_returnflag="N", l_linestatus="O", l_shipdate=20000101).to_parquet(tmp_path / "lineitem.parquet")
    got = catalog.QUERIES["feature_row"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet')")
    assert len(got) == 1 + 7 + 26 + 400 + 150 + 120 + 200
    same(got, con.execute(catalog.SQL["feature_row"]).fetchdf())


def test_steps_that_thinning_drops_are_not_handed_over():
    """Every step went through the joins and was dropped behind them."""
    import pyarrow as pa

    features, sizes = catalog.features, [1, 450, 120]
    steps = [[{"t": k + 1, **{c: float(k % 7) for c in features.STEPS}} for k in range(n)] for n in sizes]
    series = {"id": [4, 5, 6], "n": sizes, "tau_index": pa.array([None, 40, 41], pa.int32()), "steps": steps, "history": [[0.5, -0.5]] * 3} | {c: [0.3] * 3 for c in features.NUMBERS}
    compute, _ = features._computed({"varloc": catalog._families()["varloc"]}, features.training_rows({})[1].split(" s  ")[1])
    rows = pd.concat([b.to_pandas() for b in compute([pa.RecordBatch.from_pydict(series)])])
    want = {(i, t) for i, n in zip((4, 5, 6), sizes, strict=True) for t in range(1, n + 1) if t <= 100 or t <= 400 and t % 2 == 0 or t % 4 == 0}
    assert set(zip(rows.id, rows.t, strict=True)) == want and len(rows) == len(want)
    assert rows[rows.id == 5].set_index("t").y.loc[[40, 42]].tolist() == [0, 1] and not rows[rows.id == 4].y.any()
