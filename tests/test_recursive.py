import math

import numpy as np
import pytest

from stillwater.operators import recursive as r
from stillwater.streaming.scoring import stream_block

SF = "/root/testdata/sf0.001"


def student(x, df, loc, var):
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi * var) - (df + 1) / 2 * math.log1p((x - loc) ** 2 / (df * var))


def test_single_change_equals_triangular_sum():
    """Up to 48 steps nothing is pruned: weights by direct marginal likelihoods per change point."""
    x, h = np.random.default_rng(4).standard_normal(48) * 1.4 + 0.3, 0.01
    f = r.SingleChange(h)
    for t in range(1, 49):
        got = f.step(float(x[t - 1]))
        normal = lambda v: math.log(1 - h) - 0.5 * math.log(2 * math.pi) - 0.5 * v * v
        weights = []
        for s in range(1, t + 1):
            w = sum(normal(v) for v in x[: s - 1]) + math.log(h)
            for k in range(s, t + 1):
                past = x[s - 1 : k - 1]
                n, m = len(past), past.mean() if len(past) else 0.0
                kappa, nu = 0.5 + n, 2.0 + n
                var = (3.0 + ((past - m) ** 2).sum() + 0.5 * n / kappa * m * m) / nu
                w += student(x[k - 1], nu, n * m / kappa, var * (1 + 1 / kappa))
            weights.append(w)
        weights = np.array(weights)
        odds = np.log(np.exp(weights - weights.max()).sum()) + weights.max() - sum(normal(v) for v in x[:t])
        assert got[0] == pytest.approx(odds, abs=1e-8)
        assert got[1] == t - (int(weights.argmax()) + 1)


def test_single_change_keeps_bound_and_youngest():
    f = r.SingleChange(0.02)
    for x in np.random.default_rng(5).standard_normal(400) * 3:
        f.step(float(x))
    assert len(f.w) == 48 and list(f.born[-8:]) == list(range(393, 401))


def test_run_length_equals_direct_recursion():
    x, b = np.random.default_rng(6).standard_normal(30), r.RunLength()
    p = {0: 1.0}
    for t in range(1, 31):
        new = {0: 0.0}
        for k, q in p.items():
            beta, alpha = 1 + (x[t - 1 - k : t - 1] ** 2).sum() / 2, 2 + k / 2
            like = q * math.exp(student(x[t - 1], 2 * alpha, 0.0, beta / alpha))
            new[0] += like / 250
            new[k + 1] = like * 249 / 250
        total = sum(new.values())
        p = {k: v / total for k, v in new.items()}
        got = b.step(float(x[t - 1]))
        if t >= 5:
            assert got[1] == pytest.approx(sum(p[k] for k in range(5)), abs=1e-10)
            assert got[3] == pytest.approx(math.log1p(max(p, key=p.get)))


def test_run_length_finds_a_change_of_variance():
    b, g = r.RunLength(), np.random.default_rng(7)
    for x in g.standard_normal(300):
        b.step(float(x))
    for x in g.standard_normal(100) * 4:
        out = b.step(float(x))
    assert out[0] > math.log(8) and math.expm1(out[3]) == pytest.approx(100, abs=15)


def test_kernel_distance_starts_at_home_and_grows():
    g = np.random.default_rng(8)
    k = r.KernelDistance(g.standard_normal(1000))
    still = [k.step(float(x)) for x in g.standard_normal(200)][-1]
    moved = [k.step(float(x)) for x in g.standard_normal(100) + 3][-1]
    assert moved[0] > 2 * still[0] and moved[3] > still[3]
    assert k.home[0] == pytest.approx(k.features(np.random.default_rng(8).standard_normal((1000, 1)), k.one).mean(0))


@pytest.mark.parametrize("name", sorted(r.QUERIES))
def test_prefix_equivalence(spark, name):
    """A cut of the future changes nothing before it."""
    rows = r.residuals(spark, SF).cache()
    whole = r.run_block(rows, name).where("t <= 30").toPandas()
    part = r.run_block(rows.where("period = 1 or t <= 30"), name).toPandas()
    whole, part = (d.sort_values(["id", "t"]).reset_index(drop=True) for d in (whole, part))
    assert len(whole) and whole.equals(part)


def test_null_values_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 2, 1, 0.5), (1, 2, 2, None), (1, 2, 3, float("nan")), (1, 2, 4, 0.1)], "id long, period int, t int, e double")
    assert [x["t"] for x in r.run_block(rows, "bayes_filter").orderBy("t").collect()] == [1, 4]
    assert r.run_block(rows.where("id > 1"), "bocpd").count() == 0


@pytest.mark.parametrize("name", ["bayes_filter", "bocpd"])
def test_stream_equals_batch(spark, tmp_path, name):
    rows = r.residuals(spark, SF).where("period = 2 and t <= 40 and id <= 3").cache()
    for k, part in enumerate(("t <= 15", "t > 10 and t <= 40")):  # steps 11 to 15 come twice
        rows.where(part).select("id", "t", "e").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("id long, t int, e double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_block(stream, name).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["id", "t"]).reset_index(drop=True)
    want = r.run_block(rows, name).toPandas().sort_values(["id", "t"]).reset_index(drop=True)
    assert len(got) == len(want) and np.allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)
