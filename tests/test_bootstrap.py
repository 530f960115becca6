import numpy as np
import pandas as pd
import pytest

from stillwater.operators import bootstrap, evaluation
from stillwater.plans import catalog
from stillwater.sources import stored

SF = "/root/testdata/sf0.001"


def auc(g, score):
    """Average-rank AUC by step, weighted by pairs, as the reference's weighted_ts_auc."""
    r = g.assign(r=g.groupby("t")[score].rank())
    won = weight = 0.0
    for _, s in r.groupby("t"):
        p = s.y.sum()
        won, weight = won + s.r[s.y == 1].sum() - p * (p + 1) / 2, weight + p * (len(s) - p)
    return won / weight if weight else np.nan


def test_draws_are_samples_with_replacement():
    m = bootstrap.multiplicities(400, evaluation.REPLICATES).astype(int)
    assert m.shape == (400, 501) and (m[:, 0] == 1).all() and (m.sum(0) == 400).all()
    assert len({tuple(c) for c in m.T}) == 501
    assert abs((m[:, 1:] == 0).mean() - np.exp(-1)) < 0.01 and abs(m[:, 1:].var() - 1) < 0.03
    for k in range(3):  # no class of id mod 3 is left out or drawn as a whole
        assert abs(m[k::3, 1:].sum(0).mean() - len(m[k::3])) < 3 and m[k::3, 1:].sum(0).std() > 5
    c = np.corrcoef(m[:, 1:].T)[np.triu_indices(500, 1)]
    assert abs(c.mean()) < 0.005 and c.std() < 0.06


def test_bootstrap_equals_repeated_rows(spark):
    rows = stored.run(spark, SF, "select id, t, y, bucket, score_a, score_b from scores").toPandas()
    ids = sorted(rows.id.unique())
    mult = bootstrap.multiplicities(len(ids), 12)
    got = bootstrap.bootstrap_ci(spark, SF, replicates=12).toPandas().set_index("bucket")
    for bucket in ["overall", "t<=50", "50<t<=150", "150<t<=400", "t>400"]:
        part = rows if bucket == "overall" else rows[rows.bucket == bucket]
        d = []
        for rep in range(13):
            g = part.loc[part.index.repeat(mult[np.searchsorted(ids, part.id), rep])]
            d.append(auc(g, "score_b") - auc(g, "score_a"))
        x = np.array(d[1:])[~np.isnan(d[1:])]
        r = got.loc[bucket]
        assert r.n == len(x)
        if len(x):
            lo, hi = np.quantile(x, [0.025, 0.975])
            assert [r.point_delta, r.low, r.high, r.mean_delta, r.sd_delta] == pytest.approx([d[0], lo, hi, x.mean(), x.std(ddof=1)], abs=2e-6)
            assert r.excludes_zero == (lo > 0 or hi < 0)
        else:
            assert pd.isna(r.low) and pd.isna(r.excludes_zero)


def test_bootstrap_default_is_the_references(spark):
    got = catalog.QUERIES["bootstrap_ci"](spark, SF).toPandas().set_index("bucket")
    assert got.loc["overall", "n"] == 500 and len(got) == 5
