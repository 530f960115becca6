import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.operators import recursive
from stillwater.plans import catalog, harness, scoring
from stillwater.sources import stored
from stillwater.streaming import scoring as streaming

SF = "/root/testdata/sf0.001"


def test_streamed_scores_equal_the_batch(spark, tmp_path):
    """Steps arrive in three files, the second before its turn; every score equals the batch's."""
    online = stored.run(spark, SF, "select id, t, x from online where id <= 4")
    for k, where in enumerate(("t <= 30", "t > 70", "t > 20 and t <= 70")):
        online.where(where).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(online.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = streaming.stream_scores(source, streaming.history_fits(spark, SF)).writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("streamed").toPandas()
    want = scoring.fallback_full(spark, SF).where("id <= 4").toPandas()
    both = got.merge(want, on=["id", "t"], how="outer")
    assert len(got) == len(want) == len(both) and np.allclose(both.score_x, both.score_y, atol=2e-6)


def test_scores_do_not_look_ahead_and_a_canary_that_does_is_caught(spark):
    panel = stored.run(spark, SF, "select * from panel where id <= 3")
    cuts = (1, 40, 99)
    names = ["accum_mean", "cusum_bank", "haar_energy", "varloc"]
    for name in names:
        more, body = catalog._SPARK[name]
        assert harness.prefix_differences(panel, body, more, cuts) == 0, name
    assert harness.prefix_differences(panel, "select id, t, max(x) over (partition by id) as ahead from inn", "", cuts) > 0


def test_runs_repeat_to_the_last_bit(spark):
    panel = stored.run(spark, SF, "select * from panel where id <= 3")
    more, body = catalog._SPARK["cusum_bank"]
    assert harness.same_again(panel, body, more) and harness.same_again(panel.repartition(7), body, more)


def test_calibrated_kernel_distances(spark):
    got = recursive.calibrate_mmd(spark, SF).where("id = 1").toPandas().sort_values("t")
    rows = recursive.residuals(spark, SF).where("id = 1").toPandas().sort_values(["period", "t"])
    past, now = rows[rows.period == 1].e.to_numpy(), rows[rows.period == 2].e.to_numpy()
    first, second = recursive.KernelDistance(past), recursive.KernelDistance(past)
    null = np.array([first.step(x) for x in past])
    raw = np.array([second.step(x) for x in now])
    for k, name in enumerate(recursive.KernelDistance.NAMES):
        least = {"vfast": 12, "fast": 50}.get(name.rsplit("_", 1)[1], 200)
        arr = null[least:, k]
        arr = arr[np.isfinite(arr)]
        want = (raw[:, k] - arr.mean()) / max(arr.std(ddof=1), 1e-6)
        want[: least - 1] = np.nan
        assert np.allclose(got[f"{name}_cal"], np.round(want, 6), atol=2e-6, equal_nan=True)


def test_history_classifier(spark):
    got = {r.target: r for r in catalog.QUERIES["history_classifier"](spark, SF).collect()}
    assert set(got) == {"has_break", "early_break"} and all(0 <= r.auc <= 1 and r.n == 10 for r in got.values())


@pytest.mark.parametrize("name", ["bayes_filter", "bocpd", "mmd"])
def test_series_in_one_batch_do_not_touch(spark, name):
    """A series' features are the same alone and among others."""
    rows = recursive.residuals(spark, SF)
    both = recursive.run_block(rows.where("id <= 4"), name).where("id = 2").toPandas().sort_values("t")
    alone = recursive.run_block(rows.where(F.col("id") == 2), name).toPandas().sort_values("t")
    assert np.allclose(both.to_numpy(float), alone.to_numpy(float), equal_nan=True)
