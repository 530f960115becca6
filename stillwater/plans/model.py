"""Boosted trees on the feature row: folds by series, offset, weights, early stopping, ensembles.

Training is by histograms.  Features are binned once and written; a pass over the
rows sums gradients and curvatures per (fold model, node, feature, bin) inside
each task, the tasks' sums are added by Spark, and the driver, which gets one row
per cell (models x nodes x features x bins, whatever the number of rows), picks
the splits.  All folds' models grow in the same passes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.functions.kernels import cum
from stillwater.operators import evaluation, history
from stillwater.operators import families as f
from stillwater.plans.features import names_of
from stillwater.sources import stored

BINS, SCORES, FINE = 32, 32, 2.0**20
_BODY = f"select id, t, {', '.join(f.accum_mean() + f.accum_var() + f.accum_exceed() + f.accum_sign() + f.accum_shape() + f.varloc())} from inn"
FEATURES = sorted(names_of(_BODY))


@dataclass
class Tree:
    """A complete tree: (feature, highest bin to the left) per inner node, a value per leaf."""

    feature: list[int]
    cut: list[int]
    value: list[float]
    gain: list[float] = field(default_factory=list)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = [(bins[:, f] > c).view(np.int8) for f, c in zip(self.feature, self.cut)]  # whole columns, so bins are best in Fortran's order
        for i in reversed(range(len(at) // 2)):  # places among the leaves below a node, from those below its children
            half = 1 << len(at).bit_length() - (i + 1).bit_length()
            at[i] = np.where(at[i], half + at[2 * i + 2], at[2 * i + 1])
        return at[0].astype(np.int64)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaves(bins)]


@dataclass
class Booster:
    edges: list[list[float]]  # upper edges of each feature's bins; bin 0 holds nulls
    trees: list[Tree]
    features: list[str]

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8, order="F")
        for k, e in enumerate(self.edges):
            out[:, k] = np.where(np.isfinite(x[:, k]), 1 + np.searchsorted(e, x[:, k], side="left"), 0)
        return out

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.margin(bins) for t in self.trees), np.zeros(len(bins)))

    def importance(self) -> dict[str, tuple[float, int]]:
        """feature -> (summed gain, number of splits)."""
        out = dict.fromkeys(self.features, (0.0, 0))
        for t in self.trees:
            for k, g in zip(t.feature, t.gain):
                if g > 0:
                    out[self.features[k]] = (out[self.features[k]][0] + g, out[self.features[k]][1] + 1)
        return out

    def saved(self) -> str:
        return json.dumps({"edges": self.edges, "features": self.features, "trees": [t.__dict__ for t in self.trees]})

    @classmethod
    def loaded(cls, text: str) -> Booster:
        d = json.loads(text)
        return cls(d["edges"], [Tree(**t) for t in d["trees"]], d["features"])


def fuse(boosters: list[Booster]) -> Booster:
    """One booster whose margin is the mean of theirs: all trees, leaves divided by how many there are."""
    n = len(boosters)
    return Booster(boosters[0].edges, [Tree(t.feature, t.cut, [v / n for v in t.value], t.gain) for b in boosters for t in b.trees], boosters[0].features)


def save(spark: SparkSession, boosters: list[Booster], path: str) -> None:
    spark.createDataFrame([(i, b.saved()) for i, b in enumerate(boosters)], "fold int, model string").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> list[Booster]:
    return [Booster.loaded(r["model"]) for r in spark.read.parquet(path).orderBy("fold").collect()]  # one row a fold


def _bins(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    c = batch.column(column)
    at = np.frombuffer(c.buffers()[1], np.int32)[c.offset] if len(c) else 0
    raw = np.frombuffer(c.buffers()[2], np.uint8)[at : at + len(c) * width] if len(c) else np.zeros(0, np.uint8)
    return np.asfortranarray(raw.reshape(-1, width))


def _packed(code: np.ndarray) -> pa.Array:
    """Each row's bins as a binary."""
    ends = np.arange(len(code) + 1, dtype=np.int32) * code.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(code))])


def _pairs(code: np.ndarray) -> list[np.ndarray]:
    """Columns of bins taken two by two, one number for both; an odd last one stands alone."""
    wide = np.asfortranarray(code.astype(np.int64))
    return [wide[:, k] * BINS + (wide[:, k + 1] if k + 1 < wide.shape[1] else 0) for k in range(0, wide.shape[1], 2)]


def _singles(total: np.ndarray, width: int) -> np.ndarray:
    """(..., pairs, BINS, BINS) -> (..., width, BINS)."""
    both = np.stack((total.sum(-1), total.sum(-2)), -2)
    return both.reshape(*total.shape[:-3], -1, BINS)[..., :width, :]


def train(rows: DataFrame, features: list[str], folds: int = 5, rounds: int = 8, depth: int = 3, rate: float = 0.2, ridge: float = 5.0, patience: int = 3, seed: int | None = None, share: float = 0.8, objective: str = "logloss") -> list[Booster]:
    """rows(id, t, y, weight, base, fold, features...) -> a booster per fold, learnt from the other folds.

    base is the offset of the margin.  seed: each tree sees `share` of the series, by hash.
    A fold's model ends with the round of least weighted log loss on its own
    fold's rows; it stops when `patience` rounds were no better.
    objective "rank": every pair of a positive and a negative row of one step
    counts once, whatever its size, by logistic pairwise gradients against the
    step's counts per bin of scores (a pass a round; the driver gets a row per
    model, step and bin).  Offsets, weights and early stopping play no part.
    """
    spark = rows.sparkSession
    cuts = rows.agg(*[F.percentile_approx(F.col(c), [k / (BINS - 2) for k in range(1, BINS - 2)], 1000).alias(c) for c in features]).first()
    edges = [sorted(set(cuts[c] or [])) for c in features]
    shape = Booster(edges, [], features)
    width = len(features)

    def pack(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], 1)
            code = shape.binned(x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "t", "y", "weight", "base", "fold")), _packed(code)], names=["id", "t", "y", "weight", "base", "fold", "bins"])

    path = f"{stored.shared_dir(spark)}/models/bins-{uuid.uuid4().hex[:12]}"
    rows.select(F.col("id").cast("long"), F.col("t").cast("int"), F.col("y").cast("int"), F.col("weight").cast("double"), F.col("base").cast("double"), F.col("fold").cast("int"), *features).mapInArrow(pack, "id long, t int, y int, weight double, base double, fold int, bins binary").write.parquet(path)
    binned = spark.read.parquet(path)
    trees: list[list[Tree]] = [[] for _ in range(folds)]
    best, stale = [(np.inf, 0)] * folds, [0] * folds

    odds = (np.arange(SCORES) + 0.5) / (SCORES - np.arange(SCORES) - 0.5)  # in the middle of each bin of scores

    def standings() -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
        """For each model: the steps, positive and negative rows per step and bin of scores, and the mean number of rows a step."""

        def partial(batches):
            for b in batches:
                code, y, t, fold = _bins(b, "bins", width), *(b.column(c).to_numpy() for c in ("y", "t", "fold"))
                for m in range(folds):
                    use = fold != m
                    place = np.minimum((SCORES / (1 + np.exp(-Booster(edges, trees[m], features).margin(code[use])))).astype(np.int64), SCORES - 1)
                    keys, at = np.unique(t[use].astype(np.int64) * SCORES + place, return_inverse=True)
                    pos = np.bincount(at, y[use], len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), m, np.int32)), pa.array(keys), pa.array(pos), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64) - pos)], names=["model", "key", "pos", "neg"])

        got = binned.mapInArrow(partial, "model int, key long, pos long, neg long").groupBy("model", "key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()
        out = []
        for m in range(folds):
            g = got[got["model"] == m]
            steps, row = np.unique(g["key"].to_numpy() // SCORES, return_inverse=True)
            pos, neg = np.zeros((len(steps), SCORES)), np.zeros((len(steps), SCORES))
            pos[row, g["key"] % SCORES], neg[row, g["key"] % SCORES] = g["pos"], g["neg"]
            out.append((steps, pos, neg, float((pos + neg).sum() / max(1, len(steps)))))
        return out

    def pairwise(margin: np.ndarray, y: np.ndarray, t: np.ndarray, against: tuple) -> tuple[np.ndarray, np.ndarray]:
        steps, pos, neg, mean = against
        at = np.minimum(np.searchsorted(steps, t), max(0, len(steps) - 1))
        # a pair is odds / (odds + own) from being won by a positive row, own / (odds + own) by a negative one
        own, one = np.exp(margin), y == 1
        many = (np.concatenate((pos, neg)) * (odds / mean))[at + len(steps) * one]
        q = 1 / (own[:, None] + odds)
        lost = many * q
        return np.where(one, -lost.sum(1), own * (lost @ (1 / odds))), own * np.einsum("rk,rk->r", lost, q)

    def sums(grown: list[Tree | None], level: int, turn: int, standing: list | None = None) -> dict:
        """model -> (2, nodes, features, bins) gradients and curvatures, and the loss on its own fold before this round."""
        nodes = 2**level

        def partial(batches):
            total, loss = np.zeros((folds, 2, -(-width // 2), nodes * BINS * BINS)), np.zeros((folds, 2))
            for b in batches:
                code, y, w, base, fold, ids, t = _bins(b, "bins", width), *(b.column(c).to_numpy() for c in ("y", "weight", "base", "fold", "id", "t"))
                pairs = _pairs(code)
                for m in range(folds):
                    margin = (0 if objective == "rank" else base) + Booster(edges, trees[m], features).margin(code)
                    p = 1 / (1 + np.exp(-margin))
                    own = fold == m
                    loss[m] += (w[own] * -np.log(np.maximum(np.where(y[own] == 1, p[own], 1 - p[own]), 1e-12))).sum(), w[own].sum()
                    use = ~own
                    if seed is not None:
                        use &= (ids * 48271 + (seed + turn) * 69621 + 12345) % 2147483647 % 1000 < 1000 * share
                    at = grown[m].leaves(code)[use] * (BINS * BINS) if grown[m] else np.zeros(int(use.sum()), np.int64)
                    parts = pairwise(margin[use], y[use], t[use], standing[m]) if standing else (w[use] * (p[use] - y[use]), w[use] * p[use] * (1 - p[use]))
                    for k, both in enumerate(pairs):
                        cell = both[use] + at
                        for i, v in enumerate(parts):
                            total[m, i, k] += np.bincount(cell, v, total.shape[3])
            total = _singles(total.reshape(folds, 2, -1, nodes, BINS, BINS).swapaxes(2, 3), width).reshape(folds, 2, -1)
            at = np.argwhere(np.abs(total).sum(1) > 0)
            cols = [at[:, 0], at[:, 1], total[at[:, 0], 0, at[:, 1]], total[at[:, 0], 1, at[:, 1]]]
            cols = [np.concatenate((c, x)) for c, x in zip(cols, (np.arange(folds), np.full(folds, -1), loss[:, 0], loss[:, 1]))]
            # in steps of 2^-20, so that the tasks' sums add up to the same however they arrive
            fixed = [pa.array(np.rint(np.asarray(c, float) * FINE).astype(np.int64)) for c in cols[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *fixed], names=["model", "cell", "g", "h"])

        exact = lambda c: (F.sum(F.col(c).cast("decimal(28,0)")).cast("double") / FINE).alias(c)
        got = binned.mapInArrow(partial, "model int, cell long, g long, h long").groupBy("model", "cell").agg(exact("g"), exact("h"))
        out = {m: (np.zeros((2, nodes, width, BINS)), [0.0, 0.0]) for m in range(folds)}
        for r in got.collect():  # models x nodes x features x bins rows at most
            if r["cell"] < 0:
                out[r["model"]][1][:] = r["g"], r["h"]
            else:
                out[r["model"]][0].reshape(2, -1)[:, r["cell"]] = r["g"], r["h"]
        return out

    for turn in range(rounds):
        grown: list[Tree | None] = [None] * folds
        standing = standings() if objective == "rank" else None
        for level in range(depth):
            found = sums(grown, level, turn, standing)
            for m, (hist, loss) in found.items():
                if level == 0 and loss[1] > 0 and objective != "rank":
                    now = loss[0] / loss[1]
                    best[m], stale[m] = ((now, turn), 0) if now < best[m][0] - 1e-9 else (best[m], stale[m] + 1)
                feature, cut, gain, value = (list(x) for x in ((grown[m].feature, grown[m].cut, grown[m].gain, []) if grown[m] else ([], [], [], [])))
                for node in range(2**level):
                    g, h = hist[0, node], hist[1, node]
                    left_g, left_h = np.cumsum(g, 1), np.cumsum(h, 1)
                    all_g, all_h = left_g[0, -1], left_h[0, -1]
                    score = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                    k, c = np.unravel_index(np.argmax(score[:, :-1]), score[:, :-1].shape)
                    feature.append(int(k)), cut.append(int(c)), gain.append(float(score[k, c]))
                    for a, b in ((left_g[k, c], left_h[k, c]), (all_g - left_g[k, c], all_h - left_h[k, c])):
                        value.append(float(-rate * a / (b + ridge)))
                grown[m] = Tree(feature, cut, value, gain)
        for m in range(folds):
            if stale[m] < patience:
                trees[m].append(grown[m])
        if all(s >= patience for s in stale):
            break
    found = sums([None] * folds, 0, rounds) if objective != "rank" else {}
    for m, (_, loss) in found.items():
        if loss[1] > 0 and loss[0] / loss[1] >= best[m][0] - 1e-9:
            trees[m] = trees[m][: max(1, best[m][1])]
    return [Booster(edges, t, features) for t in trees]


def scored(rows: DataFrame, boosters: list[Booster], mode: str = "oof") -> DataFrame:
    """id, t, y, fold, pred.

    oof: the fold's own model with the offset.  rank: the fold's own model without it.  mean: the mean of all models' probabilities without it.
    fused: the probability of the fused margin.  combined: half of each of the last two.
    """
    features, fused = boosters[0].features, fuse(boosters)
    squash = lambda m: 1 / (1 + np.exp(-m))

    def run(batches):
        for b in batches:
            code = boosters[0].binned(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], 1))
            if mode in ("oof", "rank"):
                fold, margin = b.column("fold").to_numpy(), b.column("base").to_numpy() * float(mode == "oof")
                for m, booster in enumerate(boosters):
                    margin[fold == m] += booster.margin(code[fold == m])
                pred = squash(margin)
            else:
                mean, one = np.mean([squash(x.margin(code)) for x in boosters], 0), squash(fused.margin(code))
                pred = {"mean": mean, "fused": one, "combined": (mean + one) / 2}[mode]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "t", "y", "fold")), pa.array(pred)], names=["id", "t", "y", "fold", "pred"])

    return rows.select(F.col("id").cast("long"), F.col("t").cast("int"), F.col("y").cast("int"), F.col("fold").cast("int"), F.col("base").cast("double"), *features).mapInArrow(run, "id long, t int, y int, fold int, pred double")


_WEIGHTS = evaluation.QUERIES["row_weights"]
_FOLDS = evaluation.QUERIES["kfold_assign"]


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t, y, weight, base, fold and FEATURES of the steps that thinning keeps, made once a session."""
    return stored.kept(spark, sf_dir, "training", lambda: _frame(spark, sf_dir))


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = stored.run(spark, sf_dir, _WEIGHTS[1], _WEIGHTS[0]).select("id", "t", "y", "weight")
    base = stored.run(spark, sf_dir, "select t, offset_t as base from base", evaluation.CURVE)
    folds = stored.run(spark, sf_dir, _FOLDS[1], _FOLDS[0]).select("id", "fold")
    return stored.run(spark, sf_dir, _BODY).join(weights, ["id", "t"]).join(base, "t").join(folds, "id")


_TRAINED: dict[tuple, list[Booster]] = {}


def _trained(spark: SparkSession, sf_dir: str, rows: DataFrame, seed: int | None = None, objective: str = "logloss") -> list[Booster]:
    key = (spark.sparkContext.applicationId, seed, objective, *stored._stamp(spark, f"{sf_dir}/lineitem.parquet"))
    if key not in _TRAINED:
        _TRAINED[key] = train(rows, FEATURES, seed=seed, objective=objective)
    return _TRAINED[key]


def train_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t, y, fold, pred: out-of-fold probabilities."""
    rows = frame(spark, sf_dir)
    return scored(rows, _trained(spark, sf_dir, rows))


def rank_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t, y, fold, pred: out-of-fold scores of models that order the rows of each step."""
    rows = frame(spark, sf_dir)
    return scored(rows, _trained(spark, sf_dir, rows, objective="rank"), "rank")


def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir)
    return scored(rows, _trained(spark, sf_dir, rows), "mean")


def ensemble_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the probability models' mean and half of the ranking models' mean."""
    rows = frame(spark, sf_dir)
    one = scored(rows, _trained(spark, sf_dir, rows), "mean")
    two = scored(rows, _trained(spark, sf_dir, rows, objective="rank"), "mean").select("id", "t", F.col("pred").alias("other"))
    return one.join(two, ["id", "t"]).select("id", "t", "y", "fold", ((F.col("pred") + F.col("other")) / 2).alias("pred"))


def seed_bagging(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = (777, 101)) -> DataFrame:
    """Out-of-fold probabilities averaged over models of several seeds."""
    rows = frame(spark, sf_dir)
    parts = [scored(rows, _trained(spark, sf_dir, rows, s)).withColumn("seed", F.lit(s)) for s in seeds]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("id", "t", "y", "fold").agg(F.avg("pred").alias("pred"))


def fold_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, ts_auc, logloss of each fold's own model."""
    oof = train_oof(spark, sf_dir)
    sql = f"with oof as (select *, 'all' as bucket from {{oof}}), {evaluation.by_step('pred', 'sv', 'oof', 'fold, t', '')} select a.fold, ts_auc, logloss from (select fold, sum(w * auc) / sum(w) as ts_auc from sv group by fold) a join (select fold, avg(-ln(greatest(case when y = 1 then pred else 1 - pred end, 1e-12))) as logloss from oof group by fold) b on a.fold = b.fold"
    return spark.sql(sql, oof=oof)


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, gain_mean, split_mean over folds, most gain first."""
    boosters = _trained(spark, sf_dir, frame(spark, sf_dir))
    rows = [(i, c, float(g), float(n)) for i, b in enumerate(boosters) for c, (g, n) in b.importance().items()]
    out = spark.createDataFrame(rows, "fold int, feature string, gain double, splits double")
    return out.groupBy("feature").agg(F.avg("gain").alias("gain_mean"), F.avg("splits").alias("split_mean")).orderBy(F.desc("gain_mean"), "feature")


def parameter_grid(spark: SparkSession, sf_dir: str, depths: tuple[int, ...] = (2, 3), rates: tuple[float, ...] = (0.1, 0.2)) -> DataFrame:
    """depth, rate, logloss of out-of-fold scores for each setting of a small grid."""
    rows, out = frame(spark, sf_dir), None
    for depth in depths:
        for rate in rates:
            oof = scored(rows, train(rows, FEATURES, folds=5, rounds=3, depth=depth, rate=rate))
            one = oof.agg(F.avg(-F.log(F.greatest(F.when(F.col("y") == 1, F.col("pred")).otherwise(1 - F.col("pred")), F.lit(1e-12)))).alias("logloss")).select(F.lit(depth).alias("depth"), F.lit(rate).alias("rate"), "logloss")
            out = one if out is None else out.unionByName(one)
    return out


def postprocess_ema(spark: SparkSession, sf_dir: str, alpha: float = 0.7) -> DataFrame:
    """Exponential smoothing with weight alpha on the new score: a fold over each series' ordered scores."""
    scores = stored.run(spark, sf_dir, "select id, t, score_a from scores")
    lists = scores.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "score_a"))).alias("s"))
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["t"].alias("t"), F.when(F.size(acc) == 0, x["score_a"]).otherwise(alpha * x["score_a"] + (1 - alpha) * F.element_at(acc, -1)["score"]).alias("score"))))
    none = F.array().cast("array<struct<t:int,score:double>>")
    return lists.select("id", F.explode(F.aggregate("s", none, step)).alias("r")).select("id", "r.t", F.round("r.score", 6).alias("score"))


def history_classifier(spark: SparkSession, sf_dir: str, folds: int = 5) -> DataFrame:
    """target, auc, base_rate, n: whether the history alone tells a break, or an early one; logistic regression, folds by hash of the series."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    more, body = history.statements()["history_features"]
    taus = stored.run(spark, sf_dir, "select distinct id, tau_index from panel")
    rows = stored.run(spark, sf_dir, body, more).join(taus, "id")
    columns = [c for c in rows.columns if c not in ("id", "has_break", "tau_index")]
    rows = rows.fillna(0.0, columns).withColumn("early_break", F.coalesce((F.col("tau_index") <= 50).cast("int"), F.lit(0)))
    path = f"{stored.shared_dir(spark)}/models/history-{uuid.uuid4().hex[:12]}"
    rows.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(folds))).write.parquet(path)
    rows, out = spark.read.parquet(path), None
    for target in ("has_break", "early_break"):
        oof = None
        for k in range(folds):
            steps = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", labelCol=target, maxIter=50, regParam=0.01)]
            fitted = Pipeline(stages=steps).fit(rows.where(F.col("fold") != k))
            part = fitted.transform(rows.where(F.col("fold") == k)).select("id", F.col(target).alias("y"), vector_to_array("probability")[1].alias("s"))
            oof = part if oof is None else oof.unionByName(part)
        sql = f"with oof as (select 1 as t, y, s from {{oof}}), {evaluation.by_step('s', 'one', 'oof', 't', '')} select '{target}' as target, coalesce((select max(auc) from one), 0.5) as auc, avg(y) as base_rate, count(*) as n from oof"
        one = spark.sql(sql, oof=oof)
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {q.__name__: q for q in (history_classifier, train_oof, rank_oof, ensemble_mean, ensemble_combined, seed_bagging, fold_evaluation, feature_importance, postprocess_ema)}
#: The smoothing as a sum over the last steps: weights fall by 0.3 a step, so those beyond 60 steps are below 1e-31.
ORACLE = {
    "postprocess_ema": (
        "em as (select a.id, a.t, sum(case when b.t = 1 then b.score_a * power(0.3e0, a.t - 1) else 0.7e0 * b.score_a * power(0.3e0, a.t - b.t) end) as score from scores a join scores b on a.id = b.id and b.t <= a.t and b.t > a.t - 60 group by a.id, a.t)",
        "select id, t, round(score, 6) as score from em",
    )
}

__all__ = ["Booster", "Tree", "cum", "fuse", "load", "save", "scored", "train"]
