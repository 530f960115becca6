"""Recursions without a relational form, as step classes: one class serves batch (a grouped map per series) and streams.

A block steps many series side by side: it takes one standardised value a series
and returns one row a series.  It can be pickled, so a stream keeps one of one
series as that series' state.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.sources import stored

LN_2PI = math.log(2 * math.pi)


class _Gammas:
    """lgamma(a + (k + 1) / 2) - lgamma(a + k / 2) for k = 0, 1, ..., grown as asked."""

    def __init__(self, a: float):
        self.a, self.table = a, np.zeros(0)

    def __call__(self, k: np.ndarray) -> np.ndarray:
        if (need := int(k.max()) + 1) > len(self.table):
            self.table = np.array([math.lgamma(self.a + (i + 1) / 2) - math.lgamma(self.a + i / 2) for i in range(2 * need + 64)])
        return self.table[k]


class Changes:
    """Weights of 'changed at s' for one hazard, for many series at once: a row a series, a column a candidate.

    Normal-inverse-chi-square prior; at most `most` candidates, the `young` latest always kept.
    """

    def __init__(self, series: int, hazard: float, most: int = 48, young: int = 8, kappa0: float = 0.5, nu0: float = 2.0, var0: float = 1.5, limit: float = 600.0):
        self.ln_h, self.ln_stay = math.log(hazard), math.log1p(-hazard)
        self.most, self.young, self.kappa0, self.nu0, self.var0, self.limit = most, young, kappa0, nu0, var0, limit
        self.t, self.none, self.gammas = 0, np.zeros(series), _Gammas(nu0 / 2)
        self.born = self.n = np.zeros((series, 0), np.int64)
        self.mean = self.m2 = self.w = np.zeros((series, 0))

    def predictive(self, n: np.ndarray, mean: np.ndarray, m2: np.ndarray, x: np.ndarray) -> np.ndarray:
        kappa, nu = self.kappa0 + n, self.nu0 + n
        var = (self.nu0 * self.var0 + m2 + self.kappa0 * n / kappa * mean * mean) / nu * (1 + 1 / kappa)
        z = x - n * mean / kappa
        return self.gammas(n) - 0.5 * np.log(nu * math.pi * var) - (nu + 1) / 2 * np.log1p(z * z / (nu * var))

    def step(self, x: np.ndarray) -> np.ndarray:
        """(series, 5): log odds of a change, age of the likeliest, its log, its mean as a z-score, log of its variance."""
        self.t += 1
        x = np.asarray(x, float)[:, None]
        new = np.zeros((len(x), 1))
        # a candidate born now has seen nothing: its column goes through the same update as the others
        born, n = np.hstack((self.born, new.astype(np.int64) + self.t)), np.hstack((self.n, new.astype(np.int64)))
        mean, m2, w = np.hstack((self.mean, new)), np.hstack((self.m2, new)), np.hstack((self.w, self.none[:, None] + self.ln_h))
        w = w + self.predictive(n, mean, m2, x)
        n, gap = n + 1, x - mean
        mean = mean + gap / n
        m2 = m2 + gap * (x - mean)
        self.none = self.none + self.ln_stay - 0.5 * LN_2PI - 0.5 * x[:, 0] * x[:, 0]
        if w.shape[1] > self.most:
            old = w.shape[1] - self.young
            rank = np.sort(np.argsort(-w[:, :old], axis=1, kind="stable")[:, : self.most - self.young], axis=1)
            stay = np.hstack((rank, np.broadcast_to(np.arange(old, w.shape[1]), (len(x), self.young))))
            born, n, mean, m2, w = (np.take_along_axis(v, stay, 1) for v in (born, n, mean, m2, w))
        high = w.max(1)
        top = np.maximum(high, self.none)
        shift = np.where(np.abs(top) > self.limit, top, 0.0)
        w, high, self.none = w - shift[:, None], high - shift, self.none - shift
        self.born, self.n, self.mean, self.m2, self.w = born, n, mean, m2, w
        best = w.argmax(1)[:, None]
        age = (self.t - np.take_along_axis(born, best, 1)[:, 0]).astype(float)
        of = lambda v: np.take_along_axis(v, best, 1)[:, 0]
        odds = high + np.log(np.exp(w - high[:, None]).sum(1)) - self.none
        return np.stack((odds, age, np.log1p(age), np.sqrt(of(n)) * of(mean), np.log(of(m2) / of(n) + 1e-9)), 1)


class SingleChange:
    """Changes of one series."""

    def __init__(self, hazard: float, **prior):
        self.many = Changes(1, hazard, **prior)

    w = property(lambda self: self.many.w[0])
    born = property(lambda self: self.many.born[0])

    def step(self, x: float) -> tuple[float, ...]:
        return tuple(self.many.step(np.array([x]))[0].tolist())


class BayesFilter:
    HAZARDS = (0.02, 0.01, 0.0025)
    NAMES = tuple(f"bayes_{k}_h{round(h * 10000):04d}" for h in HAZARDS for k in ("lo", "age_map", "age_ln1p", "map_z_mean", "map_var_ln"))

    def __init__(self, series: int = 1):
        self.filters = [Changes(series, h) for h in self.HAZARDS]

    def step(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([f.step(x) for f in self.filters])


class RunLengths:
    """Posterior of the time since a change, for many series at once: a row a series, a column a length from 0 on.

    Values are normal around zero with an unknown variance (inverse gamma prior);
    the last column gathers all lengths from there on.
    """

    NAMES = ("bocpd_regime_var_ln", "bocpd_cp_prob", "bocpd_rl_entropy", "bocpd_map_runlen")

    def __init__(self, series: int = 1, longest: int = 256, hazard: float = 1 / 250, shape: float = 2.0, scale: float = 1.0, recent: int = 5, warm: int = 5):
        lengths = np.arange(longest + 1)
        self.shapes, self.ratio = shape + lengths / 2, _Gammas(shape)(lengths)
        self.hazard, self.scale, self.recent, self.warm, self.t = hazard, scale, recent, warm, 0
        self.weight, self.squares = np.zeros((series, longest + 1)), np.zeros((series, longest + 1))
        self.weight[:, 0] = 1.0

    def step(self, x: np.ndarray) -> np.ndarray:
        """(series, 4): log of the expected variance, weight of the recent lengths, entropy, log of the likeliest length."""
        self.t += 1
        square = np.square(np.asarray(x, float))[:, None]
        rate = self.scale + self.squares / 2
        seen = self.ratio - 0.5 * np.log(2 * math.pi * rate) - (self.shapes + 0.5) * np.log1p(square / (2 * rate))
        grown = self.weight * np.exp(seen - seen.max(1, keepdims=True))
        whole = grown.sum(1)
        moved = np.empty_like(grown)
        moved[:, 0], moved[:, 1:] = whole * self.hazard, grown[:, :-1] * (1 - self.hazard)
        moved[:, -1] += grown[:, -1] * (1 - self.hazard)
        total = moved.sum(1, keepdims=True)
        self.weight = np.divide(moved, total, out=moved, where=total > 0)
        longer = self.squares + square
        self.squares = np.hstack((np.zeros_like(square), longer[:, :-2], longer[:, -1:]))
        if self.t < self.warm:
            return np.full((len(square), 4), math.nan)
        var = (self.weight * (self.scale + self.squares / 2) / np.maximum(self.shapes - 1, 0.5)).sum(1)
        some = np.where(self.weight > 1e-12, self.weight, 1.0)
        return np.stack((np.log(np.maximum(var, 1e-12)), self.weight[:, : self.recent].sum(1), -(some * np.log(some)).sum(1), np.log1p(self.weight.argmax(1))), 1)


class RunLength(RunLengths):
    """Run lengths of one series."""

    def step(self, x: float) -> tuple[float, ...]:
        return tuple(super().step(np.array([x]))[0].tolist())


def fourier_table(size: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases shared by all series (bandwidth 1); the seed is a fixed value that the features are defined by."""
    rng = np.random.default_rng(20260720 + 1_000_003 * dim + size)
    return rng.normal(0.0, 1.0, size=(dim, size)), rng.uniform(0.0, 2.0 * math.pi, size=size)


class KernelDistances:
    """Distances of exponentially weighted random Fourier features to their history means, for many series: of values, and of neighbours in pairs.

    A series without a history has a mean of zero.
    """

    NAMES = tuple(f"mmd_{s}_{k}" for s in ("marginal", "joint") for k in ("vfast", "fast", "slow", "newma"))
    RATES = np.array([[0.08], [0.02], [0.005]])

    def __init__(self, histories: list[np.ndarray], size: int = 64, warm: int = 5):
        self.one, self.two = fourier_table(size, 1), fourier_table(size, 2)
        self.scale, self.warm, self.t, self.last = math.sqrt(2 / size), warm, 0, None
        mean = lambda x, table: self.features(x, table).mean(0) if len(x) else np.zeros(size)
        self.homes = np.array([[mean(h[:, None], self.one), mean(np.stack((h[1:], h[:-1]), 1), self.two)] for h in histories])
        self.now = np.repeat(self.homes[:, :, None], 3, 2)

    def features(self, x: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return self.scale * np.cos(x @ table[0] + table[1])

    def step(self, x: np.ndarray) -> np.ndarray:
        self.t += 1
        x = np.asarray(x, float)
        self.now[:, 0] += self.RATES * (self.features(x[:, None], self.one)[:, None] - self.now[:, 0])
        if self.last is not None:
            self.now[:, 1] += self.RATES * (self.features(np.stack((x, self.last), 1), self.two)[:, None] - self.now[:, 1])
        self.last = x
        if self.t < self.warm:
            return np.full((len(x), 8), math.nan)
        away = np.sqrt(((self.now - self.homes[:, :, None]) ** 2).sum(3))
        drift = np.sqrt(((self.now[:, :, 1] - self.now[:, :, 2]) ** 2).sum(2))
        return np.concatenate((away, drift[:, :, None]), 2).reshape(len(x), 8)


class KernelDistance(KernelDistances):
    """Kernel distances of one series."""

    def __init__(self, history: np.ndarray, size: int = 64, warm: int = 5):
        super().__init__([np.asarray(history, float)], size, warm)

    home = property(lambda self: self.homes[0])

    def step(self, x: float) -> tuple[float, ...]:
        return tuple(super().step(np.array([x]))[0].tolist())


#: block -> (columns, maker from the series' histories); a block's step takes a value a series and returns a row a series.
BLOCKS: dict[str, tuple[tuple[str, ...], Callable[[list[np.ndarray]], object]]] = {
    "bayes_filter": (BayesFilter.NAMES, lambda histories: BayesFilter(len(histories))),
    "bocpd": (RunLengths.NAMES, lambda histories: RunLengths(len(histories))),
    "mmd": (KernelDistances.NAMES, KernelDistances),
}


RESIDUALS = "select id, 1 as period, cast(t as int) as t, e from ehist union all select id, 2 as period, cast(t as int) as t, e from inn"


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, period (1 history, 2 online), t, e of every series."""
    return stored.run(spark, sf_dir, RESIDUALS)


def _together(d: pd.DataFrame) -> tuple[list[pd.DataFrame], list[np.ndarray], np.ndarray]:
    """(online rows, history) of each series, and their online values as a matrix with a row a series, zero behind its end."""
    d = d[np.isfinite(d["e"].to_numpy(np.float64))].sort_values(["id", "period", "t"], kind="stable")
    online, histories = [], []
    for _, g in d.groupby("id", sort=False):
        if (g["period"] == 2).any():
            online.append(g[g["period"] == 2])
            histories.append(g.loc[g["period"] == 1, "e"].to_numpy(np.float64))
    x = np.zeros((len(online), max((len(g) for g in online), default=0)))
    for i, g in enumerate(online):
        x[i, : len(g)] = g["e"]
    return online, histories, x


def run_block(rows: DataFrame, block: str, together: int = 128) -> DataFrame:
    """rows(id, period, t, e) -> id, t and the block's features of every online step.

    About `together` series are stepped side by side, as rows of one matrix; each is of
    bounded length.  Null or non-finite values neither move the state nor get a
    row; a series without history has an empty one.
    """
    names, make = BLOCKS[block]

    def series(d: pd.DataFrame) -> pd.DataFrame:
        online, histories, x = _together(d)
        if not online:
            return pd.DataFrame(columns=["id", "t", *names])
        state = make(histories)
        out = np.stack([state.step(x[:, k]) for k in range(x.shape[1])], 1)
        keys = pd.concat([g[["id", "t"]] for g in online], ignore_index=True)
        return pd.concat([keys, pd.DataFrame(np.concatenate([out[i, : len(g)] for i, g in enumerate(online)]), columns=list(names))], axis=1)

    schema = "id long, t int, " + ", ".join(f"{n} double" for n in names)
    return _dealt(rows, together).groupBy("part").applyInPandas(series, schema)


def _dealt(rows: DataFrame, together: int) -> DataFrame:
    n = rows.agg(F.approx_count_distinct("id")).first()[0]
    return rows.select("id", "period", "t", "e", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // together)))).alias("part"))


def calibrate_mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel distances against each series' own history: the same steps over the history, less the start, give mean and spread."""
    names = KernelDistances.NAMES
    least = np.array([int(1 / next((r for k, r in (("vfast", 0.08), ("fast", 0.02)) if n.endswith(f"_{k}")), 0.005)) for n in names])

    def series(d: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, history, x in zip(*_together(d)):
            past, state = KernelDistances([history]), KernelDistances([history])
            null = np.concatenate([past.step(np.array([v])) for v in history]) if len(history) else np.zeros((0, 8))
            raw = np.concatenate([state.step(x[k : k + 1]) for k in range(len(g))])
            cal = np.full_like(raw, np.nan)
            for k, m in enumerate(least):
                own = null[m:, k][np.isfinite(null[m:, k])]
                if len(own) >= 8 and len(history) >= 64:
                    cal[m - 1 :, k] = (raw[m - 1 :, k] - own.mean()) / max(own.std(ddof=1), 1e-6)
            out.append(pd.concat([g[["id", "t"]].reset_index(drop=True), pd.DataFrame(np.round(cal, 6), columns=[f"{n}_cal" for n in names])], axis=1))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "t", *(f"{n}_cal" for n in names)])

    schema = "id long, t int, " + ", ".join(f"{n}_cal double" for n in names)
    return _dealt(residuals(spark, sf_dir), 32).groupBy("part").applyInPandas(series, schema)


def _query(block: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_block(residuals(spark, sf_dir), block)

    run.__name__ = block
    return run


QUERIES = {block: _query(block) for block in BLOCKS}
