"""Structured Streaming: the same step classes as in batch, kept as the state of each series."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState

from stillwater.operators.recursive import BLOCKS, SingleChange
from stillwater.sources import panels, stored


def stream_block(rows: DataFrame, block: str) -> DataFrame:
    """A stream of online rows (id, t, e) -> id, t and the block's features, appended as steps arrive.

    Steps of a series are taken in the order of t within a micro-batch; a step
    at or before the last one seen is ignored, so a replayed batch changes
    nothing.  Null or non-finite values give no row.  Blocks that need a history start
    from an empty one and belong in batch.
    """
    names, make = BLOCKS[block]

    def steps(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, own = state.get if state.exists else (0, None)
        own = pickle.loads(own) if own else make([np.zeros(0)])
        d = pd.concat(list(parts)).sort_values("t", kind="stable").drop_duplicates("t")
        d = d[(d["t"] > last) & np.isfinite(d["e"].to_numpy(np.float64))]
        if len(d):
            out = pd.DataFrame(np.concatenate([own.step(np.array([x])) for x in d["e"]]), columns=list(names))
            state.update((int(d["t"].iloc[-1]), pickle.dumps(own)))
            yield pd.concat([d[["id", "t"]].reset_index(drop=True), out], axis=1)[["id", "t", *names]]

    schema = "id long, t int, " + ", ".join(f"{n} double" for n in names)
    return rows.select("id", "t", "e").groupBy("id").applyInPandasWithState(steps, schema, "last int, own binary", "append", "NoTimeout")


class SeriesScorer:
    """The full closed-form score of one series, a step at a time, from its frozen history fit.

    fit: c, phi (lags 1, 2, ...), season (or None), phi_season, sigma_e, qa95, qa99,
    rho1_abs_e, sigma_u, lags (the history's last values, oldest first), e (its
    standardised residuals).
    """

    BETS = np.array([0.05, 0.1, 0.2, 0.4])

    def __init__(self, fit: dict):
        self.fit, self.lags = fit, [float(x) for x in fit["lags"]]
        self.past = np.sort(np.abs(np.asarray(fit["e"], float)))
        self.change, self.v, self.before = SingleChange(0.0025), 1.0, None
        self.cusums, self.logs = np.zeros(15), np.zeros(4)

    def step(self, x: float) -> float:
        f, lags = self.fit, self.lags
        guess = f["c"] + sum(p * lags[-k] for k, p in enumerate(f["phi"], 1))
        if f["season"]:
            guess += f["phi_season"] * lags[-int(f["season"])]
        self.lags = [*lags[1:], x]
        raw = (x - guess) / f["sigma_e"]
        e = min(max(raw, -8.0), 8.0)
        self.v = 0.94 * self.v + 0.06 * e * e
        vol = e / math.sqrt(max(self.v, 1e-12)) if f["rho1_abs_e"] > 0.15 else e
        self.cusums = np.maximum(0, self.cusums + self._gains(raw, e, vol))
        n = len(self.past)
        middle = (np.searchsorted(self.past, abs(raw), "left") + np.searchsorted(self.past, abs(raw), "right")) / 2
        self.logs = np.maximum(0, self.logs + np.log(self.BETS) + (self.BETS - 1) * math.log((n - middle + 0.5) / (n + 1)))
        top = self.logs.max()
        bets = top + math.log(np.exp(self.logs - top).mean())
        odds = self.change.step(e)[0]
        self.before = vol
        return 1 / (1 + math.exp(-(0.9 * odds + 0.4 * math.sqrt(2 * self.cusums.max()) + 0.3 * bets)))

    def _gains(self, raw: float, e: float, vol: float) -> np.ndarray:
        """What each reflected sum gains: shifts of the mean and variance, exceedances, signs, dependence on the step before."""
        f, out = self.fit, []
        for k in (0.25, 0.5, 1.0):
            out += [k * vol - k * k / 2, -k * vol - k * k / 2]
        out += [0.5 * ((1 - 1 / r) * e * e - math.log(r)) for r in (1.5, 2.5, 0.5)]
        for q, p0, p1 in (("qa95", 0.05, 0.15), ("qa99", 0.01, 0.05)):
            out.append(math.log(p1 / p0) if abs(raw) > f[q] else math.log((1 - p1) / (1 - p0)))
        for p1 in (0.65, 0.35):
            out.append(math.log(p1 / 0.5) if vol > 0 else math.log((1 - p1) / 0.5))
        near = None if self.before is None else vol * self.before / f["sigma_u"]
        return np.array([*out, *([0.0, 0.0] if near is None else [0.3 * near - 0.045, -0.3 * near - 0.045])])


_FIT = ["c", "season", "phi_season", "sigma_e", "qa95", "qa99", "rho1_abs_e", "sigma_u"]


def history_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and the frozen fit of each series, as SeriesScorer takes it: one row a series, its history as arrays."""
    body = f"select h.id, {', '.join(_FIT)}, array({', '.join(f'phi{k}' for k in panels.LAGS)}) as phi, lags, e from h0 h join es on h.id = es.id join ls on h.id = ls.id"
    more = (
        "es as (select id, transform(array_sort(collect_list(struct(t, e))), s -> s.e) as e from ehist group by id), "
        f"ls as (select p.id, transform(array_sort(collect_list(struct(tt, x))), s -> s.x) as lags from panel p join h0 q on p.id = q.id where period = 1 and tt > n_h - greatest({panels.ORDER}, coalesce(season, 0)) group by p.id)"
    )
    return stored.run(spark, sf_dir, body, more)


def stream_scores(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """A stream of online values (id, t from 1, x) -> id, t, score, appended as steps can be taken.

    Steps are taken in the order of t without a gap: a step that comes early waits
    in the state, one that was taken already is ignored.  A null or non-finite value is an
    error, since whitening needs every value.  A series without a fit gives no row.
    """

    def steps(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (0, None)
        d = pd.concat(list(parts)).drop_duplicates("t")
        if not np.isfinite(d["x"].to_numpy(float)).all():
            raise ValueError(f"series {key[0]} has a value that is no number")
        if held:
            own, waiting = pickle.loads(held)
        else:
            first = d.iloc[0]
            fit = {k: first[k] for k in (*_FIT, "phi", "lags", "e")}
            own, waiting = SeriesScorer(fit | {"season": None if pd.isna(fit["season"]) else int(fit["season"])}), {}
        waiting |= {int(t): float(x) for t, x in zip(d["t"], d["x"]) if t > last}
        out = []
        while last + 1 in waiting:
            last += 1
            out.append((key[0], last, round(own.step(waiting.pop(last)), 6)))
        state.update((last, pickle.dumps((own, waiting))))
        yield pd.DataFrame(out, columns=["id", "t", "score"])

    return rows.select("id", "t", "x").join(fits, "id").groupBy("id").applyInPandasWithState(steps, "id long, t int, score double", "last int, own binary", "append", "NoTimeout")
