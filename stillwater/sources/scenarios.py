"""Behavioural scenarios: series with a known change (or none), drawn per seed inside the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

HISTORY = 2000

#: Fixed values. name -> (online length, first changed step or None, effect)
SCENARIOS = {
    "t1": (600, 3, "mean +0.8"), "t2": (600, 595, "mean +0.8"), "t3": (800, 200, "mean +0.15"), "t4": (600, 200, "mean +1.5"),
    "t5": (600, 200, "sd x1.5"), "t5b": (600, 200, "sd ramp"), "t6": (1000, None, "garch"), "t7": (600, 200, "ar"), "t8": (600, 200, "heavy tail"),
    "t9": (1000, None, "outliers"), "t10": (1000, None, "sine"), "t11": (10, 5, "mean +1.0"), "t12": (1000, None, "tiny"), "t12b": (1000, None, "alternation"), "t13": (600, None, "transient"),
}


def _ar(rng: np.random.RandomState, phi: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Autoregression from zero whose coefficient and innovations' spread may change."""
    noise, out, last = rng.standard_normal(len(phi)), np.zeros(len(phi)), 0.0
    for i, (p, s) in enumerate(zip(phi, spread)):
        out[i] = last = p * last + s * noise[i]
    return out


def _garch(rng: np.random.RandomState, n: int, base: float = 0.05, news: float = 0.10, keep: float = 0.85, burn: int = 200) -> np.ndarray:
    noise, out, var, last = rng.standard_normal(burn + n), np.zeros(burn + n), base / (1 - news - keep), 0.0
    for i in range(burn + n):
        if i:
            var = base + news * last * last + keep * var
        out[i] = last = np.sqrt(var) * noise[i]
    return out[burn:]


def reference_panel(name: str, seed: int) -> tuple[np.ndarray, np.ndarray, None]:
    """Independent normal history and online part of the scenario's length: what the relative gates compare with."""
    rng = np.random.RandomState(seed)
    return rng.standard_normal(HISTORY), rng.standard_normal(SCENARIOS[name][0]), None


def generate(name: str, seed: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(history, online, first changed step from 1, or None).

    The suffix `_ctrl` gives the twin without the change; a scenario that has
    none (t6, t9, t10, t12, t12b, t13) is its own twin.  `_ref` gives the
    reference panel.  Effects follow their definitions; the order of random draws is our own.
    """
    if name.endswith("_ref"):
        return reference_panel(name.removesuffix("_ref"), seed)
    control, name = name.endswith("_ctrl"), name.removesuffix("_ctrl")
    n, tau, effect = SCENARIOS[name]
    rng, t = np.random.RandomState(seed), np.arange(1, n + 1)
    after = np.zeros(n, bool) if control or tau is None else t >= tau
    if effect == "garch":
        return _garch(rng, HISTORY), _garch(rng, n), None
    if effect == "ar":  # innovations of 1 before; after, what leaves the variance as it was
        phi, late = np.concatenate((np.full(HISTORY, 0.2), np.where(after, 0.6, 0.2))), np.concatenate((np.zeros(HISTORY, bool), after))
        x = _ar(rng, phi, np.where(late, np.sqrt((1 - 0.6**2) / (1 - 0.2**2)), 1.0))
        return x[:HISTORY], x[HISTORY:], None if control else tau
    history, x = rng.standard_normal(HISTORY), rng.standard_normal(n)
    if effect == "sine":  # the phase begins anew online
        return np.sin(2 * np.pi * np.arange(HISTORY) / 50) + 0.5 * history, np.sin(2 * np.pi * (t - 1) / 50) + 0.5 * x, None
    if effect.startswith("mean"):
        x = x + float(effect.split("+")[1]) * after
    elif effect == "sd x1.5":
        x = np.where(after, 1.5 * x, x)
    elif effect == "sd ramp":
        x = np.where(after, x * (1 + 0.5 * np.clip((t - tau) / 200, 0, 1)), x)
    elif effect == "heavy tail":
        x = np.where(after, rng.standard_t(4, n) / np.sqrt(2), x)
    elif effect == "outliers":
        x[[49, 179, 419, 699]] = 6.0 * rng.choice([-1.0, 1.0], 4)
    elif effect == "tiny":
        history, x = history * 1e-6, x * 1e-6
    elif effect == "alternation":
        history, x = 10.0 * (1 - 2 * (np.arange(HISTORY) % 2)) + 0.1 * history, 10.0 * (1 - 2 * (np.arange(n) % 2)) + 0.1 * x
    elif effect == "transient":
        x = x + ((t >= 200) & (t <= 260))
    return history, x, None if control else tau


def scenario_panel(spark: SparkSession, names: list[str], seeds: int) -> DataFrame:
    """scenario, seed, period (1 history, 2 online), t from 1, x, tau (null: no change); drawn where the rows live."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                name, seed = names[k // seeds], int(k % seeds)
                history, online, tau = generate(name, seed)
                sizes = [len(history), len(online)]
                yield pd.DataFrame({"scenario": name, "seed": seed, "period": np.repeat([1, 2], sizes), "t": np.concatenate([np.arange(1, s + 1) for s in sizes]), "x": np.concatenate((history, online)), "tau": pd.array([tau] * sum(sizes), "Int32")})

    return spark.range(len(names) * seeds).mapInPandas(draw, "scenario string, seed long, period int, t int, x double, tau int")
