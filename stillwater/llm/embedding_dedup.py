"""Embedding near-dedup by counting collisions of one-dimensional projections.

Unit vectors are projected on many random directions and each projection is
sorted.  Around every query vector a window of fixed half-width is laid on each
projection, and a pair's collisions are counted over the projections.  Pairs at
the cosine threshold differ by a known spread, so the count that a chosen share
of them passes (binomial) is the calibrated threshold; pairs that pass are
verified by their cosine in double precision.

Groups (label and dimension) that are too large for a task are halved at the
median of a routing projection, again and again, both halves holding the vectors
near the median: a pair that differs by at most the overlap meets in one half at
least.  A cell that is still large (a dense cluster) is worked off in pairs of
blocks.  Equal vectors are one class throughout, and a cell gives per vector a
sum of links and a spanning forest, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, table, written

ROUTES = 16


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings each one's largest component to 0.5 up to 1: exact, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, count))


def calibrated_count(cosine: float, half_width: float, projections: int, recall: float) -> int:
    """The largest count that a pair at `cosine` reaches with probability `recall` at least."""
    p = math.erf(half_width / (math.sqrt(2 - 2 * cosine) * math.sqrt(2)))
    tail = 0.0
    for t in range(projections, -1, -1):
        tail += math.comb(projections, t) * p**t * (1 - p) ** (projections - t)
        if tail >= recall:
            return t
    return 0


def collisions(sorted_by: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, values: np.ndarray, half_width: float, n: int) -> np.ndarray:
    """How often each of n rows lies in each query's window: (queries, n).  values: the queries' projections."""
    out = np.zeros(len(queries) * n, np.int32)
    for k, (order, line) in enumerate(sorted_by):
        lo, hi = np.searchsorted(line, values[:, k] - half_width), np.searchsorted(line, values[:, k] + half_width, "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out += np.bincount(np.repeat(np.arange(len(queries)) * n, size) + order[at], minlength=len(out)).astype(np.int32)
    return out.reshape(len(queries), n)


def linked_pairs(x: np.ndarray, cosine: float, projections: int, half_width: float, recall: float, seed: int, side: np.ndarray | None = None):
    """Chunks of (i, j), i < j, whose rows have the cosine at least; with `side`, only pairs of unlike sides."""
    x = scaled(x)
    norm = np.sqrt((x * x).sum(1))
    unit = x / norm[:, None]
    p = unit @ directions(x.shape[1], projections, seed)
    lines = [(o := np.argsort(p[:, k], kind="stable"), p[o, k]) for k in range(projections)]
    least, n = calibrated_count(cosine, half_width, projections, recall), len(x)
    step = max(1, min(256, (1 << 20) // n))
    for a in range(0, n, step):
        q = np.arange(a, min(n, a + step))
        i, j = np.nonzero(collisions(lines, q, p[q], half_width, n) >= least)
        i = q[i]
        keep = i < j
        if side is not None:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        for b in range(0, len(i), 1 << 16):
            s, t = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
            good = np.einsum("ij,ij->i", x[s], x[t]) / (norm[s] * norm[t]) >= cosine
            yield s[good], t[good]


def near_vectors(vectors: DataFrame, cosine: float = 0.98, projections: int = 40, half_width: float = 0.2, recall: float = 0.999, cell: int = 2500, block: int = 8000, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link only with equal, non-null labels and equal dimensions.  Null,
    empty or zero vectors, and vectors with null or non-finite components, link
    with nothing and are their own component.  Rows that repeat are vectors of
    their own (a repeated id counts as another vector); a vector with a null id
    takes part in no link and has a null component.  Other columns are ignored.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("e"))
    fine = F.size("e") > 0
    fine &= F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    good = v.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()).where(fine)
    classes = written(good.groupBy("label", "e").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")

    def route(e: pd.Series) -> pd.Series:
        out = []
        for x in e:
            x = scaled(np.asarray(x, np.float64))
            r = directions(len(x), ROUTES, seed + 1)
            out.append(x / math.sqrt(x @ x) @ (r / np.sqrt((r * r).sum(0))))
        return pd.Series(out)

    routed = classes.withColumn("dim", F.size("e")).withColumn("p", F.pandas_udf(route, "array<double>")("e"))
    sizes = routed.groupBy("label", "dim").agg(F.count("*").alias("n"), *[F.percentile_approx(F.col("p")[k], 0.5, 1000).alias(f"q{k}") for k in range(ROUTES)])
    levels = F.least(F.lit(ROUTES), F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / cell) / math.log(1 / 0.62)).cast("int")))
    sizes = sizes.select("label", "dim", levels.alias("levels"), F.array(*[f"q{k}" for k in range(ROUTES)]).alias("q"))
    routed = routed.join(sizes, ["label", "dim"])
    # half the overlap is 1.5 spreads of a pair at the threshold
    half = F.lit(1.5 * math.sqrt(2 - 2 * cosine)) / F.sqrt("dim")
    low = lambda k: F.col("p")[k] <= F.col("q")[k] + half
    high = lambda k: F.col("p")[k] >= F.col("q")[k] - half
    steps = F.when(F.col("levels") > 0, F.sequence(F.lit(0), F.col("levels") - 1)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<bigint>")
    cells = F.aggregate(steps, F.array(F.lit(0).cast("long")), lambda acc, k: F.concat(F.when(low(k), F.transform(acc, lambda c: c * 2)).otherwise(none), F.when(high(k), F.transform(acc, lambda c: c * 2 + 1)).otherwise(none)))
    dual = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, k: acc * 2 + (low(k) & high(k)).cast("long"))
    placed = written(routed.select("label", "dim", "rep", "m", "e", dual.alias("dual"), F.explode(cells).alias("cell")), "cells")
    parts = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    placed = placed.join(parts, ["label", "dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumn("pair", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))

    def links(d: pd.DataFrame) -> pd.DataFrame:
        x = np.array(d["e"].tolist(), np.float64)
        own, rep, m, dual, at = (d[c].to_numpy() for c in ("own", "rep", "m", "dual", "cell"))
        side = own if own.min() != own.max() else None
        if side is None and (d["other"] != d["own"]).any():
            return pd.DataFrame({"a": [], "b": [], "n": []})
        n, root, edges = np.zeros(len(d), np.int64), np.arange(len(d)), []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in linked_pairs(x, cosine, projections, half_width, recall, seed, side):
            once = (dual[i] & dual[j] & at[i]) == 0  # a pair that meets in many cells counts in one
            np.add.at(n, i[once], m[j[once]])
            np.add.at(n, j[once], m[i[once]])
            for s, t in zip(i.tolist(), j.tolist()):
                if (u := find(s)) != (w := find(t)):
                    root[u] = w
                    edges.append((s, t))
        some = np.flatnonzero(n)
        s, t = np.array(edges, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": np.concatenate((rep[some], rep[s])), "b": np.concatenate((np.full(len(some), -1), rep[t])), "n": np.concatenate((n[some], np.zeros(len(s), np.int64)))}).astype({"b": "Int64"}).assign(edge=lambda f: np.arange(len(f)) >= len(some))

    def safe(d: pd.DataFrame) -> pd.DataFrame:
        out = links(d)
        return out if "edge" in out else pd.DataFrame({"a": [], "b": [], "n": [], "edge": []}).astype({"a": "int64", "b": "Int64", "n": "int64", "edge": bool})

    found = written(placed.groupBy("label", "dim", "cell", "pair").applyInPandas(safe, "a long, b long, n long, edge boolean"), "links")
    sums = found.where("not edge").groupBy("a").agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("edge").select("a", "b"))
    known = classes.join(sums, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("label").alias("l2"), F.col("e").alias("e2"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = good.select("id", "label", "e").join(known, (F.col("label") == F.col("l2")) & (F.col("e") == F.col("e2"))).select("id", "n_links", F.col("c").alias("component_id"))
    poor = v.where(~F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & fine, F.lit(False)))
    out = out.unionByName(poor.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
