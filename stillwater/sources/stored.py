"""The panel's relations as tables of the session: computed once, bucketed by series and sorted, read by every query.

A table lies in the folder that all executors share and is found again by the
input's files (path, length, time), so a changed input is read anew.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.functions.kernels import LONGEST
from stillwater.sources import panels

_TABLES: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  A local one is made only where the session names none and driver and executors are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="stillwater-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(spark: SparkSession, path: str) -> tuple:
    """(path, bytes, latest change) of an input, as its file system tells them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    files = fs.listFiles(where, True)
    size, latest = 0, 0
    while files.hasNext():
        f = files.next()
        size, latest = size + f.getLen(), max(latest, f.getModificationTime())
    return path, size, latest


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation of panels.STORED as a table, computed on its first use in the session."""
    at = panels.STORED.index(name)
    return kept(spark, sf_dir, name, lambda: run(spark, sf_dir, f"select * from {name}", have=panels.STORED[:at]))


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make() as a table called `name`, computed on its first use in the session, bucketed and sorted by series."""
    key = (spark.sparkContext.applicationId, name, *_stamp(spark, f"{sf_dir}/lineitem.parquet"))
    if key not in _TABLES:
        made = make()
        table, by = f"stillwater_{name}_{uuid.uuid4().hex[:12]}", [c for c in ("tt", "t") if c in made.columns][:1]
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        made = made.repartition(buckets, "id").sortWithinPartitions("id", *by)
        made.write.bucketBy(buckets, "id").sortBy("id", *by).option("path", f"{shared_dir(spark)}/tables/{table}").saveAsTable(table)
        if name == "panel":
            check(spark.table(table))
        _TABLES[key] = table
    return spark.table(_TABLES[key])


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings for the statements that run inside; the session's own come back."""
    own = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def check(panel: DataFrame) -> None:
    """Raise where a series' history is too short to fit, or its online part too long for the running sums."""
    sizes = panel.groupBy("id").pivot("period", [1, 2]).count()
    short, longest = sizes.selectExpr("count_if(coalesce(`1`, 0) < {})".format(panels.LEAST_HISTORY), "coalesce(max(`2`), 0)").first()
    if short:
        raise ValueError(f"{short} series have a history of fewer than {panels.LEAST_HISTORY} points")
    if longest > LONGEST:
        raise ValueError(f"a series has {longest} online steps; {LONGEST} are the most")


def _resolved(spark: SparkSession, body: str, more: str, frames: dict[str, DataFrame]) -> DataFrame:
    """A statement over the panel's relations, those in `frames` given; each other one becomes a frame of its own, so the analyzer sees one at a time."""
    stop = (*frames, *panels.SOLVED, *panels.BY_SERIES)
    names, sources = panels.needed(f"{more} {body}", stop), {name: f"{name}_gram" for name in panels.SOLVED} | panels.BY_SERIES
    todo = [n for n in names if n in sources and n not in frames]
    while todo:
        more_names = [n for n in panels.needed(f"select * from {sources[todo.pop()]}", stop) if n not in names]
        names, todo = [*names, *more_names], [*todo, *(n for n in more_names if n in sources and n not in frames)]
    own = dict(frames)
    for name in sorted(set(names), key=list(panels.RELATIONS).index):
        if name == "season" and name not in own:
            own[name] = seasons(own["resid0"])
        if name in panels.SOLVED and name not in own:
            own[name] = solved(own[f"{name}_gram"], panels.SOLVED[name])
        if name not in own:
            sql = panels.RELATIONS[name].replace("{pct}", "percentile")
            reads = panels.used(sql)
            sql = re.sub(r"(from|join) (\w+)", lambda m: f"{m[1]} {{{m[2]}}} {m[2]}_r" if m[2] in reads and not _named(sql, m.end()) else f"{m[1]} {{{m[2]}}}" if m[2] in reads or m[2] == "lineitem" else m[0], sql)  # noqa: B023
            used = {n: own[n] for n in reads}
            own[name] = spark.sql(sql, **used, **({"lineitem": frames["lineitem"]} if "{lineitem}" in sql else {}))
    direct = panels.used(f"{more} {body}")
    views = [f"{n} as (select * from {{{n}}})" for n in names if n in direct]
    sql = ("with " if views or more else "") + ", ".join([*views, *([more] if more else [])]) + "\n" + body
    return spark.sql(sql.replace("{pct}", "percentile"), **{n: own[n] for n in names if n in direct})


def seasons(resid: DataFrame) -> DataFrame:
    """id, season of the series that have one: the lag whose autocorrelation is furthest from zero, the first of equals.

    One row a series, its residuals as an array (a history is of bounded length);
    series of one length are correlated together.
    """
    low, high = panels.SEASONS
    lists = resid.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tt", "r"))), lambda s: s["r"]).alias("r")).where(F.size("r") > high + 10)

    def find(batches):
        for b in batches:
            ids, values = b.column("id").to_numpy(), b.column("r")
            sizes = np.diff(np.asarray(values.offsets))
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = np.stack([values[int(i)].values.to_numpy(zero_copy_only=False) for i in at])
                x = x - x.mean(1, keepdims=True)
                power = (x * x).sum(1)
                rho = np.stack([(x[:, k:] * x[:, :-k]).sum(1) for k in range(low, high + 1)], 1) / np.where(power > 0, power, np.inf)[:, None]
                best = np.abs(rho).argmax(1)
                has = np.abs(rho)[np.arange(len(at)), best] > panels.SEASONAL_ACF
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[has]]), pa.array((best[has] + low).astype(np.int32))], names=["id", "season"])

    return lists.mapInArrow(find, "id long, season int")


def solved(gram: DataFrame, columns: list[str]) -> DataFrame:
    """id, n, intercept, rss, b_<column>...: least squares with an intercept from each series' sums, one small system a row.

    A column that the ones before it explain gets the coefficient zero.
    """
    p = len(columns)

    def solve(batches):
        for b in batches:
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            n, m = get("n"), np.stack([get(f"s_{c}") for c in columns] + [get("s_y")], 1)
            c = np.empty((b.num_rows, p + 1, p + 1))
            for i, x in enumerate(columns):
                for j, z in enumerate(columns[i:], i):
                    c[:, i, j] = c[:, j, i] = get(f"s_{x}_{z}")
                c[:, i, p] = c[:, p, i] = get(f"s_{x}_y")
            c[:, p, p] = get("s_y_y")
            c -= m[:, :, None] * m[:, None, :] / n[:, None, None]
            coef = np.zeros((b.num_rows, p))
            left = np.zeros((b.num_rows, p + 1, p))
            for k in range(p):  # Cholesky's factor, a column a step, for all rows of the batch
                v = c[:, :, k] - np.einsum("rij,rj->ri", left[:, :, :k], left[:, k, :k])
                fine = v[:, k] > 1e-10 * c[:, k, k]
                left[:, k:, k] = np.where(fine, 1 / np.sqrt(np.where(fine, v[:, k], 1)), 0)[:, None] * v[:, k:]
            for k in reversed(range(p)):
                d = left[:, k, k]
                coef[:, k] = np.where(d > 0, (left[:, p, k] - (left[:, k + 1 : p, k] * coef[:, k + 1 :]).sum(1)) / np.where(d > 0, d, 1), 0)
            mean, mid = m / n[:, None], get("mid")
            intercept = mid + mean[:, p] - (coef * (mid[:, None] + mean[:, :p])).sum(1)
            rss = np.maximum(c[:, p, p] - (left[:, p] ** 2).sum(1), 0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array(intercept), pa.array(rss), *(pa.array(coef[:, k]) for k in range(p))], names=["id", "n", "intercept", "rss", *(f"b_{x}" for x in columns)])

    return gram.mapInArrow(solve, "id long, n long, intercept double, rss double, " + ", ".join(f"b_{x} double" for x in columns))


def _named(sql: str, end: int) -> bool:
    """Whether a name follows the relation that ends at `end`."""
    return bool(re.match(r" (?!on\b|where\b|group\b|join\b|left\b|cross\b|order\b|having\b)\w+", sql[end:]))


class Panel:
    """Any panel(id, tt, period, x, tau_index), history first: its relations are written one after another as they are first used."""

    def __init__(self, panel: DataFrame):
        self.spark = panel.sparkSession
        self.where = f"{shared_dir(self.spark)}/panels/{uuid.uuid4().hex[:12]}"
        self.frames = {"panel": self._kept("panel", panel)}
        check(self.frames["panel"])

    def _kept(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.where}/{name}")
        return self.spark.read.parquet(f"{self.where}/{name}")

    def run(self, body: str, more: str = "") -> DataFrame:
        """A statement over the panel's relations."""
        for name in panels.needed(f"{more} {body}", panels.STORED):
            if name in panels.STORED and name not in self.frames:
                for below in panels.STORED[: panels.STORED.index(name) + 1]:
                    if below not in self.frames:
                        self.frames[below] = self._kept(below, _resolved(self.spark, f"select * from {below}", "", self.frames))
        return _resolved(self.spark, body, more, self.frames)


def run(spark: SparkSession, sf_dir: str, body: str, more: str = "", have: tuple[str, ...] = panels.STORED) -> DataFrame:
    """A statement over the panel's relations; those in `have` are read as tables."""
    names = panels.needed(f"{more} {body}", have)
    frames = {n: relation(spark, sf_dir, n) for n in names if n in have}
    if "panel0" in names:
        frames["lineitem"] = source(spark, sf_dir, "lineitem")
    return _resolved(spark, body, more, frames)
