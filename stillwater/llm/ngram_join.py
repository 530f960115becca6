"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word n-grams (64-bit hashes).  Two sets whose
similarity is at least s differ in at most d = (1 - s) / (1 + s) * (|A| + |B|)
elements.  XOR-hashing elements into a sketch flips one cell per element, so the
number of unlike cells never exceeds the size of the symmetric difference, and

* per band of sizes, a sketch with more than d cells has cells that agree
  (pigeonhole).  The cells are the join keys; a document whose cells are empty
  too often to leave a full one to agree gives its empty cells as keys as well.
* a document with d + 1 + m full cells agrees in m + 1 of them at least, so it
  leaves out its m most frequent ones (by how many documents hold the cell, ties
  by key): of the cells that two documents agree in, the rarest stays in both.
  A passage that many documents share fills frequent cells and makes no pair.
* a one-bit sketch of 1,024 cells refuses pairs whose Hamming distance passes d.

Pairs that are left are verified by their sets.  Documents with equal sets are
one class and only meet through one of them.  A key gives a star (its smallest
document with each other), not all pairs; what the verified stars do not join is
then compared across components only, so no link is lost and a group of n near
copies costs about n comparisons per key.  Two documents that share many keys are
made a pair at one of them: each carries its first key under several random
orders, and where the first keys of both agree under one, that key alone pairs
them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, forget, table, written
from .wordhash import mix, slices, word_hashes

WORDS_OF_SKETCH = 16
ORDERS = 8  # random orders of keys under which a document's first key is kept
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each text end to end, offsets).  Fewer than n words make one element; none, no element."""
    h, first = word_hashes(texts)
    count = np.diff(first)
    total = max(0, len(h) - n + 1)
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        acc += mix(h[k : k + total] * _ODD[k % 5] + np.uint64(k)) * _ODD[(k + 1) % 5]
    acc = mix(acc)
    parts = []
    for i in np.arange(len(count)):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            parts.append(np.unique(acc[a : b - n + 1]))
        elif b > a:
            parts.append(mix(np.array([np.bitwise_xor.reduce(mix(h[a:b] + np.arange(1, b - a + 1, dtype=np.uint64) * _ODD[0])) + np.uint64(b - a)], np.uint64)))
        else:
            parts.append(np.zeros(0, np.uint64))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


class Bands:
    """Bands of set sizes by factors of 1/s.  Sets that can link are in one band or in neighbours, so band j's sketch serves bands j and j - 1."""

    def __init__(self, percent: int, spare: float = 0.25):
        self.percent, self.ratio, self.spare, self.cache = percent, 100 / percent, spare, {}
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, math.floor(self.edges[-1] * self.ratio) + 1))

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def cells(self, j: int) -> tuple[int, int]:
        """(largest difference d of two sets, cells) of band j: more cells than d, a share of d to leave out, and room for the empty ones of most sets."""
        if j not in self.cache:
            large = self.edges[j + 1] - 1
            small = self.edges[max(0, j - 1)]
            d = (100 - self.percent) * 2 * large // (100 + self.percent)
            p = d + 1 + math.ceil(self.spare * d)
            while p < 4 * d + 8 and p - d - 1 < (e := p * math.exp(-small / p)) + 2 * math.sqrt(e):
                p += 1
            self.cache[j] = (d, p)
        return self.cache[j]


def cell_keys(elements: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, int]]:
    """The join keys of one set, (cells, how many of them it may leave out): of its own band's sketch and of the next band's."""
    out, own = [], bands.band(len(elements))
    for j in (own, own + 1):
        d, p = bands.cells(j)
        cell = (mix(elements + np.uint64(j + 1)) % np.uint64(p)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        c = cell[order]
        at = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        value, c = np.bitwise_xor.reduceat(elements[order], at), c[at]
        spare = len(c) - d - 1
        if spare < 0:  # all agreeing cells may be empty ones
            full = np.zeros(p, np.uint64)
            full[c] = value
            value, c, spare = full, np.arange(p), 0
        out.append((mix(value + mix(c.astype(np.uint64) * np.uint64(0x10001) + np.uint64(j))), spare))
    return out


def bit_sketch(elements: np.ndarray) -> np.ndarray:
    bits = 64 * WORDS_OF_SKETCH
    odd = np.bincount((mix(elements ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _each_set(docs: DataFrame, n: int, make, schema: str) -> DataFrame:
    """Run make(ids, elements, offsets, seen) over slices of (id, t); seen lives as long as the task."""

    def over(batches):
        seen: set = set()
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for a, z in slices(texts):
                el, off = shingle_sets(texts.slice(a, z - a), n)
                yield from make(ids.slice(a, z - a).to_pylist(), el, off, seen)

    return docs.mapInArrow(over, schema)


_PROFILE = "id long, n long, sig1 long, sig2 long, " + ", ".join(f"w{k} long" for k in range(WORDS_OF_SKETCH))


def _signature(x: np.ndarray) -> tuple[int, int]:
    m = mix(x ^ np.uint64(0xD1B54A32D192ED03))
    return int(np.bitwise_xor.reduce(m).view(np.int64)), int(m.sum(dtype=np.uint64).view(np.int64))


def profiles(docs: DataFrame, n: int) -> DataFrame:
    names = [f.split()[0] for f in _PROFILE.split(", ")]

    def make(ids, el, off, _):
        rows = []
        for i, d in enumerate(ids):
            x = el[off[i] : off[i + 1]]
            s = _signature(x) if len(x) else (0, 0)
            rows.append((d, len(x), *s, *bit_sketch(x).tolist()))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return _each_set(docs, n, make, _PROFILE)


def _keys(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """key, id, spare: the cells of each document, and twice how many of its band's cells it may leave out, plus 1 for the next band's."""
    bands = Bands(percent)

    def make(ids, el, off, seen):
        keys, own, spares = [], [], []
        for i, d in enumerate(ids):
            x = el[off[i] : off[i + 1]]
            if d is None or len(x) == 0:
                continue
            sig = (len(x), *_signature(x))
            if sig in seen:  # a copy of a set this task has given: their class joins them
                continue
            if len(seen) < 1 << 18:
                seen.add(sig)
            for side, (k, spare) in enumerate(cell_keys(x, bands)):
                keys.append(k)
                own.append(np.full(len(k), d, np.int64))
                spares.append(np.full(len(k), 2 * spare + side, np.int32))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(own)), pa.array(np.concatenate(spares))], names=["key", "id", "spare"])

    return _each_set(docs, n, make, "key long, id long, spare int")


def _sets(docs: DataFrame, ids: DataFrame, n: int, bits: int = 1 << 23) -> DataFrame:
    """id, s: the sets of the documents named by ids, and of a few others.

    The ids grow with the corpus, so what tasks get of them is a filter of `bits`
    bits, however many they are (1 MB): no text moves, and a document that passes
    by chance costs its set.  A full filter refuses nothing and loses nothing.
    """
    at = F.pmod(F.xxhash64("id"), F.lit(bits)).cast("int")
    held = ids.select(at.alias("b")).selectExpr("b div 64 as w", "shiftleft(1L, b % 64) as m").groupBy("w").agg(F.bit_or("m").alias("m")).collect()
    flags = np.zeros(bits // 64, np.uint64)
    flags[[r["w"] for r in held]] = np.array([r["m"] for r in held], np.int64).view(np.uint64)

    def over(batches):
        for b in batches:
            place = b.column(2).to_numpy(zero_copy_only=False)
            keep = flags[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)
            b = b.filter(pa.array(keep.astype(bool)))
            for x, y in slices(b.column(1)):
                el, off = shingle_sets(b.column(1).slice(x, y - x), n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array([el[off[i] : off[i + 1]].tobytes() for i in range(y - x)], pa.binary())], names=["id", "s"])

    return docs.where("id is not null").select("id", "t", at.alias("b")).mapInArrow(over, "id long, s binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def compare(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return with_a.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _near(a: str, b: str, percent: int) -> str:
    apart = " + ".join(f"bit_count({a}.w{k} ^ {b}.w{k})" for k in range(WORDS_OF_SKETCH))
    return f"{percent} * greatest({a}.n, {b}.n) <= 100 * least({a}.n, {b}.n) and {100 + percent} * ({apart}) <= {100 - percent} * ({a}.n + {b}.n)"


def similar_documents(docs: DataFrame, percent: int = 80, shingle: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Null, empty and blank texts have no shingles and link with nothing.  Rows
    that repeat an id are one document in the links (it links if one of them
    does) and get a row each.  A null id links with nothing and has a null
    component.  Other columns are ignored, whatever their names.
    """
    few = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    prof = written(profiles(few, shingle), "profiles")
    real = prof.where("id is not null and n > 0")
    classes = real.groupBy("n", "sig1", "sig2").agg(F.min("id").alias("a"))
    same = real.join(classes, ["n", "sig1", "sig2"]).where("a <> id").select("a", F.col("id").alias("b"))
    whole = "over (partition by key)"
    held = _keys(few, shingle, percent).selectExpr("key", "id", "spare", f"min(id) {whole} as lead", f"max(id) {whole} as last", f"count(*) {whole} as k").where("lead < last")
    # rows that repeat an id fall apart by `spare`, or leave out no more together than each may alone
    held = held.selectExpr("key", "id", "spare", "row_number() over (partition by id, spare order by k desc, key) as r").where("r > shiftright(spare, 1)").select("key", "id")
    held = held.selectExpr("key", "id", f"min(id) {whole} as lead", f"max(id) {whole} as last", f"count(*) {whole} as k").where("lead < last")
    held = written(held.select("key", "id", "lead", "k"), "buckets")
    stars = written(held.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "stars")

    def sifted(pairs: DataFrame) -> DataFrame:
        p = real.dropDuplicates(["id", "sig1", "sig2"])
        x = pairs.join(p.alias("x").withColumnRenamed("id", "a"), "a").selectExpr("b", "struct(*) as x")
        y = x.join(p.select(F.col("id").alias("b"), F.struct(*[c for c in p.columns if c != "id"]).alias("y")), "b")
        return y.where(_near("x", "y", percent)).selectExpr("x.a as a", "b", "x.sig1 = y.sig1 and x.sig2 = y.sig2 and x.n = y.n as equal").distinct()

    sieve = written(sifted(stars), "sieve")
    sets = written(_sets(few, held.select("id").distinct(), shingle), "sets")
    links = written(_verified(sieve.where("not equal").select("a", "b"), sets, percent), "links")
    edges = links.unionByName(same).unionByName(sieve.where("equal").select("a", "b"))
    comp = written(connected_components(edges), "components")
    # what the stars left apart inside a bucket; in a bucket of two the star was the only pair
    apart = held.where("k > 2").join(comp, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    apart = apart.selectExpr("*", f"min(c) {whole} as lo", f"max(c) {whole} as hi").where("lo < hi").drop("lo", "hi")
    apart = written(apart, "apart")
    forget(held)
    firsts = apart.groupBy("id").agg(*[F.min_by("key", F.xxhash64("key", F.lit(i))).alias(f"first{i}") for i in range(ORDERS)])
    small = real.dropDuplicates(["id", "sig1", "sig2"]).drop("sig1", "sig2")
    rest = written(apart.join(firsts.join(small, "id"), "id"), "apart")
    forget(apart)
    once = " ".join(f"when x.first{i} = y.first{i} then x.key = x.first{i}" for i in range(ORDERS))
    cross = rest.alias("x").join(rest.alias("y"), F.expr(f"x.key = y.key and x.id < y.id and x.c <> y.c and case {once} else true end and {_near('x', 'y', percent)}"))
    cross = cross.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    again = written(sifted(written(cross, "cross")), "sieve")
    if not again.isEmpty():
        more = written(_verified(again.where("not equal").select("a", "b"), sets, percent), "links")
        comp = connected_components(edges.unionByName(more).unionByName(again.where("equal").select("a", "b")))
    return prof.join(comp, prof.id == comp.node, "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op7_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
