"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that starts elsewhere as well.

1. Each window of `length` bytes has an anchor, its smallest hashed 64-byte
   string (the first of equals).  Equal windows have equal anchors at equal
   places, so only anchors whose hash occurs twice in the corpus matter.
2. An occurrence's context is the text that its windows span.  Contexts meet by
   anchor hash; equal contexts are one, with how often it occurs.
3. In a group, a context is trimmed to what it shares, left and right of the
   anchor, with any other (no window beyond that can be repeated).  If more than
   one trimmed context is left, their suffix array is built by Lyndon grouping,
   and neighbours in it that share `length` bytes are repeated windows.
4. Repeated windows are merged per document, and the rest is kept.

A group of many contexts, or of many bytes, is worked off in pairs of blocks, so
no group is one task's; equal contexts leave each map task once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table, written
from .lyndon_suffix import suffix_array
from .wordhash import mix, text_bytes

GRAM = 64
_BYTE = np.random.Generator(np.random.PCG64(4001)).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.random.Generator(np.random.PCG64(4002)).integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of one text's bytes; windows are starts, inclusive."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    gram = min(GRAM, 1 << (length.bit_length() - 2)) if length < 2 * GRAM else GRAM
    h, size, k = _BYTE[data], 1, 0
    while size < gram:
        h = mix(h[:-size] * _STEP[k] + h[size:])
        size, k = 2 * size, k + 1
    reach = length - gram + 1  # grams in a window
    low, size = h >> np.uint64(1), 1
    # the smallest of `reach` hashes from each place on, by doubling; then its first place
    best = low
    while size < reach:
        step = min(size, reach - size)
        best = np.minimum(best[:-step], best[step:])
        size += step
    count = len(data) - length + 1
    best = best[:count]
    at = np.zeros(count, np.int64)
    order = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    ends = np.concatenate((order[1:], [count]))
    starts_out, ends_out, place_out = [], [], []
    for a, z in zip(order.tolist(), ends.tolist()):
        hits = a + np.flatnonzero(low[a : z - 1 + reach] == best[a])
        if len(hits) == 1:
            starts_out.append(a)
            ends_out.append(z - 1)
            place_out.append(int(hits[0]))
            continue
        for i, p in enumerate(hits.tolist()):  # windows whose first smallest is this one
            lo, hi = max(a, (hits[i - 1] + 1) if i else a), min(z - 1, p)
            if lo <= hi:
                starts_out.append(int(lo))
                ends_out.append(int(hi))
                place_out.append(p)
    del at
    place = np.array(place_out, np.int64)
    return mix(h[place]), place, np.array(starts_out, np.int64), np.array(ends_out, np.int64)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        m = (lo + hi) // 2
        lo, hi = (m, hi) if a[lo:m] == b[lo:m] else (lo, m)
    return lo


def _shared(parts: list[bytes]) -> list[int]:
    """For each string the longest prefix it shares with any other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    best = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = _common(parts[i], parts[j])
        best[i], best[j] = max(best[i], n), max(best[j], n)
    return best


def repeated_windows(texts: list[bytes], times: list[int], length: int) -> list[np.ndarray]:
    """For each text the starts of windows that occur elsewhere: in it, in another text, or in its other copies."""
    marks = [np.zeros(max(0, len(t) - length + 1), bool) for t in texts]
    for m, n in zip(marks, times):
        if n > 1:
            m[:] = True
    symbols: list[int] = []
    owner: list[tuple[int, int]] = []
    for k, t in enumerate(texts):
        symbols += [b + len(texts) + 1 for b in t]
        owner += [(k, i) for i in range(len(t))]
        symbols.append(len(texts) - k)  # separators differ, so no match crosses texts
        owner.append((k, len(t)))
    symbols.append(0)
    owner.append((-1, 0))
    last, last_owner = b"", None
    for place in suffix_array(symbols):
        k, i = owner[place]
        if k < 0 or i + length > len(texts[k]):
            continue
        window = texts[k][i : i + length]
        if window == last:
            marks[k][i] = True
            marks[last_owner[0]][last_owner[1]] = True
        last, last_owner = window, (k, i)
    return [np.flatnonzero(m) for m in marks]


def resolve_group(contexts: list[bytes], offsets: list[int], times: list[int], length: int, spans: list[int]) -> list[list[tuple[int, int]]]:
    """For contexts around one anchor (at offsets[k] in contexts[k]; spans[k] windows from its start), runs of repeated window starts."""
    n = len(contexts)
    out: list[list[tuple[int, int]]] = [[(0, spans[k] - 1)] if times[k] > 1 else [] for k in range(n)]
    if n == 1:
        return out
    right = _shared([c[o:] for c, o in zip(contexts, offsets)])
    left = _shared([c[:o][::-1] for c, o in zip(contexts, offsets)])
    classes: dict[tuple[bytes, int], list[int]] = {}
    for k in range(n):
        lo = max(0, offsets[k] - left[k])
        hi = min(spans[k] - 1, offsets[k] + right[k] - length)
        if lo <= hi:
            classes.setdefault((contexts[k][lo : hi + length], offsets[k] - lo), []).append(k)
    if not classes:
        return out
    items = list(classes.items())
    if len(items) == 1:
        found = [np.arange(len(items[0][0][0]) - length + 1) if len(items[0][1]) > 1 or times[items[0][1][0]] > 1 else np.zeros(0, int)]
    else:
        found = repeated_windows([t for (t, _), _ in items], [sum(times[k] for k in ks) for _, ks in items], length)
    for ((_, o), ks), starts in zip(items, found):
        if len(starts) == 0:
            continue
        cut = np.flatnonzero(np.diff(starts) > 1)
        runs = list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), starts[np.concatenate((cut, [len(starts) - 1]))].tolist()))
        for k in ks:
            if times[k] == 1:
                base = offsets[k] - o
                out[k] = [(a + base, b + base) for a, b in runs]
    return out


def _bytes_of(texts: pa.Array):
    data, off = text_bytes(texts)
    for i in range(len(texts)):
        yield data[off[i] : off[i + 1]]


def _each(make, schema: str, df: DataFrame) -> DataFrame:
    names = [f.name for f in StructType.fromDDL(schema)]

    def over(batches):
        for b in batches:
            for row in range(0, b.num_rows, 256):
                part = b.slice(row, 256)
                cols = make(part)
                if cols is not None:
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(over, schema)


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", id_col: str = "doc_id", block: int = 4000, block_bytes: int = 2 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    A null text is empty; texts shorter than `length` lose nothing.  Rows that
    repeat an id and a text are two documents that hold each other's windows, and
    get a row each; a null id is carried as it is.  kept_text is the rest read as
    UTF-8, where a character that was cut in two is left out.  Columns named in
    `carry` come along in a struct `carried`; others are ignored, whatever their
    names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    few = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))

    def find(part):
        h, s, row, p, a, z = [], [], [], [], [], []
        for i, data in enumerate(_bytes_of(part.column(1))):
            x = anchors(data, length)
            n = len(x[0])
            h.append(x[0].view(np.int64)), p.append(x[1]), a.append(x[2]), z.append(x[3])
            row.append(np.full(n, i))
        row = np.concatenate(row) if row else np.zeros(0, int)
        if len(row) == 0:
            return None
        return [part.column(0).take(pa.array(row)), part.column(2).take(pa.array(row)), pa.array(np.concatenate(h)), pa.array(np.concatenate(p)), pa.array(np.concatenate(a)), pa.array(np.concatenate(z))]

    spots = written(_each(find, f"d {kind}, s long, h long, p long, a long, z long", few), "anchors")
    # written, so that the join below has plain exchanges on both sides, which AQE can split at a hot anchor
    often = written(spots.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "often")
    want = spots.join(often, "h").groupBy(F.col("d").alias("d2"), F.col("s").alias("s2")).agg(F.collect_set(F.struct("h", "p", "a", "z")).alias("spots"))
    want = written(want, "wanted")
    same = F.col("d").eqNullSafe(F.col("d2")) & (F.col("s") == F.col("s2"))

    def cut(part):
        rows, h, o, n, a, c = [], [], [], [], [], []
        for i, (data, spot) in enumerate(zip(_bytes_of(part.column(1)), part.column(3).to_pylist())):
            raw = data.tobytes()
            for x in spot:
                rows.append(i), h.append(x["h"]), a.append(x["a"]), o.append(x["p"] - x["a"]), n.append(x["z"] - x["a"] + 1), c.append(raw[x["a"] : x["z"] + length])
        key = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in c]
        return [part.column(0).take(pa.array(rows, pa.int64())), part.column(2).take(pa.array(rows, pa.int64())), pa.array(h, pa.int64()), pa.array(a, pa.int64()), pa.array(o, pa.int32()), pa.array(n, pa.int32()), pa.array(key, pa.int64()), pa.array(c, pa.binary())]

    made = _each(cut, f"d {kind}, s long, h long, a long, o int, n int, key long, c binary", few.join(want, same).select("d", "t", "s", "spots"))
    made = written(made, "contexts")
    # equal contexts are one: per map task first, then over all
    kinds = made.groupBy("h", "key", "o", "n").agg(F.first("c").alias("c"), F.count("*").alias("m"))
    kinds = written(kinds, "kinds")
    parts = kinds.groupBy("h").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum(F.length("c")) / F.lit(block_bytes))).cast("int").alias("parts"), F.count("*").alias("kinds"))
    kinds = kinds.join(written(parts, "parts"), "h")
    # one context, however often: all its windows are repeated if it occurs twice
    alone = kinds.where("kinds = 1 and m > 1").select(F.col("h").alias("h2"), F.col("key").alias("key2"), F.col("o").alias("o2"), F.col("n").alias("n2"), F.array(F.lit(0), F.col("n") - 1).alias("runs"))
    kinds = kinds.where("kinds > 1").withColumn("own", F.pmod("key", "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kinds = kinds.withColumn("pair", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))

    def solve(batches):
        """Groups lie together, sorted; a group may go on in the next batch."""
        names, last, held = ["h2", "key2", "o2", "n2", "runs"], None, []

        def done(rows):
            h, key, o, n, m, c = zip(*rows)
            runs = resolve_group(list(c), list(o), list(m), length, list(n))
            return [(*r[:4], [x for run in rs for x in run]) for r, rs in zip(rows, runs) if rs]

        out = []
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(7)]
            for row in zip(*cols):
                if row[:2] != last:
                    if held:
                        out += done(held)
                    last, held = row[:2], []
                held.append((row[0], *row[2:]))
            if len(out) > 2000:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names).astype({"o2": "int32", "n2": "int32"}), pa.schema([("h2", pa.int64()), ("key2", pa.int64()), ("o2", pa.int32()), ("n2", pa.int32()), ("runs", pa.list_(pa.int32()))]), preserve_index=False)
                out = []
        if held:
            out += done(held)
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names).astype({"o2": "int32", "n2": "int32"}), pa.schema([("h2", pa.int64()), ("key2", pa.int64()), ("o2", pa.int32()), ("n2", pa.int32()), ("runs", pa.list_(pa.int32()))]), preserve_index=False)

    grouped = kinds.repartition("h", "pair").sortWithinPartitions("h", "pair").select("h", "pair", "key", "o", "n", "m", "c")
    solved = grouped.mapInArrow(solve, "h2 long, key2 long, o2 int, n2 int, runs array<int>").unionByName(alone)
    solved = written(solved, "solved")
    marks = made.drop("c").join(solved, F.expr("h = h2 and key = key2 and o = o2 and n = n2"))
    marks = marks.select(F.col("d").alias("d2"), F.col("s").alias("s2"), F.transform("runs", lambda r: r + F.col("a")).alias("runs"))
    marks = written(marks.groupBy("d2", "s2").agg(F.flatten(F.collect_list("runs")).alias("runs")), "marks")

    def drop(part):
        out = [[] for _ in range(6)]
        for d, data, runs in zip(part.column(0), _bytes_of(part.column(1)), part.column(2)):
            n, spans, removed = len(data), 0, 0
            keep = data
            if runs.is_valid:
                r = np.asarray(runs.values).reshape(-1, 2)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, r[:, 0], 1)
                np.add.at(edge, r[:, 1] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                keep = data[~gone]
            raw = keep.tobytes()
            for c, x in zip(out, (n, removed, spans, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "ignore"))):
                c.append(x)
        return [part.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], *([part.column(3)] if carry else [])]

    whole = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("s"), *([F.struct(*carry).alias("o")] if carry else []))
    final = whole.join(marks, same, "left").select("d", "t", "runs", *(["o"] if carry else []))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return _each(drop, schema + (f", carried {final.schema['o'].dataType.simpleString()}" if carry else ""), final)


def op8_lyndon_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
