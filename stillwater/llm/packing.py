"""Best-fit packing by bin completion.

Lengths have at most `capacity` values, so the corpus is packed as a histogram:
the driver holds one count per length, however many documents there are.
Around the largest length left, fillings of the rest of the bin are enumerated,
dominated ones dropped (a filling in which some items could be swapped for one
larger unused item that still fits), and searched depth first in order of
waste.  A branch ends when its waste already costs as many bins as the
incumbent, which starts as best-fit decreasing; reaching the lower bound ends
the search.  A filling is used as often as the counts allow at once while more
than `exact_items` items are left, one at a time below (there the search is exact
within `node_limit`, by default `DIVES` times what one dive to a leaf can take).
The plan has at most one entry per use of a filling, and
each use empties a length or nearly so.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokens import byte_bpe

Pattern = tuple[tuple[int, int], ...]  # (length, how many in one bin), longest first

DIVES = 4


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fill around the largest length with the largest that fits, again and again; batched by counts."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        room, use = capacity, {}
        for length in sorted(left, reverse=True):
            n = min(left[length], room // length)
            if n and length <= room:
                use[length] = n
                room -= n * length
        times = min(left[k] // n for k, n in use.items())
        plan.append((tuple(sorted(use.items(), reverse=True)), times))
        for k, n in use.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _dominated(items: list[int], waste: int, left: dict[int, int], used: dict[int, int]) -> bool:
    small = items if len(items) <= 6 else items[:6]
    for size in (1, 2, 3):
        for part in combinations(small, size):
            s = sum(part)
            for x in range(s + (size == 1), s + waste + 1):
                if left.get(x, 0) > used.get(x, 0):
                    return True
    return False


def fillings(left: dict[int, int], largest: int, capacity: int, width: int, steps: int = 4000) -> list[tuple[int, Pattern]]:
    """Undominated fillings that hold `largest`, as (waste, pattern), least waste first, at most `width`."""
    lengths = sorted((k for k in left if k <= capacity - largest or k == largest), reverse=True)
    spot = {k: i for i, k in enumerate(lengths)}
    found: dict[Pattern, int] = {}
    budget = [steps]

    def grow(at: int, room: int, use: dict[int, int]) -> None:
        if budget[0] <= 0 or len(found) >= 8 * width:
            return
        budget[0] -= 1
        maximal = True
        if left.get(room, 0) > use.get(room, 0) and room <= lengths[at if at < len(lengths) else -1]:
            tries = [spot[room]] if room in spot else []
        else:
            tries = range(at, len(lengths))
        for i in tries:
            k = lengths[i]
            if k <= room and left[k] > use.get(k, 0):
                maximal = False
                use[k] = use.get(k, 0) + 1
                grow(i, room - k, use)
                use[k] -= 1
                if not use[k]:
                    del use[k]
                if sum(w == 0 for w in found.values()) >= width:
                    return
        if maximal:
            rest = [k for k, n in use.items() for _ in range(n)]
            rest.remove(largest)
            if not _dominated(rest, room, left, use):
                found[tuple(sorted(use.items(), reverse=True))] = room

    grow(0, capacity - largest, {largest: 1})
    if not found:
        pattern, _ = best_fit_decreasing({**{k: v for k, v in left.items() if k <= capacity - largest}, largest: left[largest]}, capacity)[0]
        found[pattern] = capacity - sum(k * n for k, n in pattern)
    return sorted(((w, p) for p, w in found.items()), key=lambda x: (x[0], [-k for k, _ in x[1]]))[:width]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The better of total size and Martello-Toth's L2 over all thresholds up to half a bin."""
    n = np.zeros(capacity + 1, np.int64)
    for k, m in counts.items():
        n[k] = m
    size = n * np.arange(capacity + 1)
    many, long = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(size)))  # of lengths below k
    half = capacity // 2 + 1
    t = np.arange(1, capacity // 2 + 1)
    mid = many[capacity - t + 1] - many[half]
    room = capacity * mid - (long[capacity - t + 1] - long[half])
    small = long[half] - long[t]
    best = many[capacity + 1] - many[capacity - t + 1] + mid + np.maximum(0, -(-(small - room) // capacity))
    return int(max(-(-size.sum() // capacity), many[capacity + 1] - many[half], *best[:]))


def pack_histogram(counts: dict[int, int], capacity: int, node_limit: int | None = None, width: int = 8, exact_items: int = 48) -> list[tuple[Pattern, int]]:
    """[(pattern, how many bins)] that use every item once.  counts: length -> how many, 1 <= length <= capacity."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    if node_limit is None:
        node_limit = max(2000, DIVES * (len(counts) + len(counts) // 4 + exact_items))
    total, least = sum(k * n for k, n in counts.items()), lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    state = {"bins": sum(t for _, t in best), "plan": best, "nodes": node_limit}

    frames: list[tuple] = []  # a dive's open nodes: counts left, bins and waste so far, whether items go one by one, fillings to try
    plan: list[tuple[Pattern, int]] = []

    def visit(left: dict[int, int], bins: int, waste: int) -> None:
        if state["bins"] <= least or state["nodes"] <= 0:
            return
        if not left:
            if bins < state["bins"]:
                state.update(bins=bins, plan=list(plan))
            return
        state["nodes"] -= 1
        if -(-(total + waste) // capacity) >= state["bins"] or bins - (-sum(k * n for k, n in left.items()) // capacity) >= state["bins"]:
            return
        single = sum(left.values()) <= exact_items
        frames.append((left, bins, waste, single, iter(fillings(left, max(left), capacity, width if not single else 8 * width))))

    visit(counts, 0, 0)
    while frames and state["bins"] > least and state["nodes"] > 0:
        left, bins, waste, single, options = frames[-1]
        option = next(options, None)
        if option is None:
            frames.pop()
            continue
        more, pattern = option
        times = 1 if single else min(left[k] // n for k, n in pattern)
        rest = dict(left)
        for k, n in pattern:
            rest[k] -= n * times
            if not rest[k]:
                del rest[k]
        del plan[len(frames) - 1 :]
        plan.append((pattern, times))
        visit(rest, bins + times, waste + more * times)
    return state["plan"]


def token_pieces(docs: DataFrame, capacity: int, text_col: str, id_col: str, end_id: int = 0, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; the first piece takes the remainder."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode = byte_bpe(name).encode
        for b in batches:
            rows = []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                edges = [0, *range(first, n + 1, capacity)]
                rows += [(k, i, x, y - x, zlib.crc32(ids[4 * x : 4 * y])) for i, (x, y) in enumerate(zip(edges, edges[1:]))]
            if rows:
                k, piece, *rest = zip(*rows)
                # ids stay what they are: a null among them must not make doubles of the others
                cols = [b.column(0).take(pa.array(k)), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in rest]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    few = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    return few.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def assign(pieces: DataFrame, capacity: int, per_salt: int = 50_000, **search) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` of 1 to capacity.

    Rows of one length are ranked in salted parts (a part has about `per_salt`
    rows, so no length is one task's), whose offsets are sums of the parts
    before; a rank then says which bin of the plan the row goes to.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = pack_histogram(counts, capacity, **search)
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, times in plan:
        offset = 0
        for length, k in pattern:
            entries.setdefault(length, []).append((used.get(length, 0), base, k, offset))
            used[length] = used.get(length, 0) + k * times
            offset += length * k
        base += times
    arrays = {k: np.array(v, np.int64) for k, v in entries.items()}

    def place(batches):
        for b in batches:
            length, rank = b.column(1).to_numpy(), b.column(2).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                e = arrays[int(k)]
                e = e[np.searchsorted(e[:, 0], rank[at], side="right") - 1]
                i = rank[at] - e[:, 0]
                seq[at], off[at] = e[:, 1] + i // e[:, 2], e[:, 3] + i % e[:, 2] * k
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seq), pa.array(off)], names=["row", "sequence_id", "offset"])

    salts = max(1, sum(counts.values()) // per_salt)
    # a row travels as one struct, so its columns meet no name of ours
    parts = pieces.select(F.struct(*pieces.columns).alias("row"), "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int").alias("salt"))
    before = parts.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.selectExpr("length as l", "salt as s", "sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding) as before")
    ranked = parts.selectExpr("*", "row_number() over (partition by length, salt order by row.doc_id, row.piece, row.start, row.ids_crc32) - 1 as r")
    ranked = ranked.join(before, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
    ranked = ranked.select("row", "length", (F.col("r") + F.coalesce("before", F.lit(0))).cast("long").alias("rank"))
    kind = ranked.schema["row"].dataType.simpleString()
    return ranked.mapInArrow(place, f"row {kind}, sequence_id long, offset long").select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = 2048, text_col: str = "text", id_col: str = "doc_id", **search) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: it still has its end id.  Rows that repeat are packed
    each; a null id stays null; other columns of `docs` are ignored.
    """
    return assign(written(token_pieces(docs, capacity, text_col, id_col), "pieces"), capacity, **search)


def op9_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
