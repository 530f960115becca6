"""LM scoring with an Elias-Fano n-gram trie.

The model is an interpolated n-gram model with absolute discounting.  A shard of
the trie holds the n-grams whose contexts hash to it, as levels: the first words
of contexts, then per level the words that follow each node of the level above.
Each level is a monotone sequence in Elias-Fano form (low bytes in planes, high
parts in a unary bit vector), monotone pointers say where each node's successors
begin, and discounted probabilities and backoff weights are quantised to two
bytes; the levels lie in one memory-mapped file.  A query walks from the root: in
the range that its node's pointers give it searches the next word's successor.

Distribution: texts are cut into blocks.  A block sends its distinct n-grams with
their training counts, nested by context, a message for each (level, shard).  A
(level, shard) sums the counts of all blocks, builds its trie, and answers every
block in the order it asked, two bytes for an n-gram.  So no model is collected
or broadcast, a hot word costs a row per block and shard, and what moves grows
with the corpus.  The number of shards goes with the bytes of text.

A shard's trie file is a scratch file of the task that builds it: it is read
there alone, removed when the task ends and built again when the task runs again.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .wordhash import mix, slices, word_hashes, words  # noqa: F401

END, BEGIN = np.uint64(0x1F3A5C7E9B2D4F60), np.uint64(0x2E4C6A8B0D1F3E5C)
DISCOUNT = 0.95
_LOW = np.uint64(0xFFFFFFFF)
_INNER = np.uint32(0xFFFFFF)  # from level 3 on, words behind the first are named by 24 bits: few words follow one context
_HALF = np.uint64(32)


class EliasFano:
    """A sorted sequence of unsigned integers: low bytes in planes, high parts in a unary bit vector.

    Where the buckets of equal high parts begin is read off the bit vector once,
    when the sequence is first searched.
    """

    def __init__(self, n: int, planes: list[np.ndarray], bits: np.ndarray):
        self.n, self.planes, self.bits, self.low = n, planes, bits, 8 * len(planes)
        self._high: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, low = len(values), 0
        top = int(values[-1]) if n else 0
        while low < 56 and (top >> low) > max(1, 2 * n):
            low += 8
        planes = [((values >> np.uint64(k)) & np.uint64(255)).astype(np.uint8) for k in range(0, low, 8)]
        high = (values >> np.uint64(low)).astype(np.int64)
        flags = np.zeros((int(high[-1]) if n else 0) + n + 1, np.uint8)
        flags[high + np.arange(n)] = 1
        return cls(n, planes, np.packbits(flags))

    def arrays(self) -> list[np.ndarray]:
        return [*self.planes, self.bits]

    @property
    def high(self) -> np.ndarray:
        """The high part of each value: the place of its one, less the ones before."""
        if self._high is None:
            self._high = (np.flatnonzero(np.unpackbits(self.bits))[: self.n] - np.arange(self.n)).astype(np.int64)
            self._first = np.searchsorted(self._high, np.arange((int(self._high[-1]) if self.n else -1) + 2)).astype(np.int64)
        return self._high

    def _lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k, p in enumerate(self.planes):
            out |= p[at].astype(np.uint64) << np.uint64(8 * k)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at places `at`."""
        return self.high[at].astype(np.uint64) << np.uint64(self.low) | self._lows(at)

    def successor(self, queries: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value not below each query inside begin..end, whether it equals the query)."""
        queries, high = np.asarray(queries, np.uint64), self.high
        if self.n == 0:
            return np.zeros(len(queries), np.int64), np.zeros(len(queries), bool)
        want = queries >> np.uint64(self.low)
        over = want > np.uint64(high[-1])
        want = np.where(over, 0, want).astype(np.int64)
        lo, hi = self._first[want], self._first[want + 1]
        if begin is not None:
            lo, hi = np.clip(lo, begin, end), np.clip(hi, begin, end)
        lo, hi = np.where(over, self.n, lo), np.where(over, self.n, hi)
        stop, low = hi.copy(), queries & np.uint64((1 << self.low) - 1)
        if self.low:
            while (go := np.flatnonzero(lo < hi)).size:
                mid = (lo[go] + hi[go]) >> 1
                less = self._lows(mid) < low[go]
                lo[go], hi[go] = np.where(less, mid + 1, lo[go]), np.where(less, hi[go], mid)
        near = np.minimum(lo, self.n - 1)
        return lo, (lo < stop) & (self._lows(near) == low)


class Codebook:
    """Two-byte codes for log10 values: 65,535 even steps between the extremes; code 0 means absent."""

    def __init__(self, values: np.ndarray):
        self.least = float(values.min()) if len(values) else 0.0
        self.step = max(float(values.max()) - self.least, 1e-9) / 65_534 if len(values) else 1.0

    def encode(self, values: np.ndarray) -> np.ndarray:
        return (1 + np.rint((values - self.least) / self.step)).astype(np.uint16)


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Trie:
    """The n-grams of one level and shard in a memory-mapped file.

    words: the sorted first words, then per further depth the sorted nodes, each
    its parent's place << 32 | its word; counts: how often each n-gram occurs.
    """

    def __init__(self, words: list[np.ndarray], counts: np.ndarray):
        parts: dict[str, EliasFano] = {"words0": EliasFano.build(words[0])}
        for depth in range(1, len(words)):
            begin = np.searchsorted(words[depth] >> 32, np.arange(len(words[depth - 1]) + 1))
            parts[f"pointers{depth}"], parts[f"words{depth}"] = EliasFano.build(begin), EliasFano.build(words[depth])
        kinds = np.diff(begin)  # of each context
        total = np.add.reduceat(counts, begin[:-1]).astype(float) if len(counts) else np.zeros(0)
        prob = np.log10((counts - DISCOUNT) / np.repeat(total, kinds)) if len(counts) else np.zeros(0)
        backoff = np.log10(DISCOUNT * kinds / total) if len(counts) else np.zeros(0)
        self.depth, self.prob_book, self.backoff_book = len(words), Codebook(prob), Codebook(backoff)
        codes = {"prob": self.prob_book.encode(prob), "backoff": self.backoff_book.encode(backoff)}
        handle, self.path = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(handle, "wb") as out:
            spots = []
            for x in [a for ef in parts.values() for a in ef.arrays()] + list(codes.values()):
                spots.append((out.tell(), x.dtype, len(x)))
                out.write(x.tobytes())
                out.write(b"\0" * (-out.tell() % 8))
            out.write(b"\0" * 8)
        flat = np.asarray(np.memmap(self.path, np.uint8, "r"))
        views = iter([flat[at : at + n * t.itemsize].view(t) for at, t, n in spots])
        self.levels = {k: EliasFano(ef.n, [next(views) for _ in ef.planes], next(views)) for k, ef in parts.items()}
        self.prob, self.backoff = next(views), next(views)

    def close(self) -> None:
        os.unlink(self.path)

    def look_up(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(probability code of each n-gram, backoff code of each context) of nested lists; 0: not in the model.

        lists: the contexts' first words, then for each further depth how many words follow each node and those words.
        """
        node, there = self.levels["words0"].successor(lists[0])
        for depth in range(1, self.depth):
            sizes, word = lists[2 * depth - 1 : 2 * depth + 1]
            if depth == self.depth - 1:
                backoff = np.zeros(len(node), np.uint16)
                backoff[there] = self.backoff[node[there]]
            parent, known = np.repeat(node, sizes), np.repeat(there, sizes)
            node, there = np.zeros(len(word), np.int64), known.copy()
            ask = parent[known]
            pointers = self.levels[f"pointers{depth}"]
            edges = pointers.get(np.arange(pointers.n)).astype(np.int64)
            query = ask.astype(np.uint64) << _HALF | word[known].astype(np.uint64)
            node[known], there[known] = self.levels[f"words{depth}"].successor(query, edges[ask], edges[ask + 1])
        code = np.zeros(len(node), np.uint16)
        code[there] = self.prob[node[there]]
        return code, backoff


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], "<i8")
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + planes)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for kind, size in head.tolist():
        t = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, np.uint8, size * t.itemsize, at).reshape(t.itemsize, size).T.copy().view(t).reshape(size))
        at += size * t.itemsize
    return out


def _runs(keys: np.ndarray):
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(keys)]):
        yield int(keys[a]), a, b


def _numbered(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key among the sorted distinct ones of keys and more, those)."""
    n = len(keys)
    if len(more):
        keys = np.concatenate((keys, more))
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return place[:n], keys[new]


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on, and what it keeps adds to the next stage's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU C library has it
        trim(0)


class _Block:
    """The n-grams of a block of texts.

    queries(): (level, shard, blob) messages.  maps(): what turns their answers,
    one shard's behind another's, into sums per text.  Words ask with their
    successors: a message of level 2 holds the words of a shard, their counts,
    and what follows each.
    """

    def __init__(self, texts: pa.Array, train: np.ndarray, order: int, shards: int):
        h, first = word_hashes(texts)
        n = np.diff(first) + 1
        ends = np.cumsum(n) - 1
        begins = ends - n + 1
        tok = np.empty(int(n.sum()), np.uint64)
        hole = np.ones(len(tok), bool)
        hole[ends] = False
        tok[ends], tok[hole] = END, h
        del h, hole
        self.learn, self.asked = np.repeat(train, n), []
        code, kinds = pd.factorize(tok.view(np.int64))
        del tok
        w = np.concatenate((kinds.view(np.uint64), [BEGIN]))
        shard = (mix(w) % np.uint64(shards)).astype(np.int32)
        rank = np.lexsort((w, shard))
        place = np.empty(len(w), np.int32)
        place[rank] = np.arange(len(w))
        word, begin, w, shard = place[code], int(place[-1]), w[rank], shard[rank]
        del code, kinds
        self.w, self.word, self.shard, self.order = w, word, shard, order
        maps, path, home = [], mix(w), mix(w + np.uint64(1))  # path: a hash of each node's words; home: of its first word
        node, blank, above = word, begin, np.arange(len(w), dtype=np.uint32)  # above: where the answers to the level before hold each of its nodes
        self.tree: list[tuple[np.ndarray, np.ndarray]] = [(above, above)]  # (owner, word) of each level's nodes
        for level in range(2, order + 1):
            keys = np.empty(len(node), np.int64)
            keys[1:] = node[:-1]
            keys[begins] = blank
            keys <<= 32
            keys |= word
            empty = np.array([blank << 32 | begin] if level < order else [], np.int64)
            lower, (node, grams) = node, _numbered(keys, empty)
            del keys
            owner, last = (grams >> 32).astype(np.uint32), grams.astype(np.uint32)
            sizes = np.bincount(owner, minlength=len(path))
            cs = np.arange(len(path)) if level == 2 else np.flatnonzero(sizes)
            at, sizes = (np.cumsum(sizes) - sizes)[cs], sizes[cs]
            # a first word's contexts go to an eighth of the shards: a frequent one is split, and a message names few of them again
            cshard = shard if level == 2 else ((home[cs] + path[cs] % np.uint64(max(1, shards // 8))) % np.uint64(shards)).astype(np.int32)
            by = np.argsort(cshard, kind="stable")
            at, sizes, cs, cshard = at[by], sizes[by], cs[by], cshard[by]
            perm = (np.repeat(at, sizes) + _ranges(sizes)).astype(np.uint32)
            below = np.zeros(len(grams), np.uint32)
            below[node] = lower
            maps += [above[below[perm]], sizes.astype(np.uint32)]
            above = np.empty(len(grams), np.uint32)
            above[perm] = np.arange(len(grams))
            self.asked.append((level, cs, cshard, sizes, perm, last, node))
            path, home = mix(path[owner] * np.uint64(0x9E3779B97F4A7C15) + w[last]), home[owner]
            self.tree.append((owner, last))
            if len(empty):
                blank = int(np.searchsorted(grams, empty[0]))
        self.n, self.links, self.places = n, maps, (above, node)

    def maps(self) -> list[np.ndarray]:
        above, node = self.places
        # sums need no order inside a text: sorted places in steps compress well
        flat = np.sort(np.repeat(np.arange(len(self.n)), self.n) << 32 | above[node]) & 0xFFFFFFFF
        return [self.n.astype(np.int64), np.diff(flat, prepend=0).astype(np.uint32), *self.links]

    def queries(self):
        low = (self.w & _LOW).astype(np.uint32)
        counts = np.bincount(self.word[self.learn], minlength=len(self.w)).astype(np.uint32)
        if self.order == 1:
            for s, a, b in _runs(self.shard):
                yield 2, s, _pack(self.w[a:b], counts[a:b])
        for level, cs, cshard, sizes, perm, last, node in self.asked:
            times = np.bincount(node[self.learn], minlength=len(last)).astype(np.uint32)[perm]
            successors, edge = (low if level == 2 else low & _INNER)[last[perm]], np.concatenate(([0], np.cumsum(sizes)))
            for s, a, b in _runs(cshard):
                x, y = edge[a], edge[b]
                first = [self.w[a:b], counts[a:b]] if level == 2 else self._nested(cs[a:b], low, level)
                yield level, s, _pack(*first, sizes[a:b].astype(np.uint32), successors[x:y], times[x:y])

    def _nested(self, nodes: np.ndarray, low: np.ndarray, level: int) -> list[np.ndarray]:
        """Contexts as lists from their first words down: first words, (sizes, words) of each further depth."""
        out: list[np.ndarray] = []
        for owner, last in reversed(self.tree[1 : level - 1]):
            own = owner[nodes]
            at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            out[:0] = [np.diff(np.concatenate((at, [len(own)]))).astype(np.uint32), low[last[nodes]] & _INNER]
            nodes = own[at]
        return [low[nodes], *out]


def _answer(level: int, blocks: list[int], blobs: list[bytes]):
    """(block, blob) answers of one level and shard: sum the blocks' counts, build the trie, walk it for each block."""
    sums: list[np.ndarray] = []
    if level == 2:  # the words' own counts
        parts = [_unpack(b)[:2] for b in blobs]
        w, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
        seen = c[c > 0]
        yield -1, _pack(np.array([seen.sum(), len(seen), (seen == 1).sum()]))
        sums = [c[np.searchsorted(w, p[0])] for p in parts]
        del parts, w, at, c, seen
    lists_of = lambda blob: (lambda x: [x[0], *x[2:]] if level == 2 else x)(_unpack(blob))
    if len(lists_of(blobs[0])) == 1:  # of order 1
        for block, total in zip(blocks, sums):
            yield block, _pack(total)
        return
    paths: list[list[np.ndarray]] = [[] for _ in range(level)]
    counts = []
    for blob in blobs:
        *lists, count = lists_of(blob)
        keep = np.flatnonzero(count)
        counts.append(count[keep])
        under = keep  # the node of each depth that a counted n-gram lies under, from the last depth up
        for depth in range(level - 1, -1, -1):
            paths[depth].append(lists[2 * depth][under])
            if depth:
                under = np.repeat(np.arange(len(lists[2 * depth - 2]), dtype=np.int32), lists[2 * depth - 1])[under]
        del lists, count, keep, under
    column = np.concatenate(paths[0])
    levels = [np.unique(column)]
    ids = np.searchsorted(levels[0], column).astype(np.int64)
    for depth in range(1, level):  # number the nodes of each depth in sorted order
        column = np.concatenate(paths[depth])
        paths[depth] = []
        ids <<= 32
        ids |= column
        del column
        ids, nodes = _numbered(ids, np.zeros(0, np.int64))
        ids = ids.astype(np.int64)
        levels.append(nodes)
    total = np.bincount(ids, np.concatenate(counts), minlength=len(levels[-1])).astype(np.int64)
    trie = Trie(levels, total)
    del paths, counts, ids, levels, nodes, total
    try:
        books = np.array([trie.prob_book.least, trie.prob_book.step, trie.backoff_book.least, trie.backoff_book.step])
        for i, (block, blob) in enumerate(zip(blocks, blobs)):
            yield block, _pack(*trie.look_up(lists_of(blob)[:-1]), books, *sums[i : i + 1])
    finally:
        trie.close()


def _scores(maps: list[np.ndarray], answers: dict[int, list[bytes]], size: int, kinds: int, once: int):
    """(tokens, known tokens, base score, score) of each text of a block."""
    n, steps, *links = maps
    own = [_unpack(b) for b in answers[2]]
    c = np.concatenate([x[-1] for x in own])
    unknown = min(max(once, 1) / (size + 1), 0.5) if size else 1.0
    base, known = np.log10((c + 0.1) / (size + 0.1 * (kinds + 1))), (c > 0).astype(np.int64)
    p = np.where(c > 0, (1 - unknown) * c / max(size, 1), unknown)
    for level in range(2, len(links) // 2 + 2):
        below, sizes = links[2 * level - 4 : 2 * level - 2]
        prob, weight = [], []
        for x in own if level == 2 else map(_unpack, answers[level]):
            code, backoff, books = x[:3]
            prob.append(np.where(code > 0, 10 ** (books[0] + (code - 1.0) * books[1]), 0.0))
            weight.append(np.where(backoff > 0, 10 ** (books[2] + (backoff - 1.0) * books[3]), 1.0))
        p = np.minimum(1.0, np.concatenate(prob) + np.repeat(np.concatenate(weight), sizes) * p[below])
        base, known = base[below], known[below]
    at, starts = np.cumsum(steps, dtype=np.uint32), np.cumsum(n) - n
    return [n, *(np.add.reduceat(x[at], starts) for x in (known, base, np.log10(p)))]


def score_texts(docs: DataFrame, train, order: int = 2, shards: int | None = None, block_bytes: int = 12 << 20, shard_bytes: int = 4 << 20, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    train: a boolean column; rows where it is true are learnt from (null: not).
    A null or blank text is the end token alone.  Rows that repeat are learnt from
    and scored each.  Without training rows all tokens are unknown and share one
    class.  Other columns are ignored, whatever their names.  Words that follow
    the same context are told apart in `score` by 32 bits of their hash behind one
    word and by 24 behind more; a context of one word is known by 64 bits, a longer
    one by 32 of its first word, 24 of each other one and its shard; n_known and base_score go by the 64-bit hash.
    """
    spark = docs.sparkSession
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_bytes(docs) // shard_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    few = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.coalesce(train, F.lit(False)).alias("l"))

    def blocks(batches):
        block = (TaskContext.get().partitionId() + 1) << 32
        for b in batches:
            for x, y in slices(b.column(1), block_bytes):
                ids, learn = b.column(0).slice(x, y - x), np.asarray(b.column(2).slice(x, y - x).to_numpy(zero_copy_only=False), bool)
                yield block, ids, learn, _Block(b.column(1).slice(x, y - x), learn, order, shards)
                block += 1
                _give_back()

    def ask(batches):
        for block, _, _, made in blocks(batches):
            messages = made.queries()
            while some := list(islice(messages, 64)):
                level, shard, blob = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some)), pa.array(level, pa.int32()), pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], names=["block", "level", "shard", "blob"])

    def keep(batches):
        for block, ids, learn, made in blocks(batches):
            own = [pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([(~learn).tolist()], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_pack(*made.maps())], pa.binary()), *own], names=["block", "blob", "ids", "held"])

    def answer(key, group):
        level, shard = (k.as_py() for k in key)
        block, blob = zip(*_answer(level, group.column("block").to_pylist(), group.column("blob").to_pylist()))
        _give_back()
        return pa.table({"block": pa.array(block, pa.int64()), "level": pa.array([level] * len(block), pa.int32()), "shard": pa.array([shard] * len(block), pa.int32()), "blob": pa.array(blob, pa.binary())})

    # the blocks are cut twice from the same scan: kept, they would take more disk than the messages
    asked = few.mapInArrow(ask, "block long, level int, shard int, blob binary")
    told = written(asked.groupBy("level", "shard").applyInArrow(answer, "block long, level int, shard int, blob binary"), "answers")
    total = np.zeros(3, np.int64)
    for r in told.where("block = -1").select("blob").collect():  # one row of three sums a shard
        total += _unpack(r["blob"])[0]
    size, kinds, once = total.tolist()

    def finish(left, right):
        answers: dict[int, list[bytes]] = {}
        for level, _, blob in sorted(zip(*(right.column(c).to_pylist() for c in ("level", "shard", "blob")))):
            answers.setdefault(level, []).append(blob)
        if left.num_rows != 1 or not answers:
            raise ValueError("the rows changed between two reads of the input")
        n, known, base, score = _scores(_unpack(left.column("blob")[0].as_py()), answers, size, kinds, once)
        _give_back()
        ids, held = (left.column(c).combine_chunks().flatten() for c in ("ids", "held"))
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(n), size, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    texts = few.mapInArrow(keep, f"block long, blob binary, ids array<{kind}>, held array<boolean>")
    answers = told.where("block >= 0")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _bytes(docs: DataFrame) -> int:
    """The planner's estimate of a frame's bytes; where it has none, the rows are measured."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 60:
        return size
    return int(docs.select(F.struct(*docs.columns).cast("string").alias("row")).agg(F.sum(F.octet_length("row"))).first()[0] or 0)


def op1_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 != 0, order=3)
