"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a stream of characters is the one whose pieces have
the largest sum of scores; a character that no piece covers costs a fixed
penalty and becomes its UTF-8 byte pieces.  Only a window bounded by the longest
piece is kept: whenever the backpointer paths of all positions that can still be
extended run through one boundary, the ids up to it are committed.

Over a corpus, texts are first cut at places that no piece crosses (all paths
converge there whatever the scores), and equal parts are encoded once per worker
by a bounded memo.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"


class _Memo(dict):
    """part -> ids as bytes, for parts behind `prefix`; long parts are not kept, and a full memo is emptied."""

    def __init__(self, ids_of, prefix: str, most: int):
        self.ids_of, self.prefix, self.most = ids_of, prefix, most

    def __missing__(self, part: str) -> bytes:
        got = self.ids_of(self.prefix + part)
        if len(part) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[part] = got
        return got


class PieceModel:
    """Pieces and scores of a SentencePiece file: encode(text) -> ids, decode(ids) -> text."""

    def __init__(self, path: str | None = None, memo: int = 1 << 19):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(len(sp))]
        self.scores = [sp.get_score(i) for i in range(len(sp))]
        special = {i for i in range(len(sp)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in special if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.longest = max(map(len, self.ids), default=1)
        self.penalty = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        # every prefix of a piece; what is no piece itself can only be passed through
        node = {p[:k]: -math.inf for p in self.ids for k in range(1, len(p))} | {p: self.scores[i] for p, i in self.ids.items()}
        self.trie: dict = {}  # char -> (score, what may follow)
        for p in sorted(node, key=len):
            at = self.trie
            for c in p[:-1]:
                at = at[c][1]
            at[p[-1]] = (node[p], {})
        inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.cut_at_space = not any(a != SPACE and b == SPACE for a, b in inner)
        self.cut_at_line = not any("\n" in x for x in inner)
        self.parts = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.spaced, self.bare = _Memo(self._bytes_of, SPACE, memo), _Memo(self._bytes_of, "", memo)
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[list(self.byte_of)] = True

    def _ids_of(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte.get(b, self.unknown) for b in piece.encode("utf-8", "replace")]

    def _bytes_of(self, part: str) -> bytes:
        ids = [i for some in self.stream(part) for i in some]
        return struct.pack(f"<{len(ids)}I", *ids)

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Commit ids as soon as all surviving paths agree; ties go to the longer last piece.

        Paths are pushed forward from each boundary over the pieces that begin
        there, so the window reads `longest` characters ahead of the boundary.
        A path survives if it ends at a boundary that is still to be pushed.
        """
        source, longest, trie, penalty = iter(chars), self.longest, self.trie, self.penalty
        window = "".join(islice(source, 2 * longest))
        best, back = [0.0, *[-math.inf] * len(window)], [0] * (len(window) + 1)
        at, whole = 0, len(window) < 2 * longest  # whole: the source has ended
        while True:
            for k in range(at, len(window) if whole else len(window) - longest + 1):
                b, follow = best[k], trie
                if b + penalty > best[k + 1]:
                    best[k + 1], back[k + 1] = b + penalty, k
                end = k
                for c in window[k : k + longest]:
                    hit = follow.get(c)
                    if hit is None:
                        break
                    end += 1
                    score, follow = hit
                    if b + score > best[end]:
                        best[end], back[end] = b + score, k
            if whole:
                if window:
                    yield self._path(window, back, len(window))
                return
            at = len(window) - longest + 1
            through: set[int] | None = None
            for end in range(at, len(window) + 1):
                if best[end] > -math.inf:
                    path, k = {end}, end
                    while k:
                        k = back[k]
                        path.add(k)
                    through = path if through is None else through & path
            cut = max(through)
            if cut:
                yield self._path(window, back, cut)
                window, at = window[cut:], at - cut
                best, back = [b - best[cut] for b in best[cut:]], [max(0, k - cut) for k in back[cut:]]
            more = "".join(islice(source, longest))
            whole = len(more) < longest
            window += more
            best += [-math.inf] * len(more)
            back += [0] * len(more)

    def _path(self, window: str, back: list[int], end: int) -> list[int]:
        parts = []
        while end:
            parts.append(window[back[end] : end])
            end = back[end]
        return [i for p in reversed(parts) for i in self._ids_of(p)]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text; null and empty texts have none.  A blank is put in front, as the file's settings ask."""
        if not text:
            return np.zeros(0, np.uint32)
        body = SPACE + text.replace(" ", SPACE)
        if not (self.cut_at_space and self.cut_at_line):
            return np.array([i for ids in self.stream(body) for i in ids], np.uint32)
        if text[0] == " " or "  " in text or SPACE in text:  # runs of blanks are one part
            return np.frombuffer(b"".join(map(self.bare.__getitem__, self.parts.findall(body))), "<u4")
        out, part = [], self.spaced.__getitem__
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            out.append((self.bare[first] if k else self.spaced[first]) + b"".join(map(part, rest)))
        return np.frombuffer(self.bare["\n"].join(out), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8."""
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64)
        bytewise = len(ids) and self.is_byte[ids].any()
        ids = ids.tolist()
        if bytewise:
            out, raw = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.pieces[i])
            out.append(raw.decode("utf-8", "replace"))
            whole = "".join(out)
        else:
            whole = "".join(map(self.pieces.__getitem__, ids))
        return whole.replace(SPACE, " ")[1:]


_loaded: dict[str | None, PieceModel] = {}


def piece_model(path: str | None = None) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def encode_pieces(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """`docs` with piece_ids array<int>.  Null and empty texts have no ids; all rows and columns are kept."""

    def encode(texts: pd.Series) -> pd.Series:
        model = piece_model(path)
        return pd.Series([model.encode(t if isinstance(t, str) else None).astype(np.int32) for t in texts], dtype=object)

    return docs.withColumn("piece_ids", F.pandas_udf(encode, "array<int>")(F.col(text_col)))


def decode_pieces(rows: DataFrame, ids_col: str = "piece_ids", path: str | None = None) -> DataFrame:
    """`rows` with decoded string; a null array decodes to the empty text."""

    def decode(ids: pd.Series) -> pd.Series:
        model = piece_model(path)
        return pd.Series([model.decode(x) if x is not None and len(x) else "" for x in ids])

    return rows.withColumn("decoded", F.pandas_udf(decode, "string")(F.col(ids_col)))


def op6_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back."""

    def digest(texts: pd.Series) -> pd.DataFrame:
        model, rows = piece_model(), []
        for t in texts:
            t = t if isinstance(t, str) else ""
            ids = model.encode(t)
            rows.append((len(ids), zlib.crc32(ids.tobytes()), model.decode(ids) == t))
        return pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "round_trip"])

    said = F.pandas_udf(digest, "n_pieces long, ids_crc32 long, round_trip boolean")
    return table(spark, sf_dir, "documents").select("doc_id", said("text").alias("s")).select("doc_id", "s.*")
