"""Token counts of flat, unindexed token files.

A token file is a stream of fixed-width ids; an end-of-document id closes each
document and nothing says where documents begin.  Files are read in blocks,
whose edges fall anywhere.  Each block is searched for the end id with one
vectorised comparison; a prefix scan over block summaries (tokens and
separators before the block, the last separator before it) then stitches the
documents that cross block edges.  The scan runs in two levels, so a file with
a third of all blocks is not one task's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokens import byte_bpe

#: Two bytes hold ids to 65535; the vocabulary ends before it, so no text can hold the separator.
END_ID = 65535


def write_token_files(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", end_id: int = END_ID, block_tokens: int = 1 << 17, name: str = "byte_bpe_50k") -> DataFrame:
    """Tokenise into flat files of 16-bit ids, one file per partition: (file, block, data, doc_ids).

    Rows with data are the file's blocks, in order and cut anywhere; rows with
    doc_ids are a manifest of the documents in file order, without their lengths.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if not 0 <= end_id <= 65535:
        raise ValueError("the separator must fit in two bytes")

    def write(batches):
        encode, file, block, pending, n, batch_no = byte_bpe(name).encode, TaskContext.get().partitionId(), 0, [], 0, 0

        def row(at, data, doc_ids, of):
            cols = [pa.array([file]), pa.array([at]), pa.array([data], pa.binary()), pa.array([doc_ids], pa.list_(of))]
            return pa.RecordBatch.from_arrays(cols, names=["file", "block", "data", "doc_ids"])

        for b in batches:
            of = b.column(0).type
            for text in b.column(1).to_pylist():
                ids = np.frombuffer(encode(text), "<u4")
                if len(ids) and (ids == end_id).any() or len(ids) and int(ids.max()) > 65535:
                    raise ValueError("the vocabulary holds the separator or an id over two bytes")
                pending += [ids.astype("<u2"), np.array([end_id], "<u2")]
                n += len(ids) + 1
                if n >= block_tokens:
                    flat = np.concatenate(pending)
                    whole = n // block_tokens * block_tokens
                    for a in range(0, whole, block_tokens):
                        yield row(block, flat[a : a + block_tokens].tobytes(), None, of)
                        block += 1
                    pending, n = [flat[whole:]], n - whole
            yield row(batch_no, None, b.column(0).to_pylist(), of)
            batch_no += 1
        if n:
            yield row(block, np.concatenate(pending).tobytes(), None, of)

    few = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    return written(few.mapInArrow(write, f"file long, block long, data binary, doc_ids array<{kind}>"), "tokens")


def prefix_scan(blocks: DataFrame, super_block: int = 1024) -> DataFrame:
    """blocks(file, block, n, seps, last) -> with t0, s0 (tokens, separators before) and prev (last separator's place before, -1)."""
    b = blocks.withColumn("sb", F.floor(F.col("block") / super_block))
    own = "over (partition by file, sb order by block rows between unbounded preceding and 1 preceding)"
    inner = b.selectExpr("*", f"coalesce(sum(n) {own}, 0) as t1", f"coalesce(sum(size(seps)) {own}, 0) as s1")
    inner = inner.withColumn("l1", F.expr(f"max(t1 + last) {own}"))
    top = inner.groupBy("file", "sb").agg(F.sum("n").alias("n"), F.sum(F.size("seps")).alias("s"), F.max(F.expr("t1 + last")).alias("l"))
    up = "over (partition by file order by sb rows between unbounded preceding and 1 preceding)"
    top = top.selectExpr("file", "sb", "l", f"coalesce(sum(n) {up}, 0) as t2", f"coalesce(sum(s) {up}, 0) as s2").selectExpr("*", f"max(t2 + l) {up} as l2")
    top = top.withColumnsRenamed({"file": "f2", "sb": "sb2"})
    out = inner.join(top, (F.col("file") == F.col("f2")) & (F.col("sb") == F.col("sb2")))
    return out.select("file", "block", "n", "seps", "last", (F.col("t1") + F.col("t2")).alias("t0"), (F.col("s1") + F.col("s2")).alias("s0"), F.coalesce(F.col("t2") + F.col("l1"), F.col("l2"), F.lit(-1)).alias("prev"))


def count_tokens(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """blocks(file, block, data) -> file, doc (from 0 in its file), start (token place), n_tokens (without the end id).

    An empty or null block has no tokens.  Tokens after a file's last end id
    are a document as well; a file that ends with an end id has none.
    """

    def search(batches):
        for b in batches:
            n, seps = [], []
            for data in b["data"]:
                ids = np.frombuffer(data or b"", dtype)
                n.append(len(ids))
                seps.append(np.flatnonzero(ids == end_id).astype(np.int32))
            yield pd.DataFrame({"file": b["file"], "block": b["block"], "n": n, "seps": seps, "last": [int(s[-1]) if len(s) else None for s in seps]}).astype({"last": "Int64"})

    found = written(blocks.select("file", "block", "data").mapInPandas(search, "file long, block long, n long, seps array<int>, last long"), "separators")
    s = prefix_scan(found)
    inside = s.select("file", "t0", "s0", "prev", "seps", F.posexplode("seps").alias("i", "sep"))
    ends = inside.select("file", (F.col("s0") + F.col("i")).alias("doc"), F.when(F.col("i") == 0, F.col("prev") + 1).otherwise(F.col("t0") + F.expr("seps[i - 1]") + 1).alias("start"), (F.col("t0") + F.col("sep")).alias("stop"))
    tail = s.groupBy("file").agg(F.max(F.col("t0") + F.col("n")).alias("stop"), F.max(F.col("s0") + F.size("seps")).alias("doc"), F.max(F.greatest(F.col("prev"), F.coalesce(F.col("t0") + F.col("last"), F.lit(-1)))).alias("p"))
    tail = tail.where("stop > p + 1").select("file", "doc", (F.col("p") + 1).alias("start"), "stop")
    return ends.unionByName(tail).select("file", F.col("doc").cast("long").alias("doc"), F.col("start").cast("long").alias("start"), (F.col("stop") - F.col("start")).cast("long").alias("n_tokens"))


def document_token_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **writing) -> DataFrame:
    """doc_id, file, doc, start, n_tokens of every document, from flat files written for the purpose.

    A null text has no tokens; rows that repeat are counted each; a null id
    stays null; other columns are ignored.
    """
    files = write_token_files(docs, text_col, id_col, **writing)
    lists = files.where("doc_ids is not null").select("file", "block", "doc_ids")
    sums = lists.selectExpr("file", "block", "doc_ids", "coalesce(sum(size(doc_ids)) over (partition by file order by block rows between unbounded preceding and 1 preceding), 0) as b0")
    names = sums.select("file", "b0", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("b0") + F.col("i")).cast("long").alias("doc"), "doc_id")
    return names.join(count_tokens(files.where("data is not null"), writing.get("end_id", END_ID)), ["file", "doc"]).select("doc_id", "file", "doc", "start", "n_tokens")


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")
