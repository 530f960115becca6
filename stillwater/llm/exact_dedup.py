"""Exact dedup by deterministic block naming (DataFrame operations only).

Texts are normalised (each run of ASCII white space becomes one space) and cut
into fixed-size blocks.  Distinct blocks are sorted and numbered, so every
block has an integer name; adjacent pairs of names are numbered again, level by
level, until each document has one name.  Names are equal exactly when the
blocks are equal: no hash decides.  (A 64-bit hash only carries the naming back
to the blocks; hashes that two different blocks share are found when the
distinct blocks are numbered, and those blocks are joined by their bytes.)

Cost: one shuffle of distinct block bytes, pre-aggregated before it, so that a
block that a third of all rows hold leaves each map task once; all else moves
names.  Levels end after log2(blocks of the longest text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(col) -> F.Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACE_RUN, " ")


def _blocks(docs: DataFrame, text_col: str, id_col: str, size: int) -> DataFrame:
    body = docs.select(F.col(id_col).alias("d"), normalised(F.col(text_col)).alias("t"))
    body = body.select("d", F.unhex(F.sha2("t", 256)).alias("s"), F.col("t").cast("binary").alias("t"))
    last = F.greatest(F.lit(0), F.ceil(F.length("t") / F.lit(size)).cast("int") - 1)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("t", i * size + 1, F.lit(size)))
    return body.select("d", "s", F.posexplode(cut).alias("p", "block")).withColumn("h", F.xxhash64("block"))


def _ranked(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number distinct rows: sorted inside each shuffle partition, so a task that runs again gives the same numbers."""
    return distinct.sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def block_names(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = 2048) -> DataFrame:
    """(d, s, level, name): one row per distinct (id, text); (level, name) is the text's collision-free identity.

    s: SHA-256 of the normalised text (it tells rows apart that share an id; it decides no equality of texts).
    """
    blocks = _blocks(docs, text_col, id_col, block_bytes)
    names = written(_ranked(blocks.groupBy("h", "block").agg(F.lit(1).alias("one")), ["h", "block"], "name").select("h", "name"), "names")
    shared = names.groupBy("h").count().where("count > 1").select("h")
    spots = blocks.select("d", "s", "p", "h")
    now = spots.join(names.join(shared, "h", "left_anti"), "h").select("d", "s", "p", "name")
    if not shared.isEmpty():  # 64-bit hashes that two different blocks share: by bytes, numbered below zero
        odd = blocks.join(shared, "h", "left_semi")
        named = written(_ranked(odd.groupBy("block").agg(F.lit(1).alias("one")), ["block"], "k").select("block", (-F.col("k") - 1).alias("name")), "names")
        now = now.unionByName(odd.join(named, "block").select("d", "s", "p", "name"))
    done, level = None, 0
    now = written(now.groupBy("d", "s", F.shiftright("p", 1).alias("q")).agg(F.max(F.when(F.col("p") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("p") % 2 == 1, F.col("name"))).alias("b")), "pairs")
    while True:
        # one row per pair of adjacent names; b is null for the last of an odd number
        more = now.where("q > 0 or b is not null").select("d", "s").distinct()
        single = now.join(more, [now.d.eqNullSafe(more.d), now.s == more.s], "left_anti")
        single = single.select("d", "s", F.lit(level).alias("level"), F.col("a").alias("name"))
        done = single if done is None else done.unionByName(single)
        rest = now.join(more, [now.d.eqNullSafe(more.d), now.s == more.s], "left_semi")
        named = written(_ranked(rest.groupBy("a", "b").agg(F.lit(1).alias("one")), ["a", "b"], "name").select("a", "b", "name"), "names")
        if named.isEmpty():
            return done
        level += 1
        up = rest.join(named, [rest.a == named.a, rest.b.eqNullSafe(named.b)]).select("d", "s", F.col("q").alias("p"), "name")
        now = written(up.groupBy("d", "s", F.shiftright("p", 1).alias("q")).agg(F.max(F.when(F.col("p") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("p") % 2 == 1, F.col("name"))).alias("b")), "pairs")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = 2048) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty.  A row with a null id is a member of its group
    but never its keep_id unless all ids are null (then keep_id is null).  Rows
    that repeat an id and a text each count in group_size and each get a row.
    Other columns of `docs` are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("d"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("s")).groupBy("d", "s").agg(F.count("*").alias("n"))
    ident = written(block_names(docs, text_col, id_col, block_bytes), "identity")
    ident = ident.withColumnsRenamed({"d": "d2", "s": "s2"})
    held = written(rows.join(ident, [rows.d.eqNullSafe(ident.d2), rows.s == ident.s2]).select("d", "s", "n", "level", "name"), "held")
    groups = held.groupBy("level", "name").agg(F.min("d").alias("keep_id"), F.sum("n").alias("group_size"))
    out = held.join(groups, ["level", "name"])
    out = out.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select(F.col("d").alias("doc_id"), "keep_id", "group_size", F.col("d").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"))


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay; of rows that repeat an id and a text, one.  Columns stay as they are, whatever their names."""
    stay = exact_dedup(docs, text_col, id_col).where("kept").groupBy(F.col("doc_id").alias("d2"), F.col("text_sha256").alias("s2")).agg(F.count("*").alias("n"))
    # a row travels as one struct, so its columns meet no name of ours; the id alone does not say which text stays
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("d"), F.sha2(normalised(F.col(text_col)), 256).alias("s"))
    marked = own.join(stay, F.col("d").eqNullSafe(F.col("d2")) & (F.col("s") == F.col("s2")))
    return marked.where("n = 1").select("row").unionByName(marked.where("n > 1").dropDuplicates(["d", "s"]).select("row")).select("row.*")


def op5_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
