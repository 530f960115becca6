"""A training corpus from `documents`: language, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.llm.common import table, written
from stillwater.llm.exact_dedup import keep_first
from stillwater.llm.language_id import identify, train_profiles
from stillwater.llm.ngram_join import similar_documents
from stillwater.llm.packing import pack_documents
from stillwater.llm.suffix_dedup import remove_repeats

#: Documents whose best profile is further away than this are no text of a known language.
LEAST_LANGUAGE_SCORE = 0.2

#: Bytes of a repeated string that is cut.  A passage of over 50 words has about 285 bytes, so it holds one.
PASSAGE_BYTES = 250


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every language's profile, go."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    said = identify(rows, train_profiles(docs))
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    drop = similar_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.alias("d").join(drop.alias("x"), F.col("d.doc_id") == F.col("x.doc_id"), "left_anti")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE_BYTES that repeat are cut from the texts; a text that is nothing else becomes empty."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = remove_repeats(docs, PASSAGE_BYTES, carry=others)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return cut.select(*[own.get(c, F.col(f"carried.{c}")) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("suffix-array dedup", passages), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
