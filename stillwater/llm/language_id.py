"""Language ID by rank-order profiles.

Letters are kept and lower-cased, every other run becomes one blank, and
n-grams of 1 to 3 characters are counted.  A language's profile is its most
frequent n-grams by rank, and a document's distance to it is the sum of how far
each of the document's most frequent n-grams is out of place (an n-gram that
the profile lacks costs the profile's size).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return _LETTER


def top_ngrams(text: str | None, size: int) -> np.ndarray:
    """Codes of the most frequent n-grams of the whole text, most frequent first, ties by code; empty without letters.

    Three characters of 21 bits make a code, so no two n-grams share one.
    """
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    keep = _letters()[c]
    if not keep.any():
        return np.zeros(0, np.int64)
    c = np.where(keep, c, 32)
    c = np.concatenate(([32], c[keep | np.concatenate(([False], keep[:-1]))], np.full(int(keep[-1]), 32)))
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    codes, n = np.unique_counts(np.concatenate((c[c != 32], two[two != (32 << 21 | 32)], three)))
    if len(n) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        codes, n = codes[n >= least], n[n >= least]
    return codes[np.lexsort((codes, -n))][:size]


def train_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", size: int = 300, docs_per_lang: int = 400) -> dict[str, np.ndarray]:
    """language -> profile, from at most `docs_per_lang` documents of each language (those of lowest hashed id), whole texts.

    The bound is the fit's documented sample; languages must number fewer than 10,000.
    """
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col)).alias("h"))
    n = {r["l"]: r["n"] for r in named.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if len(n) >= 10_000:
        raise ValueError("too many languages for one set of profiles")
    if not n:
        return {}
    cut = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, -(2**63) + int(2**64 * min(1 - 2**-40, docs_per_lang / v)))])
    few = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).where(F.xxhash64(F.col(id_col)) <= cut[F.col(lang_col)])
    few = few.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"))

    def count(batches):
        for b in batches:
            rows = [(l, int(g), 1.0 / (r + 10)) for l, t in zip(b["l"], b["t"]) for r, g in enumerate(top_ngrams(t, size))]
            if rows:
                d = pd.DataFrame(rows, columns=["l", "g", "w"])
                yield d.groupby(["l", "g"], as_index=False)["w"].sum()

    sums = few.mapInPandas(count, "l string, g long, w double").groupBy("l", "g").agg(F.round(F.sum("w"), 6).alias("w"))
    ranked = sums.selectExpr("l", "g", "row_number() over (partition by l order by w desc, g) as r").where(F.col("r") <= size)
    out: dict[str, list] = {}
    for r in ranked.orderBy("l", "r").collect():  # `size` rows a language
        out.setdefault(r["l"], []).append(r["g"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def out_of_place(own: np.ndarray, profile: np.ndarray, size: int, order: np.ndarray | None = None) -> int:
    """Sum over a document's n-grams of how far each is from its rank in the profile; order: what sorts the profile, where it is known."""
    if len(profile) == 0:
        return size * len(own)
    order = np.argsort(profile) if order is None else order
    at = np.searchsorted(profile, own, sorter=order)
    place = order[np.minimum(at, len(profile) - 1)]
    there = profile[place] == own
    return int(np.where(there, np.abs(place - np.arange(len(own))), size).sum())


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", size: int = 300) -> DataFrame:
    """`docs` with lang_pred and score (1 - distance / largest possible distance, 0 to 1).

    Null, empty or letterless texts, and all texts if there are no profiles, are
    `und` with score 0.  Ties go to the first language by name.  Rows that repeat
    are judged each; other columns are kept unless they have the two new names.
    """
    names = sorted(profiles)
    orders = {k: np.argsort(profiles[k]) for k in names}

    def judge(texts: pd.Series) -> pd.DataFrame:
        pred, score = [], []
        for t in texts:
            own = top_ngrams(t if isinstance(t, str) else None, size)
            if len(own) == 0 or not names:
                pred.append("und")
                score.append(0.0)
                continue
            d = [out_of_place(own, profiles[k], size, orders[k]) for k in names]
            best = int(np.argmin(d))
            pred.append(names[best])
            score.append(1 - d[best] / (size * len(own)))
        return pd.DataFrame({"lang_pred": pred, "score": score})

    said = F.pandas_udf(judge, "lang_pred string, score double")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(F.struct(*kept).alias("row"), said(F.col(text_col)).alias("said")).select("row.*", "said.*")


def held_out(id_col: str, parts: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % parts == 0


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = train_profiles(docs.where(~held_out("doc_id", 5)))
    return identify(docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), "text"), profiles).drop("text")
