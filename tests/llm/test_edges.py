"""Awkward rows: separators in texts, large ids beside nulls, extreme vectors, clashing columns; stages of the pipeline against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.llm import embedding_dedup, exact_dedup, language_id, ngram_join, ngram_trie, packing, piece_viterbi, suffix_dedup, token_counts, tokens, url_reputation

SF = "/root/testdata/sf0.001"
LARGE = 9007199254740993


def test_a_text_that_holds_the_special_token_shifts_no_count(spark):
    texts = ["one two three", "before <|endoftext|> after", "x y z w v", "last one here", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(docs, block_tokens=3).collect()}
    enc = tokens.ByteBpe()
    assert got == {i: len(enc.encode(t)) // 4 for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        token_counts.write_token_files(docs, end_id=70_000)
    with pytest.raises(Exception, match="separator"):
        token_counts.write_token_files(docs, end_id=50256).count()


def test_large_ids_beside_a_null_id(spark):
    docs = spark.createDataFrame([(LARGE, "a b c"), (None, "d e"), (3, "a b c")], "doc_id long, text string").coalesce(1)
    want = {LARGE, None, 3}
    assert {r.doc_id for r in ngram_trie.score_texts(docs, F.lit(True), order=3).collect()} == want
    assert {r.doc_id for r in token_counts.document_token_counts(docs).collect()} == want
    assert {r.doc_id for r in packing.pack_documents(docs).collect()} == want
    assert {r.doc_id for r in suffix_dedup.remove_repeats(docs).collect()} == want
    assert {r.doc_id for r in exact_dedup.exact_dedup(docs).collect()} == want
    assert {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs).collect()} == {LARGE: 3, 3: 3, None: None}


def test_vectors_of_any_size_are_compared(spark):
    rows = [(1, [1e200, 1e200]), (2, [3e200, 3e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1e308, -1e308]), (6, [0.0, 0.0]), (7, [1.0, float("inf")]), (8, [1.0, 1.0]), (8, [1.0, 1.0])]
    v = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(v).collect())
    assert got == [(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (4, 5, 1, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 5, 1, False), (8, 5, 1, False)]


def test_vector_components_equal_brute_force(spark):
    r = np.random.default_rng(17)
    x = r.standard_normal((300, 24))
    for k in range(100, 300):  # chains around the threshold
        x[k] = x[k - 100] + r.standard_normal(24) * r.choice([0.0, 0.05, 0.12, 0.2, 0.4])
    x[0] = 0
    x[0, :2] = 1, 0
    x[1] = 0
    x[1, :2] = 0.98, math.sqrt(1 - 0.98 * 0.98)  # a pair at the threshold
    v = spark.createDataFrame([(i + 1000, x[i].tolist(), 1) for i in range(300)], "vec_id long, embedding array<double>, label int")
    got = {q.vec_id: (q.n_links, q.component_id, q.kept) for q in embedding_dedup.near_vectors(v).collect()}
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    near = (x @ x.T / (norm[:, None] * norm) >= 0.98) & ~np.eye(300, dtype=bool)
    group = np.arange(300)
    while (low := np.minimum(group, np.where(near, group[None, :], 999).min(1))).tolist() != group.tolist():
        group = low
    want = {i + 1000: (int(near[i].sum()), int(group[i]) + 1000, bool(group[i] == i)) for i in range(300)}
    edge = {1000, 1001}  # whether the pair at 0.98 is at or below it is a matter of the last bit
    assert {k: v for k, v in got.items() if k not in edge} == {k: v for k, v in want.items() if k not in edge} and near.sum() > 60


def test_columns_with_internal_names_pass_through(spark):
    names = ["_said", "said", "row", "_n", "n", "s", "s2", "d", "d2", "_stay", "_own", "_drop", "_hash", "h", "t", "x", "key", "id"]
    docs = spark.createDataFrame([(i, t, "en", *range(len(names))) for i, t in enumerate(["some words of a text", "some words of a text", "other words"])], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    said = language_id.identify(docs, language_id.train_profiles(docs))
    assert said.columns == [*docs.columns, "lang_pred", "score"] and said.count() == 3
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]
    import corpus_pipeline as p

    for _, stage in p.STAGES[:4]:
        assert stage(spark, docs, SF).columns == docs.columns
    pieces = packing.token_pieces(docs, 8, "text", "doc_id").withColumn("rank", F.lit(1)).withColumn("salt", F.lit(2)).withColumn("row", F.lit(3))
    assert packing.assign(pieces, 8).where("rank = 1 and salt = 2 and row = 3").count() == pieces.count()
    assert ngram_join.similar_documents(docs).count() == ngram_trie.score_texts(docs, F.lit(True)).count() == suffix_dedup.remove_repeats(docs).count() == 3


def test_ranks_out_of_place_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = language_id.train_profiles(docs)
    for r in language_id.identify(docs, profiles).collect():
        c = "".join(ch if ch.isalpha() else " " for ch in (r.text or "").lower()).split()
        body = " " + " ".join(c) + " "
        grams = Counter(g for k in (1, 2, 3) for i in range(len(body) - k + 1) if (g := body[i : i + k]) not in (" ", "  "))
        if not c:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        code = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
        own = [code(g) for g in sorted(grams, key=lambda g: (-grams[g], code(g)))][:300]
        far = {}
        for lang, profile in profiles.items():
            place = {int(g): k for k, g in enumerate(profile)}
            far[lang] = sum(abs(place[g] - k) if g in place else 300 for k, g in enumerate(own))
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 - far[best] / (300 * len(own)))


def test_packing_past_best_fit():
    """Lengths around a third, where best fit leaves room that other fillings use: bins against the bound."""
    rnd = random.Random(8)
    gaps = []
    for _ in range(12):
        counts = Counter(rnd.randint(180, 520) for _ in range(300))
        least, plan = packing.lower_bound(counts, 1000), packing.pack_histogram(counts, 1000)
        used = Counter()
        for pattern, times in plan:
            assert sum(k * n for k, n in pattern) <= 1000
            used.update({k: n * times for k, n in pattern})
        assert used == counts
        best_fit = sum(t for _, t in packing.best_fit_decreasing(counts, 1000))
        gaps.append((best_fit - least, sum(t for _, t in plan) - least))
    assert all(b <= a for a, b in gaps)


def test_pieces_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.piece): r for r in packing.pack_documents(docs, 512).collect()}
    n = 0
    for d in docs.collect():
        ids = [*whole.encode(d.text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 512 + 1
        edges = [0, *range(first, len(ids) + 1, 512)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            r = got[d.doc_id, k]
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            n += 1
    assert n == len(got)


def test_the_window_commits_before_the_stream_ends():
    model = piece_viterbi.PieceModel(memo=50)
    text = "the quick brown fox " * 40
    body = piece_viterbi.SPACE + text.replace(" ", piece_viterbi.SPACE)
    read = 0

    def chars():
        nonlocal read
        for c in body:
            read += 1
            yield c

    out, early = [], 0
    for ids in model.stream(chars()):
        out += ids
        early += read < len(body)
    assert out == model.encode(text).tolist() and early > 3


def test_urls_without_rows_with_repeats_and_ties(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_reputation.judge_urls(none).count() == 0
    twice = spark.createDataFrame([(1, "http://a.com/de/x")] * 3 + [(None, None)] * 2, "page_id long, url string")
    assert Counter((r.page_id, r.rule, r.verdict) for r in url_reputation.judge_urls(twice).collect()) == {(1, "com/de/", "block"): 3, (None, None, "allow"): 2}
    rules = (("example.org", "/a", "allow"), ("example.org", "/ab", "block"), ("org", "/abc", "allow"))
    urls = spark.createDataFrame([(1, "x://example.org/abcd"), (2, "x://w.example.org/a?b"), (3, "x://other.org/abc"), (4, "x://notexample.org/ab")], "page_id long, url string")
    assert {r.page_id: r.rule for r in url_reputation.judge_urls(urls, rules).collect()} == {1: "example.org/ab", 2: "example.org/a", 3: "org/abc", 4: None}


def test_suffixes_come_from_a_table(spark):
    listed = spark.createDataFrame([("CO.zz",), ("co.zz",), ("zz",), (None,), ("a.b.c",)], "suffix string")
    assert url_reputation.two_label_suffixes(listed) == ("co.zz",)
    with pytest.raises(ValueError):
        url_reputation.two_label_suffixes(listed, most=0)
    urls = [f"http://x.bad.co.zz/de/{i}" for i in range(60)] + [f"http://y{i}.good{i}.co.zz/a" for i in range(9)] + ["http://z.bad.co.zz/a"]
    rules = (("bad.co.zz", "/de/", "block"), *((f"good{i}.co.zz", "/", "allow") for i in range(9)))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    judged = {r.page_id: r.verdict for r in url_reputation.judge_urls(pages, rules, two_label=("co.zz",)).collect()}
    assert judged[69] == "block" and judged[0] == "block" and judged[60] == "allow"


def test_pipeline_passages_and_packing(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    d = docs
    for name, stage in p.STAGES[:3]:
        d = p.written(stage(spark, d, SF), "test")
    before = {r.doc_id: (r.text or "").encode() for r in d.collect()}
    after = {r.doc_id: r for r in p.STAGES[3][1](spark, d, SF).collect()}
    size = p.PASSAGE_BYTES
    count = Counter(t[i : i + size] for t in before.values() for i in range(len(t) - size + 1))
    assert set(after) == set(before) and any(n > 1 for n in count.values())
    for k, t in before.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert after[k].text == kept and after[k].n_chars == len(kept)
    packed = p.run(spark, SF).collect()
    enc = tokens.ByteBpe()
    assert Counter(r.doc_id for r in packed).keys() == after.keys()
    assert sum(r.length for r in packed) == sum(len(enc.encode(r.text)) // 4 + 1 for r in after.values())


def test_op8_query_returns_the_kept_text(spark):
    import hashlib

    for r in suffix_dedup.op8_lyndon_suffix_dedup(spark, SF).collect():
        if r.n_removed == 0:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_a_long_text_of_one_byte_takes_time_in_proportion(spark):
    """Every window is an anchor of its own; comparing them in pairs takes minutes, a set seconds."""
    import time

    docs = spark.createDataFrame([(1, "a" * 120000), (1, "a" * 120000), (2, "b" * 399), (3, "a" * 400)], "doc_id long, text string")
    begin = time.monotonic()
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert time.monotonic() - begin < 90
    assert sorted(map(tuple, got)) == [(1, 120000, 120000, 1), (1, 120000, 120000, 1), (2, 399, 0, 0), (3, 400, 400, 1)]


def test_groups_of_heavy_edits_lose_no_link(spark):
    """Many documents of one template at similarities about the threshold, beside a passage that all of them and others hold."""
    rnd, passage = random.Random(12), " ".join(f"p{i}" for i in range(60))
    texts = {}
    for k in range(120):
        w = [f"t{i}" for i in range(150)]
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 9])):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(1, 3)] = [f"e{rnd.randrange(10**6)}"]
        texts[k] = " ".join(w) + " " + passage
    for k in range(200, 260):
        texts[k] = " ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(20, 300))) + " " + passage
    from tests.llm.test_operators import near_groups

    got = ngram_join.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == near_groups(texts)
