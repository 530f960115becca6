"""The training-data operators against brute force, on small and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillwater.llm import embedding_dedup, exact_dedup, language_id, lyndon_suffix, ngram_join, ngram_trie, packing, piece_viterbi, suffix_dedup, token_counts, tokens, url_reputation

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b  c", "x"), (2, "a b\tc", None), (3, None, "y"), (4, "", "z"), (None, "a b c", "x"), (5, "ÄÖ é\n\n 123", "x"), (5, "ÄÖ é\n\n 123", "x"), (6, "w " * 6000, "q"), (7, " ", None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, blanks, a long text and a column whose name clashes with results and internals."""
    return spark.createDataFrame([(a, b, c, 0, "k") for a, b, c in ODD], "doc_id long, text string, lang string, d int, key string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_exact_dedup(spark, oracle, same, odd, none):
    same(exact_dedup.op5_block_naming_dedup(spark, SF).toPandas(), oracle(exact_dedup.OP5_SQL, SF))
    got = exact_dedup.exact_dedup(odd, block_bytes=4).toPandas()
    assert len(got) == len(ODD)
    g = got.set_index("doc_id")
    assert g.loc[2, "keep_id"] == 1 and g.loc[1, "group_size"] == 3 and g.loc[3, "keep_id"] == 3 and g.loc[4, "keep_id"] == 3
    assert exact_dedup.exact_dedup(none).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.keep_first(odd).collect()) == [1, 3, 5, 6, 7]


def test_url_reputation(spark, oracle, same):
    same(url_reputation.op2_host_reputation(spark, SF).toPandas(), oracle(url_reputation.OP2_SQL, SF))
    urls = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x?q#z"), (4, "x://"), (5, "http://b.com?fr"), (None, "http://b.com/fr/1")]
    got = {r.page_id: r for r in url_reputation.judge_urls(spark.createDataFrame([(*u, "h") for u in urls], "page_id long, url string, host string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None)
    assert (got[3].host, got[3].rule, got[3].verdict) == ("a.example.org", "example.org/es/", "block")
    assert got[None].verdict == "allow" and len(got) == 6
    bad = spark.createDataFrame([("s.evil.net", 1)] * 50 + [("ok.good.net", 0)] * 50, "host string, bad int")
    rep = {r.host: r for r in url_reputation.host_reputation(bad).collect()}
    assert rep["s.evil.net"].lower > 0.5 > rep["ok.good.net"].upper


def test_language_id(spark, odd, none):
    got = language_id.op3_rank_order_language(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.95
    profiles = language_id.train_profiles(odd)
    said = language_id.identify(odd, profiles).toPandas()
    assert len(said) == len(ODD) and (said[said.text.isna() | (said.text == "")].lang_pred == "und").all()
    assert language_id.identify(none, {}).count() == 0 and (language_id.identify(odd, {}).toPandas().lang_pred == "und").all()


def test_token_counts(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    enc = tokens.ByteBpe()
    want = {r.doc_id: len(enc.encode(r.text)) // 4 for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(docs, block_tokens=97).collect()} == want
    assert token_counts.document_token_counts(odd).count() == len(ODD) and token_counts.document_token_counts(none).count() == 0
    flat = np.array([5, 9, 9, 1, 2, 3, 9, 4], "<u2")
    blocks = spark.createDataFrame([(0, i, flat[i * 3 : i * 3 + 3].tobytes()) for i in range(3)], "file long, block long, data binary")
    assert sorted((r.start, r.n_tokens) for r in token_counts.count_tokens(blocks, end_id=9).collect()) == [(0, 1), (2, 0), (3, 3), (7, 1)]


def test_fast_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, fast, rnd = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.ByteBpe(), random.Random(1)
    for _ in range(400):
        t = "".join(rnd.choice(["a", "Bc", " ", "  ", "\n", "\t", "é", "7", "'s", "!?", "\xa0", "　", "\x1d", "<|endoftext|>"]) for _ in range(rnd.randint(0, 12)))
        assert fast.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_packing(spark, odd, none):
    rnd = random.Random(2)

    def best(items, cap):
        bins = len(items)

        def put(i, rooms):
            nonlocal bins
            if len(rooms) >= bins:
                return
            if i == len(items):
                bins = len(rooms)
                return
            for k in sorted({r for r in rooms if r >= items[i]}):
                j = rooms.index(k)
                put(i + 1, [*rooms[:j], k - items[i], *rooms[j + 1 :]])
            put(i + 1, [*rooms, cap - items[i]])

        put(0, [])
        return bins

    for _ in range(40):
        items = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))), reverse=True)
        plan = packing.pack_histogram(Counter(items), 20)
        assert sum(t for _, t in plan) == best(items, 20)
        used = Counter()
        for pattern, times in plan:
            assert sum(k * n for k, n in pattern) <= 20
            used.update({k: n * times for k, n in pattern})
        assert used == Counter(items)
    got = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack_documents(odd, capacity=64).select("doc_id").distinct().count() == 8 and packing.pack_documents(none).count() == 0


def test_piece_viterbi(odd):
    model, rnd = piece_viterbi.PieceModel(), random.Random(3)
    for _ in range(150):
        t = "".join(rnd.choice(["the", " ", "  ", "\n", "on", "é", "😀", "xyz", "9"]) for _ in range(rnd.randint(0, 30)))
        s = piece_viterbi.SPACE + t.replace(" ", piece_viterbi.SPACE) if t else ""
        best, back = [0.0], [0]
        for n in range(1, len(s) + 1):
            top, frm = best[n - 1] + model.penalty, n - 1
            for k in range(n):
                i = model.ids.get(s[k:n])
                if i is not None and (best[k] + model.scores[i] > top or (best[k] + model.scores[i] == top and k <= frm)):
                    top, frm = best[k] + model.scores[i], k
            best.append(top), back.append(frm)
        want = model._path(s, back, len(s))
        assert model.encode(t).tolist() == want == [i for ids in model.stream(s) for i in ids]
        assert model.decode(want) == t
    both = piece_viterbi.decode_pieces(piece_viterbi.encode_pieces(odd)).toPandas()
    assert (both.decoded == both.text.fillna("")).all()


def test_trie_scores(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    got = ngram_trie.score_texts(docs, train, shards=3, block_bytes=60_000).toPandas().set_index("doc_id")
    toks = {r.doc_id: [*words(r.text), "\0"] for r in docs.collect()}
    learn = {k for k in toks if zlib.crc32(str(k).encode()) % 10}
    c = Counter(w for k in learn for w in toks[k])
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for k in learn for p in zip(["^", *toks[k]], toks[k]))
    total, kinds = Counter(), Counter()
    for (a, _), m in pairs.items():
        total[a] += m
        kinds[a] += 1
    unk = sum(m == 1 for m in c.values()) / (n + 1)
    for k, ws in toks.items():
        assert got.loc[k, "n_known"] == sum(c[w] > 0 for w in ws) and got.loc[k, "train_tokens"] == n
        assert got.loc[k, "base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        s = 0.0
        for a, w in zip(["^", *ws], ws):
            p = (1 - unk) * c[w] / n if c[w] else unk
            s += math.log10(max(pairs[a, w] - 0.95, 0) / total[a] + 0.95 * kinds[a] / total[a] * p if total[a] else p)
        assert got.loc[k, "score"] == pytest.approx(s, rel=0.02)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert ngram_trie.score_texts(odd, F.lit(True), order=3).count() == len(ODD) and ngram_trie.score_texts(none, F.lit(True)).count() == 0


def near_groups(texts, percent=80):
    sets = {k: ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())) for k, w in ((k, words(t)) for k, t in texts.items())}
    root = {k: k for k in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(sorted(texts), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_ngram_join(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rnd, base = random.Random(4), [f"w{i}" for i in range(120)]
    for k in range(60):  # chains of edits around the threshold
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(9)}"
        texts[10_000 + k] = " ".join(w[: rnd.choice([120, 118, 100, 4])])
    got = ngram_join.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == near_groups(texts)
    assert ngram_join.similar_documents(odd).count() == len(ODD) and ngram_join.similar_documents(none).count() == 0


def test_lyndon_suffix_array():
    rnd = random.Random(5)
    for _ in range(500):
        s = [rnd.randint(1, rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 40))] + [0]
        assert lyndon_suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("block", [4000, 3])
def test_suffix_dedup(spark, odd, none, block):
    rnd, length = random.Random(6), 40
    parts = ["ab", "the", "xxxxx", "lorem ipsum dolor sit amet consectetur adipiscing elit", "a" * 50, "of é"]
    texts = {k: " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for k in range(50)} | {90: None}
    raw = {k: (t or "").encode() for k, t in texts.items()}
    count = Counter(t[i : i + length] for t in raw.values() for i in range(len(t) - length + 1))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), length, block=block).toPandas().set_index("doc_id")
    for k, t in raw.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (got.loc[k, "n_removed"], got.loc[k, "kept_sha256"]) == (gone.sum(), hashlib.sha256(kept).hexdigest())
        assert got.loc[k, "n_spans"] == gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()
    assert suffix_dedup.remove_repeats(odd).count() == len(ODD) and suffix_dedup.remove_repeats(none).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(7)
    x = r.standard_normal((400, 16))
    x[200:] = x[:200] + r.standard_normal((200, 16)) * 0.03 * r.integers(0, 8, (200, 1))
    label = r.integers(0, 2, 400)
    label[200:] = label[:200]
    rows = [(i, x[i].astype(np.float32).tolist(), int(label[i])) for i in range(400)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, rows[0][1], None), (905, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2])]
    v = spark.createDataFrame([(*q, 1) for q in rows], "vec_id long, embedding array<float>, label int, e int")
    got = embedding_dedup.near_vectors(v, cell=60, block=50).toPandas()
    assert len(got) == len(rows)
    y = np.array([q[1] for q in rows[:400]] + [rows[0][1]], np.float64)
    lab = np.array([*label, rows[0][2]])
    y /= np.sqrt((y * y).sum(1))[:, None]
    want = ((y @ y.T >= 0.98) & (lab[:, None] == lab)).sum(1) - 1
    g = got.dropna(subset=["vec_id"]).set_index("vec_id").n_links
    found = g.loc[[*range(400), 905]].to_numpy()
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum() and want.sum() > 50
    assert (g.loc[[900, 901, 902, 903, 904]] == 0).all()
    assert embedding_dedup.near_vectors(v.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, d = [], docs
    for name, stage in p.STAGES[:3]:
        d = p.written(stage(spark, d, SF), "test")
        names.append(d.columns)
        assert d.count() > 0
    assert all(n == docs.columns for n in names)
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id for r in d.collect()}
    groups = near_groups(texts)
    assert len({groups[k][1] for k in left}) == len(left)  # one of each group of near copies


def test_short_parts_get_the_streamed_ids():
    """The forward lattice and the word memo give what the stream gives, blanks, line ends and uncovered characters included."""
    import random

    from stillwater.llm.piece_viterbi import SPACE, PieceModel

    model, dice = PieceModel(memo=50), random.Random(11)
    texts = ["", " a", " ", "\n", "a\n", "\na", " \n a", "a  b", "a \nb", "x" * 3000, "漢字 é" * 5]
    texts += ["".join(dice.choice(" \n" + SPACE + "aetnos漢é") for _ in range(dice.randrange(40))) for _ in range(800)]
    for text in texts:
        parts = model.parts.findall(SPACE + text.replace(" ", SPACE)) if text else []
        assert model.encode(text).tolist() == [i for part in parts for ids in model.stream(part) for i in ids]
        assert SPACE in text or model.decode(model.encode(text)) == text


def test_packing_search_reaches_a_leaf_past_many_lengths():
    """2,200 bins of two lengths that fill each other, then six items that best fit puts in three bins and that fill two."""
    counts = Counter({k: 1 for a in range(20_001, 22_201) for k in (a, 40_000 - a)}) + Counter({16_000: 2, 12_000: 4})
    assert sum(t for _, t in packing.best_fit_decreasing(counts, 40_000)) == 2203
    assert sum(t for _, t in packing.pack_histogram(counts, 40_000)) == 2202


def test_registered_trie_scores_trigrams(spark):
    texts = {r.doc_id: [*words(r.text), "\0"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    learn = [ws for k, ws in texts.items() if zlib.crc32(str(k).encode()) % 10]
    one = Counter(w for ws in learn for w in ws)
    n = sum(one.values())
    unk = sum(m == 1 for m in one.values()) / (n + 1)
    grams = {m: Counter(g for ws in learn for g in zip(*[["^"] * (m - 1 - k) + ws for k in range(m)])) for m in (2, 3)}
    total, kinds = Counter(), Counter()
    for c in grams.values():
        for g, m in c.items():
            total[g[:-1]] += m
            kinds[g[:-1]] += 1
    got = ngram_trie.op1_elias_fano_trie(spark, SF).toPandas().set_index("doc_id").score
    for k, ws in texts.items():
        s = 0.0
        for a, b, w in zip(["^", "^", *ws], ["^", *ws], ws):
            p = (1 - unk) * one[w] / n if one[w] else unk
            for g in ((b, w), (a, b, w)):
                if total[g[:-1]]:
                    p = max(grams[len(g)][g] - 0.95, 0) / total[g[:-1]] + 0.95 * kinds[g[:-1]] / total[g[:-1]] * p
            s += math.log10(p)
        assert got[k] == pytest.approx(s, rel=0.02)


def test_unlabelled_hosts_are_judged_by_their_parents_prior(spark, oracle, same):
    urls = [f"http://a.evil.com/de/{i}" for i in range(50)] + [f"http://ok{i % 9}.net/x" for i in range(9)] + ["http://b.evil.com/x", "http://new.com/x", "http://x.zz/", "no url", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    got = {u: r.verdict for u, r in zip(urls, sorted(url_reputation.judge_urls(pages).collect(), key=lambda r: r.page_id))}
    assert got["http://b.evil.com/x"] == "block" and got["no url"] == got[None] == "allow"
    bad = [("s.evil.net", 1)] * 50 + [("t.evil.net", 1)] * 40 + [("ok.good.net", 0)] * 50 + [("a.b.org", 0)] * 5
    outcomes = spark.createDataFrame(bad, "host string, bad int")
    others = spark.createDataFrame([("new.evil.net",), ("s.evil.net",), ("a.fresh.net",), ("a.b.zz",), (None,)], "host string")
    plain = {r.host: r for r in url_reputation.host_reputation(outcomes).collect()}
    both = {r.host: r for r in url_reputation.host_reputation(outcomes, others=others).collect()}
    assert len(both) == len(plain) + 3 and all(both[h] == r for h, r in plain.items())
    # net: 90 of 140 bad, org 0 of 5; rates of suffixes and domains give the priors' weights
    whole, rates = 90.5 / 146, (90 / 140, 0.0)
    w = max(whole * (1 - whole) / np.var(rates) - 1, 1.0)
    net = (90 + w * whole) / (140 + w)
    v = max(net * (1 - net) / np.var([1.0, 0.0]) - 1, 1.0)
    assert both["a.b.zz"].mean == pytest.approx(whole) and both["a.fresh.net"].mean == pytest.approx(net)
    assert both["new.evil.net"].mean == pytest.approx((90 + v * net) / (90 + v)) and both["new.evil.net"].n == 0
    assert url_reputation.host_reputation(outcomes.where("false"), others=others).where("mean is not null or lower > 0 or upper < 1").count() == 0


def test_keep_first_keeps_each_text_of_a_shared_id(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (None, "c"), (None, "d"), (None, "d"), (None, "a"), (3, "e"), (3, "a"), (4, None), (4, "")]
    got = exact_dedup.keep_first(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int"))
    assert got.columns == ["doc_id", "text", "n"]
    assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in got.collect()) == [(0, "c"), (0, "d"), (1, "a"), (1, "b"), (3, "e"), (4, "")]


@pytest.mark.parametrize("order", [2, 3])
def test_words_that_share_a_trie_key_are_counted_apart(spark, order):
    import pyarrow as pa

    names = [f"w{i}" for i in range(400_000)]
    h = np.asarray(ngram_trie.words(pa.array([" ".join(names)]))[3], np.uint64) & np.uint64(0xFFFFFFFF)
    at = np.argsort(h, kind="stable")
    k = np.flatnonzero(h[at][1:] == h[at][:-1])[0]
    a, b = names[at[k]], names[at[k + 1]]
    for x, y in ((a, b), (b, a)):
        docs = spark.createDataFrame([(1, f"the {x}"), (2, f"z q the {y} end")], "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r for r in ngram_trie.score_texts(docs, F.col("doc_id") == 1, order=order).collect()}
        assert (got[1].n_known, got[2].n_known) == (3, 2)
        seen, new = math.log10(1.1 / 3.4), math.log10(0.1 / 3.4)
        assert got[1].base_score == pytest.approx(3 * seen) and got[2].base_score == pytest.approx(2 * seen + 4 * new)


def test_variants_that_do_not_link_make_few_pairs(spark, monkeypatch):
    """Documents at a similarity of 0.7 share many keys; the whole sketch refuses their pairs where the keys meet, and a folded one did not."""
    rng = np.random.default_rng(7)
    base, rows = [f"w{k}" for k in rng.integers(0, 10**9, 400)], []
    for i in range(60):
        words = list(base)
        for k in rng.choice(80, 7, replace=False):
            words[5 * k + 2] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    made, write = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: made.append((name, write(df, name))) or made[-1][1])
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [{tuple(t.split()[k : k + 5]) for k in range(396)} for _, t in rows]
    parent = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if x in (a, b) else x for x in parent]
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(parent)) and len(set(parent)) > 40
    assert sum(f.count() for name, f in made if name == "cross") < 100  # of 1770 pairs
