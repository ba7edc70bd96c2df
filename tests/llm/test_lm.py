import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from keystrata.llm import ngram_lm as L

TEXTS = ["the cat sat on the mat", "The cat sat", "a dog sat on the log", "", None, "the the the the", "cat dog", "unknown words only here", "a b c d e f g " * 30, "the cat\tsat on\nthe mat", "x " * 2000] + [f"the cat {i % 7} sat on mat {i % 5} and so on" for i in range(60)]


def brute(train, docs, order):
    words = lambda t: (t or "").encode().lower().split()
    c = [Counter() for _ in range(order + 1)]
    for t in train:
        w = ["<s>"] * (order - 1) + words(t) + ["</s>"]
        for i in range(order - 1, len(w)):
            c[order][tuple(w[i - order + 1 : i + 1])] += 1
    raw = Counter()
    for g, n in c[order].items():
        raw[g[-1]] += n
    for k in range(order - 1, 0, -1):
        for g in c[k + 1]:
            c[k][g[1:]] += 1
    ctx = [defaultdict(lambda: [0, 0, 0, 0]) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in c[k].items():
            ctx[k][g[:-1]][0] += n
            ctx[k][g[:-1]][min(n, 3)] += 1
    ds = [None] + [L.discounts(*(Counter(c[k].values())[j] for j in (1, 2, 3, 4))) for k in range(1, order + 1)]
    v, total = len(raw), sum(raw.values())

    def p(g):
        lower = 1 / (v + 1) if len(g) == 1 else p(g[1:])
        t, *n = ctx[len(g)][g[:-1]]
        if not t:
            return lower
        x = c[len(g)][g]
        return (max(x - (0, *ds[len(g)])[min(x, 3)], 0) + sum(a * b for a, b in zip(ds[len(g)], n)) * lower) / t

    out = {}
    for i, t in docs:
        w = ["<s>"] * (order - 1) + words(t) + ["</s>"]
        own = range(order - 1, len(w))
        out[i] = (len(own), sum(raw[w[j]] > 0 for j in own), total, sum(math.log10((raw[w[j]] + 0.1) / (total + 0.1 * (v + 1))) for j in own), sum(math.log10(p(tuple(w[j - order + 1 : j + 1]))) for j in own))
    return out, p, raw


@pytest.mark.parametrize("order,stretch,buckets", [(1, 2_000_000, None), (2, 2_000_000, None), (2, 50, 40), (3, 200, 7), (3, 2_000_000, 60)])
def test_against_brute_force(docs_of, monkeypatch, order, stretch, buckets):
    """With many buckets most words are hot, with few hardly any."""
    monkeypatch.setattr(L, "STRETCH", stretch)
    docs = docs_of(TEXTS, clash=["score"])
    train = docs.where(~L.held_out("doc_id"))
    kept = [t for i, t in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 10]
    got = L.score_documents(docs, L.train(train.select("text"), order, buckets)).collect()
    want, p, raw = brute(kept, list(enumerate(TEXTS)), order)
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], abs=1e-7) and r.score == pytest.approx(want[r.doc_id][4], abs=1e-7)
    assert sum(p((w,)) for w in [*raw, "<never>"]) == pytest.approx(1)


def test_no_training_rows(docs_of):
    docs = docs_of(["a b", None])
    got = L.score_documents(docs, L.train(docs.where("doc_id < 0").select("text"))).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.score) for r in got} == {(0, 3, 0, 0.0), (1, 1, 0, 0.0)}
    assert L.score_documents(docs.where("doc_id < 0"), L.train(docs.select("text"))).count() == 0


def test_null_and_repeated_ids(docs_of):
    docs = docs_of([(None, "a"), (1, "a"), (1, "a")])
    got = L.score_documents(docs, L.train(docs.where(~L.held_out("doc_id")).select("text"))).collect()
    assert len(got) == 3 and len({round(r.score, 9) for r in got}) == 1


def test_hot_words_and_the_shared_folder(docs_of, monkeypatch):
    texts = docs_of(["the cat the dog", "the end"]).select("text")
    hot = L.hot_words(texts, 1)
    the = L.scattered(L.word_hashes().array([b"the"]))[0]
    assert set(hot) == {the, L.scattered(np.array([L.BEGIN]))[0]} and L.is_hot(np.array([the, the + np.uint64(1)]), hot).tolist() == [True, False]
    monkeypatch.setattr(L, "fresh_path", lambda spark, label: "s3://bucket/lm")
    with pytest.raises(ValueError, match="mount"):
        L.train(texts)


def test_a_very_long_text(docs_of):
    long = " ".join(f"w{i % 1000}" for i in range(300_000))
    docs = docs_of([(1, long), (2, "w1 w2"), (3, None)])
    got = {r.doc_id: r for r in L.score_documents(docs, L.train(docs.select("text"))).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[2].n_tokens, got[3].n_tokens) == (300_001, 300_001, 3, 1)


def test_counts_beyond_a_byte_and_blocks():
    counts = np.array([1, 254, 255, 70_000])
    cols = [np.arange(4, dtype=np.uint64), np.arange(4, dtype=np.uint64) << np.uint64(30)]
    for c in (cols, cols[:1]):
        back, n = L.unpacked(L.packed(c, counts), len(c))
        assert all((a == b).all() for a, b in zip(back, c)) and (n == counts).all()
    assert (L.pack_counts(np.array([256], dtype=np.uint64), np.array([300])) & np.uint64(255))[0] == 255


def test_known_texts_score_better(docs_of):
    docs = docs_of(TEXTS)
    m = L.train(docs.select("text"))
    r = {x.doc_id: x for x in L.perplexity(L.score_documents(docs_of(["the cat sat on the mat", "mat the on sat cat the"]), m)).collect()}
    assert r[0].perplexity < r[1].perplexity


def test_store_in_other_file_systems(tmp_path, monkeypatch):
    from keystrata.llm import common

    monkeypatch.setattr(common, "local_path", lambda uri: None)
    common.store(f"file://{tmp_path}/a/b.words", b"12345678")
    assert (tmp_path / "a/b.words").read_bytes() == b"12345678" and len(list((tmp_path / "a").iterdir())) == 1
