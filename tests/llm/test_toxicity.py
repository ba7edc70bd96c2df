import math
import random
import re
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest

from keystrata.llm import toxicity as T
from keystrata.llm.common import give_back

rng = random.Random(4)
VOCAB = [f"word{i}" for i in range(400)]
INSULTS = ["blargh", "snork", "zibble"]


def sample(n):
    out = []
    for i in range(n):
        w = [rng.choice(VOCAB) for _ in range(rng.choice([5, 60, 900]))]
        toxic = i % 4 == 0
        if toxic:
            for x in rng.sample(INSULTS, 2):
                w.insert(rng.randrange(len(w)), x)
        out.append((i, " ".join(w), int(toxic)))
    return out


@pytest.fixture(scope="module")
def rows():
    return sample(900)


def test_held_out_accuracy(spark, docs_of, rows):
    docs = docs_of([(i, t) for i, t, _ in rows] + [(5000, ""), (5001, None), (5002, "blargh zibble " + "word1 " * 100_000)], clash=["score"])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5001, None), (9999, 1)], "doc_id long, toxic int")
    m = T.train(docs, labels)
    got = {r.doc_id: r.score for r in T.score_documents(docs, m).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, y in held]) > 0.97
    assert got[5000] == got[5001] < 0.5 and got[5002] >= 0.7 and all(0 <= s <= 1 for s in got.values())
    left = T.without_toxic(docs, m)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, s in got.items() if s < 0.7}


def test_labels_and_other_columns_do_not_reach_scores(spark, docs_of, rows):
    docs = docs_of([(i, t) for i, t, _ in rows[:300]])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]], "doc_id long, toxic int")
    m = T.train(docs, labels)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    n = T.train(docs.repartition(5), flipped)
    assert m.bias == n.bias and (m.w == n.w).all() and (m.v == n.v).all()


def test_pairs_count(spark):
    """Neither word alone is toxic; both together are."""
    base = [("a1 x", 0), ("b1 y", 0), ("a1 b1", 1), ("x y", 0)]
    slots = T.Slots()
    data = [(T.terms(" ".join(f"{t} n{k % 3}" for _ in range(1)), slots).tobytes(), y) for k in range(400) for t, y in base]
    old = T.L1
    T.L1 = 0.1
    try:
        m = T.fit(data, epochs=16)
    finally:
        T.L1 = old
    s = m.score([t for t, _ in base])
    assert s[2] > max(s[0], s[1], s[3])
    assert np.abs(m.v).sum() > 0


def test_pairs_of_terms_without_a_weight_count():
    """Every term is as frequent in toxic as in clean texts, so that only pairs tell them apart; with the L1 of production."""
    base = [("grp ins", 1), ("xx yy", 1), ("ins xx", 0), ("grp yy", 0)]
    slots = T.Slots()
    m = T.fit([(T.terms(f"{t} n{k % 3}", slots).tobytes(), y) for k in range(400) for t, y in base])
    own = [T.slot_of(x, 1) for x in (b"grp", b"ins")]
    assert m.v[own].any(axis=1).all() and np.isin(own, m.compact().live).all()
    s = m.score([t for t, _ in base])
    assert min(s[:2]) > 0.9 and max(s[2:]) < 0.1


def test_learns_from_all_of_a_long_text(spark, docs_of):
    """The one toxic sentence of a text of 20,000 words, wherever it stands, is what makes it toxic."""
    r = random.Random(7)
    docs, labels = [], []
    for i in range(240):
        w = [r.choice(VOCAB) for _ in range(20_000 if i % 4 == 0 else 40)]
        if i % 4 == 0:
            w[1000:1001] = ["zibble"] * 3
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    m = T.train(docs_of(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert m.w[T.slot_of(b"zibble", 1)] > 0


def test_logits_are_the_sum_over_pairs():
    r = np.random.default_rng(0)
    m = T.Machine(0.3, r.normal(size=T.BUCKETS), r.normal(size=(T.BUCKETS, T.FACTORS)))
    row = np.array([3, 17, 99])
    want = 0.3 + m.w[row].sum() + sum(m.v[a] @ m.v[b] for i, a in enumerate(row) for b in row[i + 1 :])
    assert m.logits([row, row[:0]]) == pytest.approx([want, 0.3])


def test_no_labels_and_empty_table(spark, docs_of):
    docs = docs_of(["some text", "more"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = T.train(docs, none)
    assert {r.score for r in T.score_documents(docs, m).collect()} == {0.5}
    assert T.score_documents(docs.where("doc_id < 0"), m).count() == 0


def plain_score(m, text):
    """The most toxic window's probability, term by term and pair by pair."""
    words = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
    words = [w.lower() for w in words]
    cuts = [words] if len(words) <= T.WINDOW else [words[a : a + T.WINDOW] for a in range(0, len(words) - T.WINDOW // 2, T.WINDOW // 2)]
    best = -math.inf
    for w in cuts:
        own = sorted({T.slot_of(x, 1) for x in w} | {T.slot_of(x[: T.PREFIX], 2) for x in w})
        own = [s for s in own if m.w[s] or m.v[s].any()]
        best = max(best, m.bias + sum(m.w[s] for s in own) + sum(m.v[a] @ m.v[b] for i, a in enumerate(own) for b in own[i + 1 :]))
    return 1 / (1 + math.exp(-best))


def test_registered_query_against_brute_force(spark):
    from keystrata.llm.queries import op8_toxicity

    from ..conftest import SF

    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    m = T.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op8_toxicity(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(plain_score(m, texts[r.doc_id]), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


def test_first_step_against_plain_arithmetic():
    """One batch, weights and vectors at once: the weights by follow-the-regularised-leader, the vectors by gradients of all
    pairs, those of terms without a weight shrunk."""
    slots, r = T.Slots(), random.Random(3)
    texts = [(" ".join(r.choice(["bad", "worse", "good", "fine", "so"]) for _ in range(3)), i % 2) for i in range(20)]
    old, T.L1 = T.L1, 1.5
    try:
        m = T.fit([(T.terms(t, slots).tobytes(), y) for t, y in texts], seed=8, epochs=1, batch=99, rate=0.05)
    finally:
        T.L1 = old
    sets = [sorted({s for w in t.encode().split() for s in (T.slot_of(w, 1), T.slot_of(w[: T.PREFIX], 2))}) for t, _ in texts]
    common = sorted({s for own in sets for s in own if sum(s in x for x in sets) >= T.LEAST_TEXTS})
    first = dict(zip(common, np.random.default_rng(8).normal(0, 0.05, (len(common), T.FACTORS))))
    sets = [[s for s in own if s in first] for own in sets]
    pairs = [sum(first[a] @ first[b] for i, a in enumerate(own) for b in own[i + 1 :]) for own in sets]
    err = [1 / (1 + math.exp(-x)) - y for x, (_, y) in zip(pairs, texts)]
    assert any(m.w[s] for s in common) and not all(m.w[s] for s in common)
    for s in common:
        g = sum(e for own, e in zip(sets, err) if s in own)
        want = 0.0 if abs(g) <= 1.5 else -(g - math.copysign(1.5, g)) / ((1 + abs(g)) / T.RATE + T.L2)
        assert m.w[s] == pytest.approx(want)
        dv = sum((e * sum((first[t] for t in own if t != s), np.zeros(T.FACTORS)) for own, e in zip(sets, err) if s in own), np.zeros(T.FACTORS)) + 0.01 * first[s]
        step = 0.05 / np.sqrt(T.CALM + dv**2)
        moved = first[s] - step * dv
        if not want:
            moved = moved * max(0.0, 1 - T.SHRINK * step.mean() / np.sqrt((moved**2).sum()))
        assert m.v[s] == pytest.approx(moved)
    assert m.bias == pytest.approx(-0.1 * sum(err) / (1 + math.sqrt(sum(err) ** 2)))


def test_repeated_and_missing_ids(spark, docs_of):
    """Each row is scored; a label for an id holds for each of its rows."""
    docs = docs_of([(1, "some words"), (1, "other words"), (None, "blargh"), (None, None)], clash=["score", "label", "slots"])
    m = T.train(docs, spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int"))
    got = T.score_documents(docs, m).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 1] and all(0 <= r.score <= 1 for r in got)


def test_learning_holds_what_it_learns_from_and_the_learnt_terms():
    """Beside the machine (40 MB), at most 24 bytes a word: no arrays over all slots but that one."""
    r = np.random.default_rng(2)
    rows = [(r.integers(1, 3000, 2000).astype(np.int64).tobytes(), i % 2) for i in range(300)]
    tracemalloc.start()
    try:
        m = T.fit(rows, epochs=3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert m.w.any() or m.v.any()
    assert peak < 48e6 + 24 * 2000 * len(rows)


def test_driver_gets_its_memory_back(spark):
    """The pipeline's driver keeps no memory of learning through the stages that follow."""

    def own_mb() -> float:
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    word = "concat('w', translate(string(pmod(hash(id, k), 3000)), '0123456789', 'abcdefghij'))"
    docs = spark.range(0, 1500, 1, 4).selectExpr("id as doc_id", f"array_join(transform(sequence(1, 1200), k -> {word}), ' ') as text")
    labels = spark.range(1500).selectExpr("id as doc_id", "int(id % 2) as toxic")
    give_back()
    before = own_mb()
    T.train(docs, labels)
    assert own_mb() - before < 16
