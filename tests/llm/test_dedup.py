import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import exact_dedup, near_dedup, rowset
from keystrata.llm.components import components

rng = random.Random(5)
VOCAB = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(text, share):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = rng.choice(VOCAB)
    return " ".join(w)


BASES = [prose(n) for n in (5, 30, 80, 200, 400)]
TEXTS = ["", None, "  ", "one", "one", "two words", "Two  Words", "a b c", "A B\tC"] + BASES
TEXTS += [edited(b, s) for b in BASES for s in (0.0, 0.01, 0.03, 0.05, 0.1) for _ in range(6)]
TEXTS += [t.upper() for t in BASES] + [BASES[3]] * 30


def brute_exact(texts):
    norm = {i: re.sub("[ \t-\r]+", " ", t or "") for i, t in enumerate(texts)}
    low, n = {}, Counter(norm.values())
    for i in sorted(norm):
        low.setdefault(norm[i], i)
    return {i: (low[x], n[x], low[x] == i, hashlib.sha256(x.encode()).hexdigest()) for i, x in norm.items()}


@pytest.mark.parametrize("memtable,digest_bytes", [(500_000, 16), (7, 16), (11, 9), (500_000, 1)])
def test_exact_groups(docs_of, memtable, digest_bytes):
    """One digest byte collides, so the hits differ by bytes and the exact way takes over."""
    got = exact_dedup.exact_groups(docs_of(TEXTS, clash=["keep_id", "kept"]), memtable=memtable, digest_bytes=digest_bytes).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute_exact(TEXTS)
    assert len(got) == len(TEXTS)


#: Names that operators use for columns of their own.
CLASHES = ["_may", "_id", "salt", "_salt", "file", "row", "node", "keep_id", "kept", "component_id", "bucket", "least", "_metadata"]


def test_exact_odd_rows(docs_of):
    assert exact_dedup.exact_groups(docs_of(["x"]).where("doc_id < 0")).count() == 0
    rows = [(None, "x"), (4, "x"), (4, "x"), (9, "lone"), (None, "null id only"), (None, "null id only")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs_of(rows, clash=CLASHES)).collect()), key=str)
    assert got == [(4, 4, 3, False), (4, 4, 3, True), (9, 9, 1, True), (None, 4, 3, False), (None, None, 2, False), (None, None, 2, True)]
    long = "a" * 3_000_000
    assert {r.group_size for r in exact_dedup.exact_groups(docs_of([long, long + " ", long])).collect()} == {1, 2}


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_repeated_ids_with_other_texts(docs_of, digest_bytes, monkeypatch):
    """One id, several texts: rows are told apart, and texts are regrouped only where digests truly collide."""
    taken = []
    by_text = exact_dedup._by_text
    monkeypatch.setattr(exact_dedup, "_by_text", lambda rows: taken.append(1) or by_text(rows))
    rows = [(1, "x"), (4, "x"), (4, "a unique text"), (4, "other"), (5, "other"), (7, "y"), (7, "y"), (7, "z")] + [(100 + i, f"t{i}") for i in range(400 if digest_bytes == 1 else 0)]
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs_of(rows), digest_bytes=digest_bytes).collect())
    want = [(1, 1, 2, True), (4, 1, 2, False), (4, 4, 1, True), (4, 4, 2, True), (5, 4, 2, False), (7, 7, 1, True), (7, 7, 2, False), (7, 7, 2, True)]
    assert got == sorted(want + [(100 + i, 100 + i, 1, True) for i in range(len(rows) - 8)])
    assert bool(taken) == (digest_bytes == 1)


def test_a_large_group_is_verified(docs_of):
    rows = [(i, "the same text") for i in range(700)] + [(1000 + i, f"own {i}") for i in range(20)]
    got = exact_dedup.exact_groups(docs_of(rows), memtable=50).collect()
    assert sum(r.kept for r in got) == 21 and {(r.keep_id, r.group_size) for r in got if r.doc_id < 700} == {(0, 700)}


def test_index_takes_later_batches(docs_of):
    a, b = ["x", "y", "x"], [(10, "x"), (11, "z"), (1, "y")]
    digests = lambda d: exact_dedup.flush_runs(d.select("doc_id", F.lit(1).cast("long").alias("file"), F.col("doc_id").alias("row"), F.unhex(F.sha2(exact_dedup.normalised(F.col("text")), 256)).alias("sha")), 4)
    first = exact_dedup.compact(digests(docs_of(a)).where("block is not null"), 4)
    both = exact_dedup.extend(first, digests(docs_of(b)).where("block is not null"), 4).where("run = -1").collect()
    runs = np.concatenate([np.frombuffer(bytes(r.block), dtype=exact_dedup.RUN) for r in both])
    assert sorted(zip(runs["id"].tolist(), runs["n"].tolist())) == [(0, 3), (1, 2), (11, 1)]
    for r in both:
        rows = np.frombuffer(bytes(r.block), dtype=exact_dedup.RUN)
        assert exact_dedup.may_hold(np.frombuffer(bytes(r.filter), dtype=np.uint8), rows).all()


def brute_near(texts, k, share):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if n * share.denominator >= share.numerator * (len(sets[a]) + len(sets[b]) - n):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k,share", [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_near_duplicates(docs_of, k, share):
    got = near_dedup.near_duplicates(docs_of(TEXTS, clash=["component_id"]), k, share).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(list(enumerate(TEXTS)), k, share)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(TEXTS)


@pytest.mark.parametrize("share", [0.02, 0.06, 0.1])
def test_large_buckets_are_cut_into_blocks(docs_of, monkeypatch, share):
    """Alike texts, of which many, some or few are linked, in blocks of 8."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = prose(120)
    texts = [edited(base, share) for _ in range(90)] + [edited(BASES[4], 0.01) for _ in range(20)]
    got = near_dedup.near_duplicates(docs_of(texts), 3, Fraction(85, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(list(enumerate(texts)), 3, Fraction(85, 100))


def test_near_odd_rows(docs_of):
    assert near_dedup.near_duplicates(docs_of(["x"]).where("doc_id < 0")).count() == 0
    assert {r.component_id for r in near_dedup.near_duplicates(docs_of(["all", "different", "texts"])).collect()} == {0, 1, 2}
    got = near_dedup.near_duplicates(docs_of([(3, "a b c d e f"), (3, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v"), (8, None)], clash=CLASHES)).collect()
    told = sorted(((r.doc_id, r.component_id, r.kept, r.stays) for r in got), key=str)
    assert sorted(x[:3] for x in told if x[0] is not None) == [(3, 3, True), (3, 3, True), (7, 3, False), (8, 8, True)]
    assert sorted((x[1], x[2]) for x in told if x[0] is None and x[1]) == [(3, False)] and sum(x[1] is None for x in told) == 2
    assert sum(x[3] for x in told) == 3  # one of the first group, one of the second, and the text without words


def test_near_repeated_ids_with_other_texts(docs_of):
    """One id, several texts: a row more for each row, and only texts that are alike are linked."""
    a, b = prose(60), prose(60)
    rows = [(1, a), (3, a), (3, b), (9, b + " end"), (3, prose(40))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept, r.stays) for r in near_dedup.near_duplicates(docs_of(rows)).collect())
    assert len(got) == 5
    assert [x for x in got if x[0] != 3] == [(1, 56, 1, True, True), (9, 57, 3, False, False)]
    assert sorted((x[2], x[4]) for x in got if x[0] == 3) == [(1, False), (3, True), (3, True)]


def test_a_very_long_text(docs_of):
    long = " ".join(str(rng.randrange(10**6)) for _ in range(200_000))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs_of([long, "short one", long + " end"])).collect()}
    assert got[2][1] == got[0][1] == 0 and got[1] == (1, 1) and got[2][0] == got[0][0] + 1 > 199_000


def test_bands_miss_little():
    for t in (0.5, 0.8, 0.85, 0.95):
        bands, rows = near_dedup.bands_for(t)
        assert (1 - t**rows) ** bands <= near_dedup.MISS


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 50 + i) for i in range(49)] + [(200, 201), (201, 202), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 50 for i in [*range(50, 99), 100]) and got[202] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_row_sets(spark, docs_of, tmp_path):
    docs_of([(i % 50, f"t{i}") for i in range(3000)], clash=["file", "bucket"]).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")).where("doc_id != 49")
    assert rowset.filed(docs) is docs and rowset.filed(docs.union(docs)) is not docs
    some = docs.where("doc_id % 7 = 3 and n_chars > 3").select(*rowset.place(docs))
    left = rowset.without(docs, some)
    assert left.dtypes == docs.dtypes
    assert sorted(r.text for r in left.collect()) == sorted(r.text for r in docs.where("not (doc_id % 7 = 3 and n_chars > 3)").collect())
    assert rowset.without(docs, some.where("false")).count() == docs.count()
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_registered_queries_against_brute_force(spark):
    """All documents of the smallest folder, all pairs."""
    from keystrata.llm.queries import op4_near_dedup, op6_exact_dedup

    from ..conftest import SF

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = brute_near(sorted(texts.items()), 3, Fraction(85, 100))
    got = op4_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    norm = {i: re.sub("[ \t-\r]+", " ", t or "") for i, t in texts.items()}
    least, count = {}, Counter(norm.values())
    for i in sorted(norm):
        least.setdefault(norm[i], i)
    rows = op6_exact_dedup(spark, SF).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == {i: (least[x], count[x], least[x] == i) for i, x in norm.items()}
