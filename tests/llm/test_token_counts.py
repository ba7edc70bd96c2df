import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keystrata.llm import token_counts as C

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = ["", "a", "   ", "I'll've it's\n\n  done 123.45 ", "word " * 500, "x" * 3000, "日本語 テスト 😀 é", "a\n\n\n b"]
EDITS = "array<struct<start:int,end:int,text:string>>"


@pytest.fixture(scope="module")
def counter():
    return C.Counter(PATH, PATTERN)


@pytest.mark.parametrize("leaf", [1, 3, 64])
@pytest.mark.parametrize("seed", range(6))
def test_edits_against_whole_encoding(counter, leaf, seed):
    rng = random.Random(seed)
    parts = ["a", " ", "  ", "\n", "'", "'re", "s", "9", "12", ".", "é", " \n ", "word "]
    for text in TEXTS:
        tree = C.TokenTree(text, counter, leaf)
        for _ in range(8):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 30, 3000]))
            new = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 200])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.length == len(text)
            assert tree.total == len(counter.encoding.encode_ordinary(text))


def test_little_is_encoded_again(counter):
    tree = C.TokenTree("word " * 20_000, counter)
    before = counter.encoded
    tree.edit(50_000, 50_004, "other")
    assert counter.encoded - before < 4 * C.LEAF


def test_documents(docs_of, counter):
    edits = F.expr("if(doc_id = 1, null, array(struct(0 as start, 1 as end, 'new ' as text), struct(2 as start, 99999 as end, null as text)))")
    docs = docs_of([*TEXTS, None], clash=["n_tokens"]).withColumn("edits", edits.cast(EDITS))
    got = {r.doc_id: r for r in C.count_with_edits(docs, PATH, PATTERN, edits_col="edits").collect()}
    n = lambda t: len(counter.encoding.encode_ordinary(t))
    for i, t in enumerate([*TEXTS, None]):
        t = t or ""
        after = t if i == 1 else ("new " + t[1:])[:2]
        assert (got[i].n_tokens, got[i].n_tokens_edited, got[i].n_chars_edited) == (n(t), n(after), len(after))
    plain = C.count_with_edits(docs, PATH, PATTERN).collect()
    assert all(r.n_tokens == r.n_tokens_edited and r.n_reencoded == 0 for r in plain)
    assert C.count_with_edits(docs.where("doc_id < 0"), PATH, PATTERN).count() == 0


def test_kept_trees_take_later_edits(spark, docs_of, counter, tmp_path):
    """Built, written, read, edited, and edited again; a very long text, repeated and missing ids among them."""
    texts = [*TEXTS, None, "many words, " * 50_000]
    docs = docs_of([*enumerate(texts), (3, "again"), (None, "no id")], clash=["tree", "edits"])
    C.build_trees(docs, PATH, PATTERN).write.parquet(str(tmp_path / "trees"))
    kept = spark.read.parquet(str(tmp_path / "trees"))
    assert sorted(r.n_tokens for r in kept.collect()) == sorted(len(counter.encoding.encode_ordinary(t or "")) for t in [*texts, "again", "no id"])
    edit = lambda s: F.expr(s).cast(EDITS)
    once = C.edit_trees(kept.withColumn("edits", edit("array(struct(1 as start, 3 as end, 'XY z' as text))")), PATH, PATTERN)
    twice = C.edit_trees(once.withColumn("edits", edit("if(doc_id = 1, null, array(struct(0 as start, 0 as end, 'front ' as text), null))")), PATH, PATTERN)
    got = {r.doc_id: r for r in twice.collect() if r.doc_id != 3}
    for i, t in [*enumerate(texts), (None, "no id")]:
        if i != 3:
            want = (t or "")[:1] + "XY z" + (t or "")[3:]
            want = want if i == 1 else "front " + want if i is not None else want
            tree = C.TokenTree.loaded(bytes(got[i].tree), counter)
            assert tree.text() == want or i is None
            assert got[i].n_tokens == tree.total == len(counter.encoding.encode_ordinary(tree.text()))
