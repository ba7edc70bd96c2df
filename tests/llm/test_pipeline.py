"""run() over a small folder of tables against a plain version of its stages, and the queries that have SQL against it."""

import random
from fractions import Fraction

import public_tokenizers
import pytest

import corpus_pipeline
from keystrata.llm import queries, toxicity

from ..conftest import SF, same_rows
from .test_decontaminate import brute as brute_leaks
from .test_decontaminate import words
from .test_dedup import brute_exact, brute_near
from .test_packing import check_pieces

rng = random.Random(8)
VOCAB = [f"v{i}" for i in range(500)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    items = [(i, prose(30)) for i in range(5)]
    texts = [prose(rng.choice([3, 40, 200])) for _ in range(150)]
    toxic = {i for i in range(0, 150, 5)}
    texts = [f"{t} snork blargh {prose(4)} zibble snork" if i in toxic else t for i, t in enumerate(texts)]
    texts += [texts[1], texts[2].replace(" ", "  ").replace("  ", " "), texts[3].upper(), texts[4] + " more"]
    texts += [prose(20) + " " + items[0][1] + " " + prose(20), " ".join(items[1][1].split()[:9]), items[2][1] + " " + items[3][1], "", None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, items, toxic


def test_run(spark, folder):
    path, texts, items, toxic = folder
    docs = corpus_pipeline.table(spark, path, "documents")
    machine = toxicity.train(docs, corpus_pipeline.table(spark, path, "labels"))
    scores = machine.score([t or "" for t in texts])
    left = [(i, t) for i, t in enumerate(texts) if scores[i] < 0.7]
    assert not toxic & {i for i, _ in left} and len(left) == len(texts) - len(toxic)
    order = [i for i, _ in left]
    exact = brute_exact([t for _, t in left])
    left = [x for k, x in enumerate(left) if exact[k][2]]
    near = brute_near(left, 5, Fraction(4, 5))
    left = [x for x in left if near[x[0]][1] == x[0]]

    def leaks(t):
        w = words(t)
        run = any(w[j : j + 8] == b[i : i + 8] for _, x in items for b in [words(x)] for i in range(len(b) - 7) for j in range(len(w) - 7))
        return run or brute_leaks(t, items, 8)[2] >= 2

    left = [x for x in left if not leaks(x[1])]
    assert len(order) > len(left)
    rows = corpus_pipeline.run(spark, path).collect()
    ids = sorted(i for i, _ in left)
    assert sorted({r.doc_id for r in rows}) == ids
    place = {d: k for k, d in enumerate(ids)}

    class Row:
        def __init__(self, r):
            self.__dict__.update(r.asDict(), doc_id=place[r.doc_id])

    check_pieces([Row(r) for r in rows], [dict(left)[i] for i in ids], 4096)
    assert public_tokenizers.path(queries.WORD_BPE)


def test_stages_keep_the_columns(spark, folder):
    docs = corpus_pipeline.table(spark, folder[0], "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).dtypes == docs.dtypes, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


ODD = [(1, "x"), (4, "x"), (4, "a unique text"), (4, None), (None, "x"), (None, "only without an id"), (None, "only without an id"), (6, ""), (7, "y " * 30_000)]


def test_stages_keep_rows_apart(spark, folder, tmp_path):
    """Repeated ids with the same and other texts, no ids, clashing columns, very long and empty texts."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD], schema).withColumns({c: F.lit("clash") for c in ("_may", "_id", "salt", "file", "row", "kept", "_metadata")})
    docs.repartition(2).write.parquet(str(tmp_path / "odd"))
    stages = dict(corpus_pipeline.STAGES)
    for made in (spark.read.parquet(str(tmp_path / "odd")), docs):
        left = {name: sorted(((r.doc_id, r.text) for r in stages[name](spark, made, folder[0]).collect()), key=str) for name in ("toxicity", "exact_dedup", "near_dedup", "decontamination")}
        assert left["toxicity"] == left["decontamination"] == sorted(ODD, key=str)
        once = sorted({1: "x", 4: "a unique text", 7: "y " * 30_000}.items(), key=str)
        assert [x for x in left["exact_dedup"] if x[1]  and x[0]] == once and sorted(x[1] or "" for x in left["exact_dedup"]) == sorted([t for _, t in once] + ["", "only without an id"])
        assert sorted(left["near_dedup"], key=str) == sorted([*once, (4, None), (6, ""), (None, "only without an id")], key=str)
        assert stages["packing"](spark, made, folder[0]).groupBy("doc_id").count().count() == 5
    empty = spark.read.parquet(str(tmp_path / "odd")).where("doc_id > 99")
    assert all(stage(spark, empty, folder[0]).count() == 0 for stage in stages.values())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_has_a_row_for_each_document(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows.count() == n if name not in ("op1_packing", "op2_best_fit") else rows.count() > 0
