import random
import re

import duckdb
import pytest

from keystrata.llm import decontaminate as D
from keystrata.llm.queries import OP5_SQL

from ..conftest import same_rows

rng = random.Random(9)
VOCAB = [f"t{i}" for i in range(60)] + ["Ünï", "日本"]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


ITEMS = [(i, prose(n)) for i, n in enumerate([40, 12, 8, 9, 3, 1, 7, 30])] + [(8, ""), (9, None), (10, "..!"), (20, "Same, words twice")]
ITEMS += [(21, ITEMS[0][1])]  # one passage under two items
DOCS = ["", None, "t1", prose(50), prose(300), ITEMS[0][1], prose(20) + ". " + ITEMS[1][1].upper() + "\n" + prose(20), ITEMS[2][1].replace(" ", ",-, "), " ".join(ITEMS[0][1].split()[5:14]), ITEMS[7][1] + " " + ITEMS[7][1], "same words twice", "same words TWICE same words twice " * 5]
DOCS += [prose(30) + " " + " ".join(ITEMS[k][1].split()[:9]) for k in (0, 3, 7)]


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower()) if text else []


def brute(text, items, n):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        for i in range(max(1, len(b) - n + 1)) if b else ():
            win = b[i : i + n]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), D.sha256_of(sorted(found)), len(found) >= 2


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("most", [300_000, 25])
@pytest.mark.parametrize("n", [8, 3])
def test_report(docs_of, bench, n, most):
    got = D.report(D.scan(docs_of(DOCS, clash=["items", "hits"]), bench, n, most_windows=most)).collect()
    assert len(got) == len(DOCS)
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: brute(t, ITEMS, n) for i, t in enumerate(DOCS)}


def test_odd_tables(docs_of, bench):
    assert {r.n_items for r in D.report(D.scan(docs_of(DOCS), bench.where("item_id < 0"))).collect()} == {0}
    assert D.report(D.scan(docs_of(["x"]).where("doc_id < 0"), bench)).count() == 0
    got = D.report(D.scan(docs_of([(1, ITEMS[0][1]), (1, ITEMS[0][1]), (None, "t1")]), bench, most_windows=25)).collect()
    assert sorted(((r.doc_id, r.n_items) for r in got), key=str)[:2] == [(1, r.n_items) for r in got if r.doc_id == 1] and len(got) == 3


@pytest.mark.parametrize("most", [300_000, 25])
def test_documents_are_removed(docs_of, bench, monkeypatch, most):
    monkeypatch.setattr(D, "MOST_WINDOWS", most)
    docs = docs_of(DOCS, clash=["_row", "hits", "block"])
    left = D.without_contaminated(docs, bench)
    assert left.columns == docs.columns and {r["_row"] for r in left.collect()} == {"clash"}
    kept = {r.doc_id for r in left.collect()}

    def bad(text):
        w, runs = words(text), 0
        for _, t in ITEMS:
            b = words(t)
            runs = max([runs, *(8 for i in range(len(b) - 7) for j in range(len(w) - 7) if w[j : j + 8] == b[i : i + 8])])
        return runs >= 8 or brute(text, ITEMS, 8)[2] >= 2

    for i, t in enumerate(DOCS):
        if bad(t):
            assert i not in kept
        elif brute(t, ITEMS, 8)[2] == 0:
            assert i in kept


def test_a_very_long_text(docs_of, bench):
    long = "filler " * 200_000 + ITEMS[0][1] + " filler" * 1000
    got = {r.doc_id: r for r in D.report(D.scan(docs_of([long, "filler"]), bench)).collect()}
    assert got[0].n_words == 201_000 + len(words(ITEMS[0][1])) and got[0].n_hit >= 40 and got[1].n_hit == 0


def test_spans_are_removed():
    text = "keep ONE, two; three keep"
    assert D.without_spans(text, [1, 4]) == "keep  keep"
    assert D.without_spans(text, []) == text and D.without_spans("a", [0, 1]) == ""


@pytest.mark.parametrize("most", [D.MOST_WINDOWS, 3])
def test_items_without_an_id_hit_words(spark, docs_of, most):
    """As the SQL has it: null ids count together as one item, and are not in the list."""
    one, two = " ".join(f"w{i}" for i in range(12)), " ".join(f"v{i}" for i in range(12))
    bench = spark.createDataFrame([(None, one), (None, two), (7, "x1 x2 x3")], "item_id long, text string")
    docs = docs_of([one, f"a {one} b {two} c", f"{two} x1 x2 x3", "nothing here"])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", bench.toArrow())
    same_rows(D.report(D.scan(docs, bench, most_windows=most)), con, OP5_SQL)
    assert [r.text for r in D.without_contaminated(docs, bench).collect()] == ["nothing here"]
