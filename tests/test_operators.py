import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keystrata.functions.types import EngineError
from keystrata.operators import access, dml, versions
from keystrata.operators.access import Condition, classify
from keystrata.operators.partition import MAX, MIN, Part, RangeRule, ordered_scan, scan_partitions, with_partition


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_classify():
    key = ("a", "b")
    c = lambda *x: Condition(*x)
    assert classify([], key).kind == "full"
    assert classify([c("a", "=", 1), c("b", "=", 2)], key).kind == "key"
    p = classify([c("a", "=", 1), c("v", ">", 2)], key)
    assert (p.kind, [x.column for x in p.residual]) == ("prefix", ["v"])
    assert classify([c("a", ">", 1), c("a", "<", 9)], key).kind == "range"
    assert classify([c("a", "=", 1), c("b", ">=", 2)], key).kind == "range"
    assert classify([c("b", "=", 2)], key).kind == "full"


def test_insert_and_duplicates(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert rows(dml.insert(base, spark.createDataFrame([(3, "c")], base.schema), ("id",))) == [(1, "a"), (2, "b"), (3, "c")]
    for new in ([(2, "x")], [(5, "x"), (5, "y")]):
        with pytest.raises(EngineError, match="duplicate_key"):
            dml.insert(base, spark.createDataFrame(new, base.schema), ("id",))


def test_update_rules(spark):
    base = spark.createDataFrame([(1, 10, None), (2, 20, 5)], "id int, v int, n int")
    assert rows(dml.update(base, {"id": 2}, {"n": None}, [dml.Delta("v", "add", 1), dml.Delta("v", "add", 2)])) == [(1, 10, None), (2, 23, None)]
    with pytest.raises(EngineError, match="immutable"):
        dml.update(base, {"id": 1}, {"id": 3})
    with pytest.raises(Exception, match="NULL"):
        dml.update(base, {"id": 1}, deltas=[dml.Delta("n", "add", 1)]).collect()
    with pytest.raises(Exception, match="(?i)overflow"):
        dml.update(base, {"id": 1}, deltas=[dml.Delta("v", "add", 2147483647)]).collect()
    with pytest.raises(EngineError):
        dml.Delta("v", "sub_wrap", 1, 10, 10)


def test_sub_wrap_example(spark):
    base = spark.createDataFrame([(1, 100), (2, 50)], "id int, q int")
    one = lambda k, n: dml.update(base, {"id": k}, deltas=[dml.Delta("q", "sub_wrap", n, 10, 91)]).where(f"id = {k}").first().q
    assert (one(1, 95), one(2, 5)) == (96, 45)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 120)), min_size=1, max_size=12), st.lists(st.integers(10, 100), min_size=3, max_size=3))
def test_fold_is_the_same_as_one_by_one(spark, deltas, start):
    base = spark.createDataFrame(list(enumerate(start, 1)), "id int, q int")
    df = spark.createDataFrame([(k, n, a) for n, (k, a) in enumerate(deltas)], "id int, n int, amount int")
    want = dict(enumerate(start, 1))
    for k, a in deltas:
        y = want[k] - a
        want[k] = y + 91 if y < 10 else y
    assert dict(rows(dml.fold_sub_wrap(base, df, ("id",), "q", 10, 91, order="n"))) == want
    random.shuffle(deltas)
    plus = spark.createDataFrame([(k, a) for k, a in deltas], "id int, amount int")
    assert dict(rows(dml.fold_deltas(base, plus, ("id",), "q"))) == {k: s + sum(a for i, a in deltas if i == k) for k, s in enumerate(start, 1)}


def test_folds_keep_scale_and_refuse_null(spark):
    from decimal import Decimal

    base = spark.createDataFrame([(1, Decimal("1.00000000")), (2, None)], "id int, q decimal(20,8)")
    df = spark.createDataFrame([(1, Decimal("0.00000001")), (1, Decimal("0.00000002"))], "id int, amount decimal(20,8)")
    assert rows(dml.fold_deltas(base, df, ("id",), "q")) == [(1, Decimal("1.00000003")), (2, None)]
    with pytest.raises(Exception, match="increment of NULL"):
        dml.fold_deltas(base, spark.createDataFrame([(2, Decimal(1))], "id int, amount decimal(20,8)"), ("id",), "q").collect()
    whole = spark.createDataFrame([(1, 500), (2, None), (3, 20)], "id int, q int")
    with pytest.raises(Exception, match="increment of NULL"):
        dml.fold_sub_wrap(whole, spark.createDataFrame([(2, 1)], "id int, amount int"), ("id",), "q", 10, 91).collect()
    mixed = spark.createDataFrame([(1, 450, 1), (1, 45, 2), (3, 15, 1)], "id int, amount int, n int")
    assert rows(dml.fold_sub_wrap(whole, mixed, ("id",), "q", 10, 91, order="n")) == [(1, 96), (2, None), (3, 96)]


def test_numbers_inside_a_hot_key(spark):
    from keystrata.operators.ranks import numbered

    data = [(1 if i % 2 else i % 7, i * 37 % 1009) for i in range(600)] + [(None, 5)]
    want, seen = {}, {}
    for k, x in sorted(data, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        want[k, x] = seen[k]
    got = numbered(spark.createDataFrame(data, "k int, x int").repartition(5), ["k"], "x", "n").collect()
    assert {(r.k, r.x): r.n for r in got} == want and len(got) == len(data)
    assert numbered(spark.createDataFrame([], "k int, x int"), ["k"], "x", "n").count() == 0


def test_versions(spark):
    log = spark.createDataFrame([(1, 1, "P", "a"), (1, 3, "P", "b"), (2, 2, "P", "c"), (2, 4, "D", None)], "k int, xid int, op string, v string")
    assert rows(versions.visible(log, ("k",), 2)) == [(1, "a"), (2, "c")]
    assert rows(versions.visible(log, ("k",))) == [(1, "b")]
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    staged = spark.createDataFrame([(2, None, "D"), (3, "z", "P"), (4, "n", "P")], "k int, v string, op string")
    after = versions.overlay(base, staged, ("k",))
    assert rows(after) == [(1, "a"), (3, "z"), (4, "n")]
    assert rows(versions.log_of(base, after, ("k",), 9)) == [(2, "b", "D", 9), (3, "z", "P", 9), (4, "n", "P", 9)]


RULE = RangeRule("r", ("a", "b"), (Part("p0", (MIN, MIN), (1000, MIN)), Part("p1", (1000, MIN), (2000, 5)), Part("p2", (2000, 5), (MAX, MAX))))


def test_routes():
    assert [RULE.route(k) for k in ((999, 10**9), (1000, -5), (2000, 4), (2000, 5))] == ["p0", "p1", "p1", "p2"]
    with pytest.raises(EngineError):
        RangeRule("x", ("a",), (Part("p", (0,), (5,)),)).route((9,))


def test_prune():
    one = RangeRule("x", ("a",), (Part("p0", (MIN,), (1000,)), Part("p1", (1000,), (2000,)), Part("p2", (2000,), (MAX,))))
    assert one.prune((500,), (1000,), True, True) == ["p0", "p1"]  # the partition that starts at an inclusive limit stays
    assert one.prune((500,), (1000,), True, False) == ["p0"]
    assert one.prune() == ["p0", "p1", "p2"]
    assert one.prune((2000,)) == ["p2"]
    assert RULE.prune((1000,), (1000,), True, True) == ["p1"]
    assert RULE.prune((2000,), (2000,), True, True) == ["p1", "p2"]


def test_bad_rules():
    for parts in ([("p", (5,), (5,))], [("p", (0,), (5,)), ("q", (4,), (9,))], [("p", (0, 1), (5, 1))]):
        with pytest.raises(EngineError):
            RangeRule("x", ("a",), tuple(Part(*p) for p in parts))


def test_partition_frames(spark):
    df = spark.createDataFrame([(999, 9), (1000, 0), (2000, 4), (2000, 5)], "a int, b int")
    assert [r.part_id for r in with_partition(df, RULE, ["a", "b"]).orderBy("a", "b").collect()] == ["p0", "p1", "p1", "p2"]
    assert rows(scan_partitions(df, RULE, ["a", "b"], ["p2", "p0"])) == [(2000, 5), (999, 9)]
    assert [tuple(r) for r in ordered_scan(df, RULE, ["a", "b"], ["a", "b"]).collect()] == [(999, 9), (1000, 0), (2000, 4), (2000, 5)]


def test_first_and_last(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "k int, v string")
    assert (tuple(access.first(df, ["k"]).first()), tuple(access.last(df, ["k"]).first())) == ((1, "a"), (3, "c"))
    assert access.first(df.where("k > 9"), ["k"]).count() == 0
