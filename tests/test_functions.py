import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions import codecs, exact
from keystrata.functions.types import ColumnDef, ColumnType, EngineError, fit, half_even, parse_type, truncate_time


def col(family, *params):
    return ColumnDef("c", ColumnType(family, params))


@pytest.mark.parametrize("name,family", [("int", "i32"), ("INT8", "i64"), ("float", "f32"), ("real", "f64"), ("varchar", "string"), ("hugeint", "i128"), ("decimal", "numeric"), ("timestamptz", "timestamptz")])
def test_spellings(name, family):
    assert parse_type(name).family == family


def test_unknown_types():
    for name in ("BOOLEAN", "UUID", "JSON"):
        with pytest.raises(EngineError):
            parse_type(name)
    with pytest.raises(EngineError):
        parse_type("NUMERIC", (39, 0))


@pytest.mark.parametrize(
    "value,column,want",
    [
        (5, col("i32"), 5),
        ("2.345", col("numeric", 9, 2), Decimal("2.34")),
        (Decimal("2.355"), col("numeric", 9, 2), Decimal("2.36")),
        ("2024-01-02", col("date"), dt.date(2024, 1, 2)),
        ("2024-01-02T03:04:05.987654", col("timestamp", 3), dt.datetime(2024, 1, 2, 3, 4, 5, 987000)),
        ("01:02:03.456789", col("time", 3), 3723456000),
        (None, col("i32"), None),
        (3, col("f64"), 3.0),
    ],
)
def test_fit(value, column, want):
    assert fit(value, column) == want


@pytest.mark.parametrize("value,column", [(1 << 31, col("i32")), ("x", col("i64")), (Decimal("123.4"), col("numeric", 2, 0)), (5, col("string")), ("no", col("date"))])
def test_misfits(value, column):
    with pytest.raises(EngineError):
        fit(value, column)


STOCK = [(1, 1, 10), (1, 2, 25), (1, 3, 5), (2, 1, 15)]


def test_stock_aggregates(spark):
    s = spark.createDataFrame(STOCK, "s_w_id int, s_i_id int, s_quantity int")
    one = s.where("s_w_id = 1")
    row = exact.aggregate(one, [("sum", "s_quantity", "a"), ("min", "s_quantity", "b"), ("max", "s_quantity", "c"), ("avg", "s_quantity", "d"), ("count", None, "n")]).first()
    assert tuple(row) == (40, 5, 25, Decimal("13.333333"), 3)
    assert exact.aggregate(s.where("s_w_id = 1 and s_quantity < 20"), [("count", None, "n")]).first().n == 2


def test_result_types(spark):
    df = spark.createDataFrame([(1, 2, 1.5, Decimal("1.25"))], "i int, l bigint, d double, n decimal(12,2)")
    got = exact.aggregate(df, [("sum", "i", "a"), ("avg", "i", "b"), ("sum", "n", "c"), ("avg", "n", "d"), ("avg", "d", "e"), ("count", "l", "f"), ("min", "i", "g")]).dtypes
    assert got == [("a", "bigint"), ("b", "decimal(38,6)"), ("c", "decimal(12,2)"), ("d", "decimal(12,8)"), ("e", "double"), ("f", "bigint"), ("g", "int")]


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([(None,), (7,), (4,)], "x int")
    assert tuple(exact.aggregate(df, [("count", "x", "a"), ("min", "x", "b"), ("max", "x", "c"), ("avg", "x", "d")]).first()) == (2, 4, 7, Decimal("5.5"))
    assert tuple(exact.aggregate(df.where("x > 99"), [("count", None, "a"), ("sum", "x", "b"), ("avg", "x", "c")]).first()) == (0, None, None)


def test_sum_overflows_only_at_the_end(spark):
    big = (1 << 63) - 1
    df = spark.createDataFrame([(big,), (big,), (-big,)], "x bigint")
    assert exact.aggregate(df, [("sum", "x", "s")]).first().s == big
    with pytest.raises(Exception, match="(?i)overflow"):
        exact.aggregate(df.where("x > 0"), [("sum", "x", "s")]).first()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=30))
def test_average_is_half_even(spark, values):
    from fractions import Fraction

    got = exact.aggregate(spark.createDataFrame([(v,) for v in values], "x bigint"), [("avg", "x", "m")]).first().m
    assert got == Decimal(round(Fraction(sum(values), len(values)) * 10**6)).scaleb(-6)


def test_points_and_many_digits(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in ("5", "-5", "0", "123456789012345678901234567890", "-1234567")], "w decimal(38,0)")
    assert [r.t for r in df.select(exact.pointed(F.col("w"), 6).alias("t")).collect()] == ["0.000005", "-0.000005", "0.000000", "123456789012345678901234.567890", "-1.234567"]
    wide = spark.createDataFrame([(Decimal("99999999999999999999.25"),), (Decimal("99999999999999999999.75"),)], "x decimal(30,2)")
    assert exact.aggregate(wide, [("avg", "x", "m")]).first().m == Decimal("99999999999999999999.5")


def test_duplicate_names(spark):
    with pytest.raises(EngineError):
        exact.aggregate(spark.range(1), [("sum", "id", "s"), ("sum", "id", "s")])


def test_rounding_and_truncation(spark):
    df = spark.createDataFrame([(Decimal("2.345"), -1500)], "n decimal(9,3), m bigint")
    row = df.select(half_even(F.col("n"), 9, 2).alias("n"), truncate_time(F.col("m"), 3).alias("m")).first()
    assert tuple(row) == (Decimal("2.34"), -2000)


def test_text_codecs(spark):
    df = spark.createDataFrame([('a"b', 3, dt.date(2024, 1, 2), None)], "s string, i int, d date, x string")
    text = df.select(*[codecs.to_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    assert tuple(text.first()) == ('"a\\"b"', "3", '"2024-01-02"', None)
    back = text.select(*[codecs.from_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    assert back.collect() == df.collect()
    assert spark.createDataFrame([("bare",)], "s string").select(codecs.from_text(F.col("s"), T.StringType())).first()[0] == "bare"
