"""COUNT, SUM, AVG, MIN and MAX with exact result types.

SUM of integers is a bigint that fails only if the final value does not fit; AVG of integers is NUMERIC(38,6) and AVG of
NUMERIC(p,s) is NUMERIC(p, min(s+6, p-1)), both rounded half to even from the exact quotient; floats stay doubles.
All are plain aggregate expressions, so Catalyst sums on the map side and prunes columns as for any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions.types import EngineError

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)


def count_all() -> Column:
    return F.count(F.lit(1))


def count(c: str) -> Column:
    return F.count(F.col(c))


def sum_of(c: str, kind: T.DataType) -> Column:
    if isinstance(kind, INTEGERS):
        return F.sum(F.col(c).cast("decimal(20,0)")).cast("bigint")
    if isinstance(kind, FLOATS):
        return F.sum(F.col(c).cast("double"))
    if isinstance(kind, T.DecimalType):
        return F.sum(F.col(c)).cast(kind)
    raise EngineError("unsupported_aggregate", f"SUM of {kind.simpleString()}")


def quotient_half_even(total: Column, n: Column, shift: int) -> Column:
    """round_half_even(total * 10^shift / n) for whole decimals total and n, as a whole decimal."""
    num = (total * F.lit(10**shift).cast(f"decimal({shift + 1},0)")).cast("decimal(38,0)")
    den = n.cast("decimal(20,0)")
    rest = F.pmod(num, den)
    low = ((num - rest) / den).cast("decimal(38,0)")
    twice = rest * 2
    up = (twice > den) | ((twice == den) & (F.pmod(low, F.lit(2).cast("decimal(1,0)")) == 1))
    return F.when(up, low + 1).otherwise(low).cast("decimal(38,0)")


def avg_of(c: str, kind: T.DataType) -> Column:
    n = F.count(F.col(c))
    if isinstance(kind, FLOATS):
        return F.avg(F.col(c).cast("double"))
    if isinstance(kind, INTEGERS):
        p, scale, shift, total = 38, 6, 6, F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)")
    elif isinstance(kind, T.DecimalType):
        p, scale = kind.precision, min(kind.scale + 6, kind.precision - 1)
        shift = scale - kind.scale
        total = (F.sum(F.col(c)).cast(f"decimal(38,{kind.scale})") * F.lit(10**kind.scale).cast(f"decimal({kind.scale + 1},0)")).cast("decimal(38,0)")
    else:
        raise EngineError("unsupported_aggregate", f"AVG of {kind.simpleString()}")
    if shift < 0:  # a precision too small for the scale: the quotient keeps what fits
        raise EngineError("unsupported_aggregate", f"AVG of {kind.simpleString()}")
    whole = quotient_half_even(total, F.nullif(n, F.lit(0)), shift)
    return pointed(whole, scale).cast(f"decimal({p},{scale})")


def pointed(whole: Column, scale: int) -> Column:
    """The text of a whole decimal with the point moved left by scale places: exact, however many digits there are."""
    if not scale:
        return whole.cast("string")
    digits = F.abs(whole).cast("string")
    digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(scale + 1)), F.lit("0"))
    return F.concat(F.when(whole < 0, "-").otherwise(""), F.substring(digits, F.lit(1), F.length(digits) - scale), F.lit("."), F.substring(digits, F.length(digits) - scale + 1, F.lit(scale)))


def min_of(c: str) -> Column:
    return F.min(F.col(c))


def max_of(c: str) -> Column:
    return F.max(F.col(c))


def aggregate(df: DataFrame, items: list[tuple[str, str | None, str]]) -> DataFrame:
    """Whole-set aggregates in one pass: (function, column or None for *, output name); names must differ."""
    names = [x[2] for x in items]
    if len(set(names)) != len(names):
        raise EngineError("duplicate_name", f"aggregates named {names}")
    out = []
    for fn, c, name in items:
        kind = df.schema[c].dataType if c else None
        made = {"count": lambda: count(c) if c else count_all(), "sum": lambda: sum_of(c, kind), "avg": lambda: avg_of(c, kind), "min": lambda: min_of(c), "max": lambda: max_of(c)}.get(fn)  # noqa: B023
        if made is None or (c is None and fn != "count"):
            raise EngineError("unsupported_function", f"{fn}({c or '*'})")
        out.append(made().alias(name))
    return df.agg(*out)
