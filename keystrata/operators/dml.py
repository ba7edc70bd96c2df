"""INSERT, UPDATE, DELETE and increments as DataFrame-to-DataFrame functions.

Nothing here stores anything: each takes the rows of a table and gives back its rows after the statement, so sessions
stage the results and tests compare them directly. Keyed updates of many rows are one join on the key.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions.types import EngineError, half_even


@dataclass(frozen=True)
class Delta:
    """column + amount, column - amount, or the wrapping subtraction y = column - amount, y < floor ? y + wrap : y."""

    column: str
    op: str  # add, sub, sub_wrap
    amount: Any
    floor: int | None = None
    wrap: int | None = None

    def __post_init__(self):
        if self.op not in ("add", "sub", "sub_wrap"):
            raise EngineError("unsupported", f"delta {self.op}")
        if self.op == "sub_wrap" and not (self.wrap is not None and self.floor is not None and self.wrap > self.floor):
            raise EngineError("invalid_argument", "sub_wrap needs wrap > floor")

    def apply(self, c: Column, kind: T.DataType) -> Column:
        """Checked arithmetic in the column's own type; NULL as the base is an error, not NULL."""
        if not isinstance(kind, (T.IntegerType, T.LongType, T.DecimalType)) or (self.op == "sub_wrap" and isinstance(kind, T.DecimalType)):
            raise EngineError("unsupported", f"{self.op} on {kind.simpleString()}")
        n = F.lit(self.amount).cast(kind)
        y = c + n if self.op == "add" else c - n
        if self.op == "sub_wrap":
            y = F.when(y < self.floor, y + F.lit(self.wrap).cast(kind)).otherwise(y)
        return F.when(c.isNull(), F.raise_error(F.lit(f"increment of NULL in {self.column}"))).otherwise(y).cast(kind)


def _same(key: dict[str, Any]) -> Column:
    return reduce(operator.and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()])


def conflicts(base: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys of new rows that base has already or that new has twice."""
    k = list(key)
    twice = new.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*k)
    return new.select(*k).join(base.select(*k), k, "left_semi").union(twice).distinct()


def insert(base: DataFrame, new: DataFrame, key: tuple[str, ...], check: bool = True) -> DataFrame:
    """base with new rows; an existing key is an error. check=False leaves the check to the caller."""
    if check and key:
        if bad := conflicts(base, new, key).first():
            raise EngineError("duplicate_key", str(bad.asDict()))
    return base.unionByName(new)


def insert_new_only(base: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """base with those new rows whose key it does not have."""
    return base.unionByName(new.join(base.select(*key), list(key), "left_anti").select(*base.columns))


def update(base: DataFrame, key: dict[str, Any], values: dict[str, Any] | None = None, deltas: list[Delta] | None = None) -> DataFrame:
    """The row with a whole key takes absolute values and increments; several increments of one column add up."""
    values, deltas = values or {}, deltas or []
    if set(values) & set(key) or {d.column for d in deltas} & set(key):
        raise EngineError("immutable_key", f"{sorted(key)}")
    if set(values) & {d.column for d in deltas}:
        raise EngineError("invalid_argument", "a column is set and incremented at once")
    hit, out = _same(key), {}
    for c, v in values.items():
        out[c] = F.when(hit, F.lit(v).cast(base.schema[c].dataType)).otherwise(F.col(c))
    for d in deltas:
        kind = base.schema[d.column].dataType
        out[d.column] = F.when(hit, d.apply(out.get(d.column, F.col(d.column)), kind)).otherwise(F.col(d.column))
    return base.withColumns(out)


def update_many(base: DataFrame, changes: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Absolute values from a frame with the key and the columns to set (keys must be distinct in it)."""
    sets = [c for c in changes.columns if c not in key]
    marked = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in sets], F.lit(True).alias("_hit"))
    joined = base.join(marked, list(key), "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in base.columns])


def not_null(c: Column, column: str) -> Column:
    """The column; where a row with NULL is incremented, an error (as Delta.apply has it)."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"increment of NULL in {column}"))).otherwise(c)


def fold_deltas(base: DataFrame, deltas: DataFrame, key: tuple[str, ...], column: str, amount: str = "amount") -> DataFrame:
    """Commutative increments (key, amount; negative to subtract), in any order: summed by key, then one join.

    Each amount is first rounded to the column's own scale, half to even, as a single increment is."""
    kind, of = base.schema[column].dataType, deltas.schema[amount].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    exact = isinstance(of, T.IntegralType) or isinstance(of, T.DecimalType) and of.scale <= scale
    one = F.col(amount).cast(f"decimal(37,{scale})") if exact else half_even(F.col(amount), 37, scale)
    wide = f"decimal(37,{scale})"  # two of them add up without losing places
    total = deltas.groupBy(*key).agg(F.sum(one).cast(wide).alias("_sum"))
    after = (not_null(F.col(column), column).cast(wide) + F.col("_sum")).cast(kind)
    return base.join(total, list(key), "left").withColumn(column, F.when(F.col("_sum").isNull(), F.col(column)).otherwise(after)).select(*base.columns)


def sub_wrap(c: Column, amount: Column, floor: int, wrap: int) -> Column:
    y = c - amount
    return F.when(y < floor, y + wrap).otherwise(y)


def fold_sub_wrap(base: DataFrame, deltas: DataFrame, key: tuple[str, ...], column: str, floor: int, wrap: int, amount: str = "amount", order: str | None = None) -> DataFrame:
    """Many wrapping subtractions at once. Within floor <= value < floor + wrap and 0 <= amount <= wrap they commute and
    fold to ((value - floor - sum) mod wrap) + floor; outside that the amounts are applied one by one, ordered by `order`.

    Amounts are gathered only for the keys that are outside; all others send sums."""
    if wrap <= floor:
        raise EngineError("invalid_argument", "sub_wrap needs wrap > floor")
    one = F.col(amount).cast("bigint")
    grouped = deltas.groupBy(*key).agg(F.sum(one).alias("_sum"), F.min(one).alias("_low"), F.max(one).alias("_high"))
    joined = base.join(grouped, list(key), "left")
    c = F.col(column).cast("bigint")
    inside = (c >= floor) & (c < floor + wrap) & (F.col("_low") >= 0) & (F.col("_high") <= wrap)
    odd = joined.where(F.col("_sum").isNotNull() & c.isNotNull() & ~inside).select(*key)
    item = F.struct(F.col(order) if order else F.lit(0).alias("_o"), one.alias("_a"))
    stepwise = deltas.join(odd, list(key), "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("_all"))
    folded = F.pmod(c - floor - F.col("_sum"), F.lit(wrap)) + floor
    stepped = F.aggregate("_all", c, lambda acc, x: sub_wrap(acc, x["_a"], floor, wrap))
    value = F.when(F.col("_sum").isNull(), c).when(inside, folded).when(not_null(F.col(column), column).isNotNull(), stepped)
    return joined.join(stepwise, list(key), "left").withColumn(column, value.cast(base.schema[column].dataType)).select(*base.columns)


def delete(base: DataFrame, key: dict[str, Any]) -> DataFrame:
    return base.where(~_same(key))


def delete_many(base: DataFrame, keys: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return base.join(keys.select(*key), list(key), "left_anti").select(*base.columns)


def upsert(base: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return delete_many(base, new, key).unionByName(new)
