"""Reads by key: point, key prefix, key range and residual conditions, and which of them a condition amounts to."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.types import EngineError

COMPARE = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "!=": operator.ne, "<>": operator.ne}
#: What an operator becomes when its sides change places.
MIRROR = {"=": "=", "!=": "!=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: Any

    def as_column(self) -> Column:
        if self.value is None:  # as in SQL: a comparison with NULL holds for no row
            return F.lit(None).cast("boolean")
        return COMPARE[self.op](F.col(self.column), F.lit(self.value))


@dataclass(frozen=True)
class Path:
    """How a table is reached: full, key, prefix or range; with the conditions on the key and the rest."""

    kind: str
    key: tuple[Condition, ...]
    residual: tuple[Condition, ...]


def classify(conditions: list[Condition], key: tuple[str, ...]) -> Path:
    equal = {c.column: c for c in conditions if c.op == "=" and c.column in key and c.value is not None}
    prefix = []
    for k in key:
        if k not in equal:
            break
        prefix.append(equal[k])
    if key and len(prefix) == len(key):
        own, kind = prefix, "key"
    else:
        follow = key[len(prefix)] if len(prefix) < len(key) else None
        ranges = [c for c in conditions if c.column == follow and c.op in ("<", "<=", ">", ">=") and c.value is not None]
        own, kind = prefix + ranges, "range" if ranges else "prefix" if prefix else "full"
    return Path(kind, tuple(own), tuple(c for c in conditions if c not in own))


def where_all(df: DataFrame, conditions: list[Condition] | tuple[Condition, ...]) -> DataFrame:
    """A conjunction; NULL on either side drops the row."""
    return df.where(reduce(operator.and_, [c.as_column() for c in conditions])) if conditions else df


def point(df: DataFrame, key: dict[str, Any], columns: list[str] | None = None) -> DataFrame:
    """The row with a whole primary key, or none."""
    out = where_all(df, [Condition(c, "=", v) for c, v in key.items()])
    return out.select(*columns) if columns else out


def prefix(df: DataFrame, key: tuple[str, ...], values: tuple, columns: list[str] | None = None) -> DataFrame:
    if len(values) > len(key):
        raise EngineError("invalid_key", f"{len(values)} values for a key of {len(key)}")
    return point(df, dict(zip(key, values, strict=False)), columns)


def key_range(df: DataFrame, column: str, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
    conditions = []
    if low is not None:
        conditions.append(Condition(column, ">=" if low_inclusive else ">", low))
    if high is not None:
        conditions.append(Condition(column, "<=" if high_inclusive else "<", high))
    return where_all(df, conditions)


def first(df: DataFrame, key: list[str]) -> DataFrame:
    """The row with the smallest key: one partial aggregate for each task, no sort."""
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(*key)).alias("_r")).where("_r is not null").select("_r.*")


def last(df: DataFrame, key: list[str]) -> DataFrame:
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(*key)).alias("_r")).where("_r is not null").select("_r.*")


def ends(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows with the smallest and with the largest key (structs first and last), in one pass; no rows for no rows."""
    row, by = F.struct(*df.columns), F.struct(*key)
    return df.agg(F.min_by(row, by).alias("first"), F.max_by(row, by).alias("last")).where("first is not null")
