"""Range-partition rules: ordered half-open ranges of key tuples, with routing, pruning and partition scans.

Bounds compare as tuples, MINVALUE below and MAXVALUE above every value of their place. An inclusive upper limit keeps
the partition that starts at it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.types import EngineError

MIN, MAX = "MINVALUE", "MAXVALUE"


@dataclass(frozen=True)
class Part:
    name: str
    start: tuple
    end: tuple


def _rank(v: Any) -> tuple:
    return (0,) if v == MIN else (2,) if v == MAX else (1, v)


def _order(bound: tuple) -> tuple:
    return tuple(_rank(v) for v in bound)


@dataclass(frozen=True)
class RangeRule:
    name: str
    columns: tuple[str, ...]
    parts: tuple[Part, ...]

    def __post_init__(self):
        for p in self.parts:
            if len(p.start) != len(self.columns) or len(p.end) != len(self.columns):
                raise EngineError("invalid_partition", f"bounds of {p.name} must have {len(self.columns)} values")
            if _order(p.start) >= _order(p.end):
                raise EngineError("invalid_partition", f"{p.name} is empty")
        for a, b in zip(self.parts, self.parts[1:], strict=False):
            if _order(a.end) > _order(b.start):
                raise EngineError("invalid_partition", f"{a.name} and {b.name} overlap or are out of order")

    def find(self, key: tuple) -> str | None:
        """The partition that holds a key, if any."""
        at = _order(key)
        return next((p.name for p in self.parts if _order(p.start) <= at < _order(p.end)), None)

    def route(self, key: tuple) -> str:
        """The partition that holds a key."""
        if found := self.find(key):
            return found
        raise EngineError("not_found", f"{key} lies in no partition of {self.name}")

    def prune(self, low: tuple = (), high: tuple = (), low_inclusive: bool = True, high_inclusive: bool = False) -> list[str]:
        """Partitions that may hold keys between two limits, which may be prefixes or empty (no limit)."""
        n = len(self.columns)
        lo = _order(low) + ((0,) if low_inclusive else (2,),) * (n - len(low))
        hi = _order(high) + ((2,) if high_inclusive or not high else (0,),) * (n - len(high))
        touch = bool(high_inclusive and len(high) == n)
        return [p.name for p in self.parts if _order(p.end) > lo and (_order(p.start) < hi or (touch and _order(p.start) == hi))]

    def to_json(self) -> dict:
        return {"name": self.name, "columns": self.columns, "parts": [[p.name, p.start, p.end] for p in self.parts]}

    @staticmethod
    def from_json(x: dict) -> RangeRule:
        return RangeRule(x["name"], tuple(x["columns"]), tuple(Part(n, tuple(a), tuple(b)) for n, a, b in x["parts"]))


def _at_least(columns: list[Column], bound: tuple) -> Column:
    """columns >= bound as tuples."""
    if not bound:
        return F.lit(True)
    c, v = columns[0], bound[0]
    if v == MIN:
        return F.lit(True)
    if v == MAX:
        return F.lit(False)
    rest = _at_least(columns[1:], bound[1:])
    return (c > F.lit(v)) | ((c == F.lit(v)) & rest)


def partition_of(rule: RangeRule, columns: list[str]) -> Column:
    """The name of the partition that a row belongs to; NULL outside all of them."""
    own = [F.col(c) for c in columns]
    cases = [(p.name, _at_least(own, p.start) & ~_at_least(own, p.end)) for p in rule.parts]
    return reduce(lambda acc, x: acc.when(x[1], F.lit(x[0])), cases[1:], F.when(cases[0][1], F.lit(cases[0][0]))) if cases else F.lit(None).cast("string")


def with_partition(df: DataFrame, rule: RangeRule, columns: list[str], name: str = "part_id") -> DataFrame:
    return df.withColumn(name, partition_of(rule, columns))


def scan_partitions(df: DataFrame, rule: RangeRule, columns: list[str], names: list[str], part_col: str | None = None) -> DataFrame:
    """Rows of some partitions. Where the table is stored by part_col this prunes folders; else it is a key filter, which
    reaches the Parquet reader for the first column."""
    if part_col:
        return df.where(F.col(part_col).isin(names))
    own = [F.col(c) for c in columns]
    keep = [p for p in rule.parts if p.name in set(names)]
    return df.where(reduce(lambda a, b: a | b, [_at_least(own, p.start) & ~_at_least(own, p.end) for p in keep], F.lit(False)))


def ordered_scan(df: DataFrame, rule: RangeRule, columns: list[str], key: list[str]) -> DataFrame:
    """Rows in the order of the rule's partitions, then by key."""
    place = F.array_position(F.array(*[F.lit(p.name) for p in rule.parts]), partition_of(rule, columns))
    return df.orderBy(place, *key)
