"""Column types: their DDL spellings, Spark types, defaults, and how literals and parameters are fitted to a column."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EngineError(Exception):
    """An error with a short code, such as not_found or duplicate_key."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


#: Spellings of each family. Fixed values.
SPELLINGS = {
    "i32": ("INT", "INTEGER", "INT4"),
    "i64": ("BIGINT", "INT8"),
    "f32": ("FLOAT",),
    "f64": ("DOUBLE", "REAL", "FLOAT8", "DOUBLE PRECISION"),
    "string": ("CHAR", "VARCHAR", "TEXT", "STRING"),
    "i128": ("HUGEINT",),
    "numeric": ("NUMERIC", "DECIMAL"),
    "date": ("DATE",),
    "time": ("TIME",),
    "timestamp": ("TIMESTAMP",),
    "timestamptz": ("TIMESTAMPTZ", "TIMESTAMP WITH TIME ZONE"),
    "binary": ("BINARY", "BYTEA"),
    "fs": (),
}
FAMILY = {spelling: family for family, names in SPELLINGS.items() for spelling in names}


@dataclass(frozen=True)
class ColumnType:
    family: str
    params: tuple[int, ...] = ()
    fs_type: str | None = None

    @property
    def spark(self) -> T.DataType:
        if self.family == "numeric":
            p, s = (*self.params, 38, 0)[:2] if len(self.params) != 1 else (self.params[0], 0)
            return T.DecimalType(p, s)
        return {
            "i32": T.IntegerType(), "i64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType(), "string": T.StringType(), "i128": T.DecimalType(38, 0), "date": T.DateType(),
            "time": T.LongType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "binary": T.BinaryType(), "fs": T.StringType(),
        }[self.family]

    @property
    def keyable(self) -> bool:
        """Floating point, binary and file columns cannot be part of a key."""
        return self.family not in ("f32", "f64", "binary", "fs")

    def default(self) -> Any:
        """What a NOT NULL column that an INSERT leaves out is given under the compatibility switch."""
        return {
            "i32": 0, "i64": 0, "f32": 0.0, "f64": 0.0, "string": "", "i128": decimal.Decimal(0), "numeric": decimal.Decimal(0), "date": dt.date(1970, 1, 1), "time": 0,
            "timestamp": dt.datetime(1970, 1, 1), "timestamptz": dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), "binary": b"", "fs": None,
        }[self.family]


def parse_type(name: str, params: tuple[int, ...] = ()) -> ColumnType:
    family = FAMILY.get(" ".join(name.upper().split()))
    if family is None:
        raise EngineError("unsupported_type", f"no column type {name}")
    if family == "numeric":
        p, s = (*params, 0)[:2] if params else (38, 0)
        if not (0 < p <= 38 and 0 <= s <= p):
            raise EngineError("unsupported_type", f"numeric({p},{s})")
        params = (p, s)
    if family in ("time", "timestamp", "timestamptz") and params and params[0] > 6:
        raise EngineError("unsupported_type", f"{name}({params[0]})")
    return ColumnType(family, params)


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: ColumnType
    nullable: bool = True
    key: int | None = None
    meta: dict = field(default_factory=dict, compare=False)


def half_even(c: Column, precision: int, scale: int) -> Column:
    """NUMERIC rounding: half to even, and an error (ANSI) when the precision is too small."""
    return F.bround(c.cast("decimal(38,18)") if scale < 18 else c, scale).cast(f"decimal({precision},{scale})")


def truncate_time(micros: Column, digits: int) -> Column:
    """Microseconds cut to `digits` decimal places of a second, towards minus infinity."""
    step = 10 ** (6 - digits)
    return (F.floor(micros / F.lit(step)) * F.lit(step)).cast("long") if step > 1 else micros.cast("long")


def truncate_timestamp(c: Column, digits: int) -> Column:
    if digits >= 6:
        return c
    step = 10 ** (6 - digits)
    micros = F.unix_micros(c.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(step)))


def fit(value: Any, column: ColumnDef) -> Any:
    """A literal or parameter as a value of a column; raises where a database would."""
    t = column.type
    if value is None:
        return None
    bad = EngineError("type_mismatch", f"{value!r} does not fit column {column.name} ({t.family})")
    try:
        if t.family in ("i32", "i64", "i128", "time"):
            if isinstance(value, str) and t.family != "time":
                raise bad
            if t.family == "time" and isinstance(value, (str, dt.time)):
                v = dt.time.fromisoformat(value) if isinstance(value, str) else value
                micros = ((v.hour * 60 + v.minute) * 60 + v.second) * 1_000_000 + v.microsecond
                step = 10 ** (6 - (t.params[0] if t.params else 6))
                return micros // step * step
            n = int(value)
            if n != value:
                raise bad
            bits = {"i32": 31, "i64": 63, "time": 63}.get(t.family)
            if bits and not -(1 << bits) <= n < 1 << bits:
                raise bad
            return decimal.Decimal(n) if t.family == "i128" else n
        if t.family == "numeric":
            p, s = t.params
            with decimal.localcontext(decimal.Context(prec=76)):
                d = decimal.Decimal(str(value) if isinstance(value, float) else value).quantize(decimal.Decimal(1).scaleb(-s), decimal.ROUND_HALF_EVEN)
            if len(d.as_tuple().digits) > p and d != 0:
                raise bad
            return d
        if t.family in ("f32", "f64"):
            return float(value)
        if t.family in ("string", "fs"):
            if not isinstance(value, str):
                raise bad
            return value
        if t.family == "date":
            return dt.date.fromisoformat(value) if isinstance(value, str) else value
        if t.family in ("timestamp", "timestamptz"):
            v = dt.datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else value
            if t.family == "timestamptz" and v.tzinfo is None:
                v = v.replace(tzinfo=dt.timezone.utc)
            step = 10 ** (6 - (t.params[0] if t.params else 6))
            return v.replace(microsecond=v.microsecond // step * step)
        return bytes(value)
    except (ValueError, TypeError, decimal.InvalidOperation) as e:
        raise bad from e


def schema_of(columns: list[ColumnDef] | tuple[ColumnDef, ...]) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.type.spark, True) for c in columns])
