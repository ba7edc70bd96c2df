"""Textual and JSON forms of values and rows. The text of a value is its JSON text, so strings are quoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions.types import ColumnType


def to_text(c: Column, kind: T.DataType) -> Column:
    """JSON text: quoted strings, dates and times; bare numbers; NULL stays NULL."""
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit('"'), F.base64(c), F.lit('"'))
    if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.when(c.isNotNull(), F.to_json(F.struct(c.cast("string").alias("v"))))
        return F.substring(text, F.lit(6), F.length(text) - 6)  # without {"v": and }
    return c.cast("string")


def from_text(c: Column, kind: ColumnType | T.DataType) -> Column:
    """Parse a value's text; strings may be quoted JSON or bare. A malformed number or date is an error."""
    kind = kind.spark if isinstance(kind, ColumnType) else kind
    unquoted = F.when(c.rlike(r'^\s*".*"\s*$'), F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")).otherwise(c)
    if isinstance(kind, T.StringType):
        return unquoted
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.from_json(c, kind)
    if isinstance(kind, T.BinaryType):
        return F.unbase64(unquoted)
    if isinstance(kind, T.DecimalType):
        return F.bround(unquoted.cast(T.DecimalType(38, max(kind.scale, 18))), kind.scale).cast(kind)
    return unquoted.cast(kind)


def rows_to_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def rows_from_json(df: DataFrame, schema: T.StructType, name: str = "json") -> DataFrame:
    return df.select(F.from_json(F.col(name), schema).alias("_r")).select("_r.*")
