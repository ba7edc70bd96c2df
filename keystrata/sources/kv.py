"""Ordered key/value data: a DataFrame of (key BINARY, value BINARY), keys unique. Ranges are [start, end) in byte order;
an empty end means no end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.operators import dml

SCHEMA = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def get(kv: DataFrame, key: bytes) -> DataFrame:
    return kv.where(F.col("key") == F.lit(bytearray(key))).select("value")


def scan(kv: DataFrame, start: bytes = b"", end: bytes = b"", ordered: bool = True) -> DataFrame:
    out = kv
    if start:
        out = out.where(F.col("key") >= F.lit(bytearray(start)))
    if end:
        out = out.where(F.col("key") < F.lit(bytearray(end)))
    return out.orderBy("key") if ordered else out


def put(kv: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert rows (key, value; distinct keys)."""
    return dml.upsert(kv, rows.select("key", "value"), ("key",))


def delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return dml.delete_many(kv, keys, ("key",))


def exists(kv: DataFrame, key: bytes) -> bool:
    return not get(kv, key).isEmpty()
