"""COPY FROM and COPY TO: CSV with a header, cells in the textual form of their type, columns in declared order."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions.codecs import from_text, to_text
from keystrata.functions.types import EngineError
from keystrata.sources.catalog import TableDef

QUOTING = {"header": True, "quote": '"', "escape": '"'}


def copy_from(spark: SparkSession, table: TableDef, path: str) -> DataFrame:
    """Rows of a CSV file. The header is skipped (names do not matter), the number of columns must match, empty cells
    are NULL, malformed cells are errors."""
    head = spark.read.text(path).first()
    if head is None:
        raise EngineError("invalid_file", f"{path} has no header")
    found = len(next(iter(csv.reader([head.value]))))
    if found != len(table.columns):
        raise EngineError("invalid_file", f"{path} has {found} columns, {table.name} has {len(table.columns)}")
    raw = T.StructType([T.StructField(c.name, T.StringType()) for c in table.columns])
    # a cell with a line's end in it leaves an odd number of quotes on its line; without any, files are read in pieces
    across = not spark.read.text(path).where("(length(value) - length(replace(value, '\"', ''))) % 2 = 1").isEmpty()
    cells = spark.read.schema(raw).options(**QUOTING, mode="FAILFAST", enforceSchema=True, multiLine=across).csv(path)
    return cells.select(*[from_text(F.col(c.name), c.type).alias(c.name) for c in table.columns])


def copy_to(df: DataFrame, table: TableDef, path: str, single: bool = True) -> None:
    """Overwrite a CSV folder. single: one file, as an exported table has; False lets every task write its own."""
    cells = df.select(*[to_text(F.col(c.name), c.type.spark).alias(c.name) for c in table.columns])
    (cells.coalesce(1) if single else cells).write.mode("overwrite").options(**QUOTING).csv(path)
