"""Numbers inside a key without one task for a hot key."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order column that a key's rows are dealt in.
RANGES = 64


def numbered(df: DataFrame, key: list[str], order: str, name: str) -> DataFrame:
    """df with name: 1, 2, ... inside each key, by a number or time column.

    Rows are counted by (key, range of the order column), the ranges being quantiles of all rows; a row's number is its
    place in its range plus the counts of the ranges before. So a key that holds most rows is dealt to RANGES tasks. df is
    read three times. Rows with equal places in the order may be numbered either way; NULLs come first."""
    found = df.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10_000).alias("q")).first().q
    bounds = sorted(set(found or []))
    part = reduce(operator.add, [(F.col(order) > F.lit(b)).cast("int") for b in bounds], F.lit(0))
    placed = df.withColumn("_part", F.coalesce(part, F.lit(-1)))
    counts = placed.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(k).alias(f"_of_{k}") for k in key], F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = placed.withColumn(name, F.row_number().over(Window.partitionBy(*key, "_part").orderBy(order)))
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in key], F.col("_part") == F.col("_of"))
    return inside.join(bases, same).select(*df.columns, (F.col(name) + F.col("_base")).alias(name))
