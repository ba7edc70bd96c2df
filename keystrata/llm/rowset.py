"""Sets of rows of files, kept in the shared folder, and filters by them.

A row is told by a hash of its file's path and its place in the file, so rows that repeat an id, or everything, stay apart.
A set is dealt into bucket files by (file, stretch of places); a task that scans a file opens only the buckets of that
file's stretches. So a table of any size is filtered by a set of any size, exactly, without a shuffle of the table and
without sending the set.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import cut, fresh_path, partitions, read_file, ship, store

#: Places of a file that share a bucket (a power of two), and rows of a bucket.
STRETCH_BITS, BUCKET_ROWS = 16, 1_000_000
#: Buckets that a worker holds.
HELD = 8


def filed(docs: DataFrame) -> DataFrame:
    """docs as rows of Parquet files: as it is where it is a scan, filtered or projected; else written first."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().fileFormat().toString() == "Parquet":
        return docs
    return cut(docs, "rows")


def place(docs: DataFrame) -> tuple[Column, Column]:
    """The columns that tell a row of a filed frame: file (hash of the path) and row (place in the file)."""
    own = docs.metadataColumn("_metadata")
    return F.xxhash64(own["file_path"]).alias("file"), own["row_index"].alias("row")


def _bucket(file: Column, row: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(file, F.shiftright(row, STRETCH_BITS)), F.lit(buckets)).cast("int")


class RowSet:
    def __init__(self, root: str, buckets: int, present: frozenset[int]):
        self.root, self.buckets, self.present = root, buckets, present

    def keys(self, docs: DataFrame) -> list[Column]:
        """What holds() takes, of a filed frame: file, row and bucket."""
        file, row = place(docs)
        return [file, row, _bucket(file, row, self.buckets).alias("bucket")]

    def member(self, docs: DataFrame) -> Column:
        """Whether a row of a filed frame is in the set. (A mapInArrow above it would need a second worker for each task:
        there call holds() instead.)"""
        held = self

        @F.pandas_udf("boolean")
        def has(file: pd.Series, row: pd.Series, bucket: pd.Series) -> pd.Series:
            return pd.Series(held.holds(file.to_numpy(), row.to_numpy(), bucket.to_numpy()))

        return has(*self.keys(docs))

    def holds(self, file: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.zeros(len(file), dtype=bool)
        for b in np.unique(bucket):
            if int(b) not in self.present:
                continue
            rows = _load(f"{self.root}/{b}")
            for f in np.unique(file[bucket == b]):
                if f in rows:
                    at = np.flatnonzero((bucket == b) & (file == f))
                    out[at] = rows[f][np.minimum(np.searchsorted(rows[f], row[at]), len(rows[f]) - 1)] == row[at]
        return out


_held: OrderedDict[str, dict[int, np.ndarray]] = OrderedDict()


def _load(uri: str) -> dict[int, np.ndarray]:
    """A bucket: the sorted places by file."""
    if uri not in _held:
        pairs = read_file(uri, "<i8").reshape(-1, 2)
        files, first = np.unique(pairs[:, 0], return_index=True)
        _held[uri] = {f: rows for f, rows in zip(files, np.split(pairs[:, 1], first[1:]), strict=True)}
        if len(_held) > HELD:
            _held.popitem(last=False)
    _held.move_to_end(uri)
    return _held[uri]


def build(rows: DataFrame) -> RowSet:
    """The set of the distinct (file, row) pairs of a frame, which should be cheap to read twice."""
    spark = rows.sparkSession
    ship(spark)
    buckets = max(partitions(spark), -(-rows.count() // BUCKET_ROWS))
    root = fresh_path(spark, "row-set")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.stack([b.column(k).to_numpy() for k in range(3)], axis=1) for b in batches if b.num_rows]
        if found:
            whole = np.unique(np.concatenate(found), axis=0)  # bucket, file, row
            own, first = np.unique(whole[:, 0], return_index=True)
            for b, part in zip(own, np.split(whole[:, 1:], first[1:]), strict=True):
                store(f"{root}/{b}", np.ascontiguousarray(part, dtype="<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64())], names=["bucket"])

    dealt = rows.select(_bucket(F.col("file"), F.col("row"), buckets).cast("long").alias("bucket"), "file", "row").repartitionById(buckets, F.col("bucket").cast("int"))
    return RowSet(root, buckets, frozenset(r.bucket for r in dealt.mapInArrow(write, "bucket long").collect()))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """A filed frame without some of its rows (file, row); columns as they are."""
    return docs.where(~build(rows).member(docs))
