"""Change logs as streams: a stream of (key, xid, op, values) kept as a table's current rows. This goes beyond keyed
tables at rest; each micro-batch is reduced to its latest version of a key before it meets the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.operators import versions


def latest(batch: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of a batch, each key's last change, with xid and op."""
    rest = [c for c in batch.columns if c not in key]
    return batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("xid")).alias("_v")).select(*key, "_v.*").select(*batch.columns)


def apply_batch(base: DataFrame, batch: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return versions.overlay(base, latest(batch, key).drop("xid"), key)


def follow(stream: DataFrame, table: str, engine, checkpoint: str):
    """Keep an engine's table up to date from a stream; a repeated batch leaves the same rows."""
    key = engine.session().catalog().table(table).key

    def each(batch: DataFrame, _: int) -> None:
        s = engine.session()
        s.apply_changes(table, latest(batch, key))
        s.close()

    writer: Callable = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.start()
