"""Versions of rows: what a snapshot sees of a change log, and what a transaction sees of its own staged writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELETE, PUT = "D", "P"


def visible(log: DataFrame, key: tuple[str, ...], snapshot: int | None = None, xid: str = "xid", op: str = "op") -> DataFrame:
    """Of an append-only log (key, xid, op, values) the latest version of each key at a snapshot, without deleted keys.

    max_by is a partial aggregate: each task sends one version a key, where a window would send and sort them all."""
    seen = log.where(F.col(xid) <= F.lit(snapshot)) if snapshot is not None else log
    rest = [c for c in log.columns if c not in key]
    latest = seen.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(xid)).alias("_v"))
    return latest.where(F.col(f"_v.{op}") != DELETE).select(*key, *[F.col(f"_v.{c}").alias(c) for c in rest if c not in (xid, op)]).select(*[c for c in log.columns if c not in (xid, op)])


def overlay(base: DataFrame, staged: DataFrame, key: tuple[str, ...], op: str = "op") -> DataFrame:
    """base under a transaction's staged writes (its columns and op): a staged row replaces, a staged delete hides."""
    live = staged.where(F.col(op) != DELETE).select(*base.columns)
    return base.join(staged.select(*key), list(key), "left_anti").select(*base.columns).unionByName(live)


def newest(changes: DataFrame, key: tuple[str, ...], version: str = "_v") -> DataFrame:
    """Of change frames (columns, op, version) each key's last change, with op and version."""
    rest = [c for c in changes.columns if c not in key]
    latest = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_c"))
    return latest.select(*key, "_c.*").select(*changes.columns)


def stack(old: DataFrame | None, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """A later set of changes (columns and op, distinct keys) on top of an earlier one."""
    if old is None:
        return new
    kept = old.join(new.select(*key), list(key), "left_anti").select(*old.columns) if key else old
    return kept.unionByName(new)


def log_of(before: DataFrame, after: DataFrame, key: tuple[str, ...], xid: int) -> DataFrame:
    """The changes between two states of a table as log rows."""
    rest = [c for c in before.columns if c not in key]
    gone = before.join(after.select(*key), list(key), "left_anti").select(*before.columns).withColumn("op", F.lit(DELETE))
    kept = before.select(*key, F.xxhash64(*rest).alias("_h")) if rest else before.select(*key, F.lit(0).alias("_h"))
    now = after.withColumn("_n", F.xxhash64(*rest) if rest else F.lit(0))
    changed = now.join(kept, list(key), "left").where(F.col("_h").isNull() | (F.col("_h") != F.col("_n"))).select(*before.columns).withColumn("op", F.lit(PUT))
    return gone.unionByName(changed).withColumn("xid", F.lit(xid).cast("long"))
