"""Operator 6: exact deduplication through a log-structured merge index.

Memtables: each task gathers (digest, smallest row, count) in a bounded table and flushes it as a sorted run, cut into
shards by digest, each with a filter of its digests. Compaction: a shard's runs are merged in tiers of growing size. The
larger run's filter is probed first: what it surely does not hold is new, the rest is looked up; of equal digests the
smallest id (and row) and the summed count stay. The merged shard is one sorted run with a filter, which later batches
probe in the same way. What is answered back to a memtable is one row for each of its digests that has company, so a
digest that a third of all rows share costs each memtable one row, and each row finds its answer under (run, digest).

Hits are verified by bytes, row by row: the normalised texts of a hit and of its keeper are compared. Should digests ever
collide, the rows of the digests where texts differ are grouped by their texts instead.

Defined results: a null text equals an empty one; texts are equal when identical after each run of ASCII white space is
one space (leading and trailing runs too); of equal texts the row with the smallest doc_id stays, of several with that id
(and of several without any) the first by file and place, so one row of a group is kept; a null doc_id is larger than any
other; rows that share a doc_id but not the text are rows of their own; no rows give no rows; very long texts are hashed
and compared whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm import rowset
from keystrata.llm.common import SPACES, apart, cut, least_of_group, partitions, ship

#: Digest rows that a memtable holds before it is flushed.
MEMTABLE = 500_000
#: Rows of a shard, at most on average: a task merges one shard at a time.
SHARD_ROWS = 2_000_000
NO_ID = np.iinfo(np.int64).max
RUN = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("id", "<i8"), ("file", "<i8"), ("row", "<i8"), ("n", "<i8")])
FILTER_BITS, FILTER_PROBES = 10, 5


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def merge(rows: np.ndarray) -> np.ndarray:
    """Sort by digest; of equal digests keep the smallest id, file and row, and the sum of counts."""
    rows = rows[np.lexsort((rows["row"], rows["file"], rows["id"], rows["lo"], rows["hi"]))]
    if not len(rows):
        return rows
    first = np.flatnonzero(np.r_[True, (rows["hi"][1:] != rows["hi"][:-1]) | (rows["lo"][1:] != rows["lo"][:-1])])
    out = rows[first].copy()
    out["n"] = np.add.reduceat(rows["n"], first)
    return out


def filter_of(rows: np.ndarray) -> np.ndarray:
    """A Bloom filter of a run's digests (they are uniform bits already)."""
    bits = np.zeros(max(64, 1 << int(len(rows) * FILTER_BITS).bit_length()), dtype=bool)
    for i in range(FILTER_PROBES):
        bits[(rows["lo"] + np.uint64(i) * (rows["hi"] | np.uint64(1))) & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits)


def may_hold(bits: np.ndarray, rows: np.ndarray) -> np.ndarray:
    flags, found = np.unpackbits(bits), np.ones(len(rows), dtype=bool)
    for i in range(FILTER_PROBES):
        found &= flags[(rows["lo"] + np.uint64(i) * (rows["hi"] | np.uint64(1))) & np.uint64(len(flags) - 1)] > 0
    return found


def locate(run: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where a sorted run holds the digests of rows; -1 where it does not."""
    at, found, live = np.searchsorted(run["hi"], rows["hi"]), np.full(len(rows), -1), np.arange(len(rows))
    while len(live):  # digests that share their first half stand in a row
        live = live[at[live] < len(run)]
        live = live[run["hi"][at[live]] == rows["hi"][live]]
        same = run["lo"][at[live]] == rows["lo"][live]
        found[live[same]] = at[live[same]]
        live = live[~same]
        at[live] += 1
    return found


def absorb(run: np.ndarray, bits: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A run with another merged into it: only rows that its filter may hold are looked up."""
    at, may = np.full(len(rows), -1), np.flatnonzero(may_hold(bits, rows))
    at[may] = locate(run, rows[may])
    old = at >= 0
    run, hit, at = run.copy(), rows[old], at[old]
    mine = run[at]
    less = hit["id"] < mine["id"]
    for k, above in (("file", ("id",)), ("row", ("id", "file"))):
        less |= np.logical_and.reduce([hit[a] == mine[a] for a in above]) & (hit[k] < mine[k])
    for k in ("id", "file", "row"):
        run[k][at] = np.where(less, hit[k], mine[k])
    run["n"][at] += hit["n"]
    both = np.concatenate([run, rows[~old]])
    return both[np.lexsort((both["lo"], both["hi"]))]


def _key(batch: pa.RecordBatch, digest_bytes: int) -> np.ndarray:
    data = np.frombuffer(b"".join(x[:digest_bytes].ljust(16, b"\0") for x in batch.column("sha").to_pylist()), dtype=">u8").reshape(-1, 2)
    rows = np.zeros(len(data), dtype=RUN)
    rows["hi"], rows["lo"], rows["n"] = data[:, 0], data[:, 1], 1
    rows["id"] = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    rows["file"], rows["row"] = batch.column("file").to_numpy(), batch.column("row").to_numpy()
    return rows


def _batch(names: list[str], n: int, **columns: pa.Array) -> pa.RecordBatch:
    """Columns by name, null where there is none."""
    kinds = {"sha": pa.binary(), "block": pa.binary(), "filter": pa.binary(), "shard": pa.int32()}
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, kinds.get(k, pa.int64())) for k in names], names=names)


ROWS = "doc_id long, file long, row long, sha binary, run long, hi long, lo long, shard int, block binary, filter binary"
MERGED = "run long, hi long, lo long, keep_id long, keep_file long, keep_row long, group_size long, shard int, block binary, filter binary"


def flush_runs(digests: DataFrame, shards: int, memtable: int = MEMTABLE, digest_bytes: int = 16) -> DataFrame:
    """Rows of digests (doc_id, file, row, sha) with the run that took them, and the runs' blocks and filters by shard
    (block not null)."""
    names = [x.split()[0] for x in ROWS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        run, held, size = task << 24, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = merge(np.concatenate(held))
            shard = ((rows["hi"] >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)
            edges = np.searchsorted(shard, np.arange(shards + 1))
            own = [k for k in range(shards) if edges[k] < edges[k + 1]]
            for at in range(0, len(own), 16):
                some = own[at : at + 16]
                parts = [rows[edges[k] : edges[k + 1]] for k in some]
                yield _batch(names, len(some), run=pa.array([run] * len(some), pa.int64()), shard=pa.array(some, pa.int32()), block=pa.array([x.tobytes() for x in parts], pa.binary()), filter=pa.array([filter_of(x).tobytes() for x in parts], pa.binary()))

        for batch in batches:
            for at in range(0, batch.num_rows, memtable):
                part = batch.slice(at, memtable)
                rows = _key(part, digest_bytes)
                if size and size + len(rows) > memtable:
                    yield from flush()
                    run, held, size = run + 1, [], 0
                held.append(rows)
                size += len(rows)
                yield _batch(names, len(rows), **{k: part.column(k) for k in ("doc_id", "file", "row", "sha")}, run=pa.array(np.full(len(rows), run)), hi=pa.array(rows["hi"].view("i8")), lo=pa.array(rows["lo"].view("i8")))
        if size:
            yield from flush()

    return digests.select("doc_id", "file", "row", "sha").mapInArrow(work, ROWS)


def compact(blocks: DataFrame, shards: int) -> DataFrame:
    """Merge each shard's runs. One row for the merged run of a shard (run -1: block and filter), and for each run that
    holds a digest with company: run, hi, lo, keep_id, keep_file, keep_row, group_size."""
    names = [x.split()[0] for x in MERGED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((x.as_py() for x in row) for b in batches for row in zip(*(b.column(k) for k in ("shard", "run", "block", "filter")), strict=True))
        for shard, group in itertools.groupby(map(tuple, stream), key=lambda x: x[0]):  # sorted by shard, run
            runs, tiers = [], []
            for _, r, block, bits in group:
                runs.append((r, np.frombuffer(block, dtype=RUN)))
                tiers.append((runs[-1][1], np.frombuffer(bits, dtype=np.uint8)))
                while len(tiers) > 1 and len(tiers[-2][0]) <= 2 * len(tiers[-1][0]):
                    _merge_last(tiers)
            while len(tiers) > 1:
                _merge_last(tiers)
            whole, bits = tiers[0]
            yield _batch(names, 1, run=pa.array([-1], pa.int64()), shard=pa.array([shard], pa.int32()), block=pa.array([whole.tobytes()], pa.binary()), filter=pa.array([bits.tobytes()], pa.binary()))
            many = whole[whole["n"] > 1]
            if not len(many):
                continue
            bits = filter_of(many)
            for run, rows in runs:
                rows = rows[may_hold(bits, rows)]
                found = locate(many, rows)
                rows, hit = rows[found >= 0], many[found[found >= 0]]
                if len(rows):
                    yield _batch(names, len(rows), run=pa.array(np.full(len(rows), run)), hi=pa.array(rows["hi"].view("i8")), lo=pa.array(rows["lo"].view("i8")), keep_id=pa.array(hit["id"].astype("i8")), keep_file=pa.array(hit["file"].astype("i8")), keep_row=pa.array(hit["row"].astype("i8")), group_size=pa.array(hit["n"].astype("i8")))

    parts = min(shards, partitions(blocks.sparkSession))
    dealt = blocks.select("shard", "run", "block", "filter").repartitionById(parts, F.pmod("shard", F.lit(parts))).sortWithinPartitions("shard", "run")
    return dealt.mapInArrow(work, MERGED)


def _merge_last(tiers: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """The last two tiers become one; the larger's filter is probed with the smaller's rows."""
    (small, _), (large, bits) = sorted((tiers.pop(), tiers.pop()), key=lambda t: len(t[0]))
    whole = absorb(large, bits, small)
    tiers.append((whole, filter_of(whole)))


def extend(index: DataFrame, blocks: DataFrame, shards: int) -> DataFrame:
    """Compact an index's merged runs (rows of compact with run -1) with the runs of a later batch."""
    return compact(index.where("run = -1").select("shard", F.lit(-2).cast("long").alias("run"), "block", "filter").unionByName(blocks.select("shard", "run", "block", "filter")), shards)


OUT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "file", "row"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable: int = MEMTABLE, digest_bytes: int = 16, shards: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), and the file
    and row that tell it (see rowset; for a frame that is no scan of files, those of its written copy).

    digest_bytes: how much of the SHA-256 the index keys on (tests shorten it to force collisions).
    """
    spark = docs.sparkSession
    ship(spark)
    docs = rowset.filed(docs)
    shards = shards or max(partitions(spark), -(-docs.count() // SHARD_ROWS))
    digest = F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha")
    flushed = cut(flush_runs(docs.select(F.col(id_col).cast("long").alias("doc_id"), *rowset.place(docs), digest), shards, memtable, digest_bytes), "runs")
    answers = cut(compact(flushed.where("block is not null"), shards), "index").where("run >= 0").drop("shard", "block", "filter")
    rows = flushed.where("block is null").select("doc_id", "file", "row", "sha", "run", "hi", "lo")
    found = cut(rows.join(apart(answers), ["run", "hi", "lo"], "left").drop("run", "hi", "lo"), "found")

    hits = found.where("group_size > 1")
    texts = docs.where(rowset.build(hits.select("file", "row")).member(docs)).select(*rowset.place(docs), normalised(F.col(text_col)).alias("text"))
    known = cut(texts.join(apart(hits.select("file", "row", "keep_file", "keep_row", "group_size")), ["file", "row"]), "hit-texts")
    differ = cut(_different(known), "differ")
    if differ.isEmpty():
        return _told(found)
    group = ["keep_file", "keep_row"]
    regrouped = _by_text(found.join(apart(differ), group, "left_semi").join(apart(known.select("file", "row", "text")), ["file", "row"]))
    return _told(found.join(apart(differ), group, "left_anti")).unionByName(_told(regrouped))


def _told(found: DataFrame) -> DataFrame:
    """Rows with their keeper (doc_id, file, row, sha, keep_id, keep_file, keep_row, group_size; null: alone) as answers."""
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.nullif("keep_id", F.lit(NO_ID)))
    kept = alone | ((F.col("keep_file") == F.col("file")) & (F.col("keep_row") == F.col("row")))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "file", "row")


def _different(known: DataFrame) -> DataFrame:
    """The keepers (keep_file, keep_row) of hits that are not byte for byte their keeper's text."""
    # a large group's keeper is handed out under several salts, its copies each look under one
    salts = F.ceil(F.col("group_size") / 256).cast("int")
    own = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    keepers = known.where(own).select("keep_file", "keep_row", F.col("text").alias("keeper"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    others = known.where(~own).withColumn("salt", F.pmod(F.xxhash64("file", "row"), salts).cast("int"))
    return others.join(apart(keepers), ["keep_file", "keep_row", "salt"]).where(F.col("text") != F.col("keeper")).select("keep_file", "keep_row").distinct()


def _by_text(rows: DataFrame) -> DataFrame:
    """The exact way for colliding digests: group the rows by whole texts."""
    base = cut(rows.select("doc_id", "file", "row", "sha", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("id")), "texts")
    out = least_of_group(base, ["text"], ["id", "file", "row"])
    return out.select("doc_id", "file", "row", "sha", F.col("least.id").alias("keep_id"), F.col("least.file").alias("keep_file"), F.col("least.row").alias("keep_row"), "group_size")
