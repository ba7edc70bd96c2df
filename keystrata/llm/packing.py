"""Operator 1: shortest-pack-first histogram packing.

Documents are cut into pieces of at most `capacity` tokens (whole runs first, the rest as one piece). Only the histogram
of piece lengths, at most `capacity` numbers, reaches the driver. There lengths are placed longest first, each into the
packing pattern that is the shortest so far (has most room), while counts of patterns are updated: a group of n equal
packs is split when fewer than n pieces are left. Groups are runs of consecutive sequence ids, so a placement is five
numbers: length, first rank, how many, first sequence, offset. Pieces get their rank among equal lengths and are joined
to the placements by rank.

A rank is a piece's position in its (length, bucket) plus what earlier buckets hold; buckets are hashes of the document's
number in its task, so a length that a third of all pieces share, or an id that they share, is ranked by many tasks.

Defined results: a null or empty text is one piece holding just the closing id; rows that repeat a doc_id, or have none, are
packed as documents of their own (equal pieces are interchangeable); pieces of equal length go by bucket, doc_id and start;
a very long text is cut into whole runs and a rest; no rows give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import apart, cut, give_back, partitions, parts, ship
from keystrata.llm.tokens import chunk_tokens

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def cut_into_pieces(docs: DataFrame, tokenizer: str, capacity: int, closing_id: int, buckets: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece; with keep_ids also its ids (unsigned 32-bit, little-endian)."""
    schema = T.StructType(T._parse_datatype_string(PIECE).fields + ([T.StructField("ids", T.BinaryType())] if keep_ids else []))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chunk_tokens(tokenizer)
        for batch in batches:
            for first, texts in parts(batch.column(1), 4_000_000):
                flat, starts = tokens.encode(texts, closing_id)
                flat = flat.astype("<u4", copy=False)
                n = np.diff(starts)
                per = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), per)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * capacity
                length = np.minimum(capacity, n[doc] - start)
                at = starts[doc] + start
                ids = [flat[lo:hi].tobytes() for lo, hi in zip(at.tolist(), (at + length).tolist(), strict=True)]
                take = pa.array(first + doc)
                out = [batch.column(0).take(take), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, ids)), pa.int64()), pa.array(n[doc]), batch.column(2).take(take)]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.binary())] if keep_ids else []), names=schema.names)
        give_back()

    ship(docs.sparkSession)
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("bucket")).mapInArrow(pieces, schema)


def place(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Placements (length, first rank, how many, first sequence, offset) and the number of sequences.

    The heap holds groups of equal packs by room. Each step takes a whole group, splits one or opens one, so placements
    grow with the lengths that there are, not with the pieces.
    """
    groups: list[tuple[int, int, int]] = []  # (minus the room, first sequence, packs)
    placed: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if not groups or -groups[0][0] < length:  # a new pack stays the shortest until it is full
                each = capacity // length
                for packs, deep in ((left // each, each), (1, left % each)):
                    if packs and deep:
                        placed += [(length, rank + i * packs, packs, sequences, i * length) for i in range(deep)]
                        if capacity > deep * length:
                            heapq.heappush(groups, (deep * length - capacity, sequences, packs))
                        rank, sequences = rank + deep * packs, sequences + packs
                break
            room, first, packs = heapq.heappop(groups)
            n = min(packs, left)
            if n < packs:
                heapq.heappush(groups, (room, first + n, packs - n))
            placed.append((length, rank, n, first, capacity + room))
            if -room > length:
                heapq.heappush(groups, (room + length, first, n))
            rank, left = rank + n, left - n
    return np.array(placed, dtype=np.int64).reshape(-1, 5), sequences


#: Placements are sent to all workers up to this many (40 bytes each); beyond it they are joined through a shuffle.
MOST_SENT = 500_000


def pack(pieces: DataFrame, capacity: int, most_sent: int = MOST_SENT) -> DataFrame:
    """Add sequence_id and offset to pieces (with doc_id, start, length, bucket). pieces should be cheap to read thrice."""
    spark = pieces.sparkSession
    counts = cut(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if histogram and max(histogram) > capacity:
        raise ValueError(f"a piece has {max(histogram)} tokens, more than the capacity of {capacity}")
    placed, _ = place(histogram, capacity)

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start")
    ranked = pieces.withColumn("rank", F.row_number().over(inside).cast("long") - 1).join(apart(bases), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket")

    if len(placed) > most_sent:
        steps = spark.createDataFrame(pa.table(dict(zip(("length", "first", "n", "sequence", "at"), placed.T, strict=True))).to_pandas())
        span = F.lit(1 << 16)  # a placement is found by the blocks of ranks that it covers
        cover = steps.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / span), F.floor((F.col("first") + F.col("n") - 1) / span))))
        found = ranked.withColumn("block", F.floor(F.col("rank") / span)).join(apart(cover), ["length", "block"]).where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
        return found.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first")).withColumn("offset", F.col("at")).drop("block", "first", "n", "sequence", "at", "rank")

    order = np.lexsort((placed[:, 1], placed[:, 0]))
    sent = spark.sparkContext.broadcast(placed[order])
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        starts = {int(x): i for i, x in reversed(list(enumerate(table[:, 0])))}
        ends = {int(x): i + 1 for i, x in enumerate(table[:, 0])}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.zeros(len(rank), dtype=np.int64)
            by = np.argsort(length, kind="stable")
            values, first = np.unique(length[by], return_index=True)
            for k, value in enumerate(values):
                rows = by[first[k] : first[k + 1] if k + 1 < len(first) else len(by)]
                lo, hi = starts[int(value)], ends[int(value)]
                at[rows] = lo + np.searchsorted(table[lo:hi, 1], rank[rows], side="right") - 1
            step = table[at] if len(at) else table[:0]
            out = [batch.column(f) for f in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*out, pa.array(step[:, 3] + rank - step[:, 1]), pa.array(step[:, 4])], names=schema.names)

    return ranked.mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, closing_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Documents to pieces with sequence_id and offset; keep_ids carries the ids as well.

    A text is tokenized once: the pieces (about 40 bytes each without ids) and their buckets are kept in the shared folder.
    """
    pieces = cut_into_pieces(docs, tokenizer, capacity, closing_id, partitions(docs.sparkSession), id_col, text_col, keep_ids)
    return pack(cut(pieces, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids to one row for each sequence: its ids in order and its documents. A sequence has at most
    `capacity` tokens, so a group is small."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    empty = F.lit(b"")
    ids = F.aggregate("p", empty, lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.expr("transform(p, x -> x.doc_id)").alias("doc_ids"), F.expr("transform(p, x -> x.offset)").alias("offsets"), ids.alias("ids"))
