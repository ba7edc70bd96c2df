"""Operator 2: token-id output by best-fit-decreasing packing.

Each task packs its own documents, a bounded window of tokens at a time, so nothing is shuffled. Pieces are placed
longest first into the fullest sequence that still has room; a segment tree over the room left (how many open sequences
have each capacity) finds it in log2(capacity) steps. Overlong documents are split without loss. Sequences of a window
that are not full enough wait: their pieces are packed again with the next window. What waits is at most half a window
(the fullest are closed until it is), so a piece is packed a bounded number of times on average; a task's last window
closes all.

A packed sequence is a row of the id matrix (padded on writing), its cumulative segment lengths, and position numbers
that start anew at each segment. The files of the matrices are written by the task that packs, a few rows at a time, in
the smallest unsigned type that holds the vocabulary or the capacity, and the digests that come out are taken from what is
read back from them.

Defined results: a null or empty text is one piece holding the closing id; rows that repeat a doc_id, or have none, are
documents of their own; pieces of equal length go in the order in which they are met; a very long text is cut into whole
runs and a rest; no rows give no rows and no files; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import give_back, parts, read_file, ship, store
from keystrata.llm.tokens import chunk_tokens

#: Tokens that a task packs at a time, and how full a sequence must be to be closed before the last window.
WINDOW_TOKENS, FULL = 4_000_000, 0.99
#: Packed sequences of a file of the registered query.
FILE_ROWS = 256


class CapacityTree:
    """How many open sequences have each room 0..capacity; finds the least room that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, need: int) -> int:
        """The least room >= need that an open sequence has, or -1."""
        i, count = need + self.size, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:  # the nearest right neighbour on the way up that holds one
                i += 1
                while i < self.size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of piece numbers, by best-fit decreasing."""
    tree, open_at = CapacityTree(capacity), {}
    sequences: list[list[int]] = []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[piece]
        room = tree.least(n)
        if room < 0:
            sequences.append([piece])
            at, room = len(sequences) - 1, capacity
        else:
            at = open_at[room].pop()
            tree.add(room, -1)
            sequences[at].append(piece)
        if room > n:
            tree.add(room - n, 1)
            open_at.setdefault(room - n, []).append(at)
    return sequences


def _store_rows(some: pa.RecordBatch, name: str, capacity: int, pad_id: int, dtype: str) -> None:
    """The files of one batch of packed sequences."""
    short = "<u2" if capacity <= 1 << 16 else "<u4"
    for column, ext, pad, kind in (("input_ids", "ids", pad_id, dtype), ("position_ids", "positions", 0, short)):
        matrix = np.full((some.num_rows, capacity), pad, dtype=kind)
        for i, data in enumerate(some.column(column)):
            matrix[i, : len(data.as_buffer()) // 4] = np.frombuffer(data.as_buffer(), dtype="<u4")
        store(f"{name}.{ext}.{kind[1:]}", matrix.data)
    store(f"{name}.cu.i4", np.concatenate([np.array([*x, -1], dtype="<i4") for x in some.column("cu_seqlens").to_pylist()]).tobytes())


def _written(some: pa.RecordBatch, uri: str, name: str, capacity: int, pad_id: int, dtype: str) -> pa.RecordBatch:
    """Store packed sequences and give back their rows without the matrices: n_tokens, cu_seqlens and the digests are
    those of the files, read back."""
    _store_rows(some, f"{uri}/{name}", capacity, pad_id, dtype)
    flat = read_file(f"{uri}/{name}.cu.i4", "<i4")
    ends = np.flatnonzero(flat == -1)
    cu = [flat[lo:hi].tolist() for lo, hi in zip(np.r_[0, ends[:-1] + 1], ends, strict=True)]
    n_tokens = [x[-1] for x in cu]
    crcs = []
    for ext, kind in (("ids", dtype), ("positions", "<u2" if capacity <= 1 << 16 else "<u4")):
        matrix = read_file(f"{uri}/{name}.{ext}.{kind[1:]}", kind).reshape(some.num_rows, capacity)
        crcs.append([zlib.crc32(row[:k].astype("<u4")) for row, k in zip(matrix, n_tokens, strict=True)])
    rows = some.num_rows
    columns = [some.column("sequence_id"), pa.array(n_tokens, pa.int64()), some.column("doc_ids"), some.column("starts"), pa.array(cu, pa.list_(pa.int32())), *(pa.array(x, pa.int64()) for x in crcs), pa.array([name] * rows), pa.array(range(rows), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=[*some.schema.names[:7], "file", "file_row"])


ROW = "sequence_id long, n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids_crc32 long, positions_crc32 long"


def pack_best_fit(docs: DataFrame, tokenizer: str, capacity: int = 4096, closing_id: int = 2, id_col: str = "doc_id", text_col: str = "text", matrices: bool = False, window_tokens: int = WINDOW_TOKENS, uri: str | None = None, pad_id: int = 0) -> DataFrame:
    """One row for each packed sequence; with matrices also its ids and positions (unsigned 32-bit, little-endian). With a
    uri these are written under it, as write_matrices does, FILE_ROWS rows a file, and the rows have file and file_row
    instead."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = chunk_tokens(tokenizer)
        part, files = TaskContext.get().partitionId(), 0
        number = part << 33
        held: list[tuple[int | None, int, np.ndarray]] = []
        size = 0
        steps = np.arange(capacity, dtype="<u4")

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number, files
            lengths = [len(p[2]) for p in held]
            done, open_ = [], []
            for seq in best_fit(lengths, capacity):
                n = sum(lengths[i] for i in seq)
                (done if last or n >= FULL * capacity else open_).append((n, seq))
            open_.sort(key=lambda x: x[0])
            waits = sum(n for n, _ in open_)
            while waits > window_tokens // 2:  # the fullest go first
                done.append(open_.pop())
                waits -= done[-1][0]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            names = ["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids_crc32", "positions_crc32", "input_ids", "position_ids"]
            many = 9 if matrices or uri else 7
            for at in range(0, len(done), FILE_ROWS):
                rows: list[list] = [[] for _ in range(9)]
                for n, seq in done[at : at + FILE_ROWS]:
                    ids = np.concatenate([held[i][2] for i in seq])
                    positions = np.concatenate([steps[: lengths[i]] for i in seq])
                    cu = np.cumsum([0, *(lengths[i] for i in seq)]).tolist()
                    crcs = (0, 0) if uri else (zlib.crc32(ids), zlib.crc32(positions))
                    for column, value in zip(rows, (number, n, [held[i][0] for i in seq], [held[i][1] for i in seq], cu, *crcs, ids.tobytes(), positions.tobytes()), strict=True):
                        column.append(value)
                    number += 1
                some = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows[:many], kinds[:many], strict=True)], names=names[:many])
                yield _written(some, uri, f"{part:06d}-{files:06d}", capacity, pad_id, tokens.dtype) if uri else some
                files += 1
            held, size = [held[i] for _, seq in open_ for i in seq], waits

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in parts(batch.column(1), 4_000_000):
                flat, starts = tokens.encode(texts, closing_id)
                flat = flat.astype("<u4", copy=False)
                for i, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True), first):
                    for at in range(lo, hi, capacity):
                        held.append((doc_ids[i], at - lo, flat[at : min(at + capacity, hi)]))
                    size += hi - lo
                    if size >= window_tokens:
                        yield from flush(False)
                        held = [(d, k, x.copy()) for d, k, x in held]  # lets go of the batch
        if held:
            yield from flush(True)
        give_back()

    schema = ROW + (", file string, file_row int" if uri else ", input_ids binary, position_ids binary" if matrices else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)


def write_matrices(packed: DataFrame, uri: str, capacity: int = 4096, pad_id: int = 0, rows: int = 4096, dtype: str = "<u4") -> DataFrame:
    """Write packed sequences (with matrices) as binary files under uri: N.ids.* and N.positions.* hold [rows x capacity]
    unsigned numbers of the type that the name ends in, N.cu.i4 the cumulative segment lengths of its rows one after the
    other, each closed by -1. Gives back one row for each file: name, rows."""
    ship(packed.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                name = f"{part:06d}-{n:06d}"
                n += 1
                _store_rows(some, f"{uri}/{name}", capacity, pad_id, dtype)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([some.num_rows], pa.int64())], names=["name", "rows"])

    return packed.mapInArrow(work, "name string, rows long")
