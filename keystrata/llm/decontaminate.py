"""Operator 5: benchmark decontamination against a broadcast set of normalised n-grams.

A window is n consecutive words of a benchmark item (a shorter item is one window). Windows are sent to the workers as
sorted hashes over the benchmark's own vocabulary, with the word ids behind each hash, so each hit is verified word by
word. A batch of documents is one run of word ids with a gap between documents; words that no benchmark item has are 0,
so most windows fall out at once.

What is sent is bounded: at most MOST_WINDOWS (window, item) rows at a time. A larger benchmark is taken in blocks of
that size, the documents are scanned once for each block, and the hits of a document are merged.

Defined results: null or empty texts and items have no words; other columns are not read; rows that repeat a doc_id
are scanned each; no documents give no rows; a very long text is scanned whole, and a tie cannot arise, as all windows count;
an empty benchmark hits nothing; items with a null item_id hit words like any other,
count together as one item, and have no place in items_sha256 (as in the SQL).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import MIX_A, MIX_B, cut, give_back, ship, text_slices
from keystrata.llm.tokens import slices

MOST_WINDOWS = 300_000
#: Everything of ASCII but digits and letters parts words; A-Z become a-z.
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def windows(bench: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (item, window), a window being its words joined by spaces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, rows = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                own = {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
                items += [item] * len(own)
                rows += own
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(rows, pa.binary())], names=["item", "window"])
                    items, rows = [], []
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(rows, pa.binary())], names=["item", "window"])

    source = bench.select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    return source.mapInArrow(work, "item string, window binary").distinct()


class Index:
    """Windows by length: sorted hashes, the word ids behind them and the items that have them."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.ids: dict[bytes, int] = {}
        by: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item, window in rows:
            seq = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in window.split(b" "))
            by.setdefault(len(seq), {}).setdefault(seq, []).append(item)
        self.lengths = []
        for length, found in sorted(by.items()):
            seqs = np.array(list(found), dtype=np.uint64).reshape(-1, length)
            hashes = self.hash(seqs.ravel(), length)[::length]
            order = np.argsort(hashes, kind="stable")
            sieve = np.zeros(1 << max(16, (len(order) * 16).bit_length()), dtype=bool)
            sieve[hashes & np.uint64(len(sieve) - 1)] = True
            items = list(found.values())
            self.lengths.append((length, hashes[order], seqs[order], [items[i] for i in order], sieve))

    @staticmethod
    def hash(ids: np.ndarray, length: int) -> np.ndarray:
        """Of each window of `length` ids."""
        n = max(0, len(ids) - length + 1)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(length):
            h = h * MIX_A + ids[j : j + n]
        h ^= h >> np.uint64(32)
        return h * MIX_B ^ (h >> np.uint64(29))

    def scan(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Of each document: where it starts in the run of all words; which words of the run are hit; its items."""
        sizes = np.array([len(d) + 1 for d in docs], dtype=np.int64)
        starts = np.r_[0, np.cumsum(sizes)]
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for d in docs for w in (*d, b"")), dtype=np.uint64, count=int(starts[-1]))
        hit, items = np.zeros(len(ids), dtype=bool), [set() for _ in docs]
        for length, hashes, seqs, owners, sieve in self.lengths:
            h = self.hash(ids, length)
            at = np.flatnonzero(sieve[h & np.uint64(len(sieve) - 1)])
            if not len(at):
                continue
            own = np.searchsorted(hashes, h[at])
            while len(at):  # hashes that collide stand in a row
                live = own < len(hashes)
                at, own = at[live], own[live]
                live = hashes[own] == h[at]
                at, own = at[live], own[live]
                if not len(at):
                    break
                true = (ids[at[:, None] + np.arange(length)] == seqs[own]).all(axis=1)
                for i, doc in zip(own[true], np.searchsorted(starts, at[true], side="right") - 1, strict=True):
                    items[doc].update(owners[i])
                for j in range(length):
                    hit[at[true] + j] = True
                at, own = at[~true], own[~true] + 1
        return starts, hit, items


ROW = "doc_id long, n_words long, hits array<int>, items array<string>"


def _scan(docs: DataFrame, sent, only_hits: bool) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, hits (start, end, start, end, ... of hit stretches of words) and items."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, part in slices(texts, [len(x or "") + 1 for x in texts], 6_000_000):
                split = [words(x) for x in part]
                starts, hit, items = index.scan(split)
                stretches: list[list[int]] = [[] for _ in part]
                edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
                for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    d = int(np.searchsorted(starts, lo, side="right")) - 1
                    stretches[d] += [lo - int(starts[d]), hi - int(starts[d])]
                out = batch.slice(first, len(part))
                columns = [*out.columns, pa.array([len(x) for x in split], pa.int64()), pa.array(stretches, pa.list_(pa.int32())), pa.array([sorted(x, key=lambda i: (i is not None, i or "")) for x in items], pa.list_(pa.string()))]
                done = pa.RecordBatch.from_arrays(columns, names=[*out.schema.names, "n_words", "hits", "items"])
                yield done.filter(pa.array([bool(x) for x in items])) if only_hits else done

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(work, f"{fields}, n_words long, hits array<int>, items array<string>")


def _merged(a):
    """Stretches of several blocks to disjoint stretches in order."""
    out: list[int] = []
    for lo, hi in sorted(zip(a[::2], a[1::2], strict=True)):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [int(lo), int(hi)]
    return out


def scan(docs: DataFrame, bench: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, text, n_words, hits (stretches of hit words: start, end, start, end, ...), items (as strings, sorted)."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(windows(bench, n, item_col, bench_text_col), "windows")
    blocks = max(1, -(-rows.count() // most_windows))
    if blocks == 1:
        return _scan(source, spark.sparkContext.broadcast(Index([(r.item, bytes(r.window)) for r in rows.collect()])), False)
    parts = []
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("item", "window"), F.lit(blocks)))
    for b in range(blocks):
        sent = spark.sparkContext.broadcast(Index([(r.item, bytes(r.window)) for r in keyed.where(F.col("block") == b).collect()]))
        parts.append(cut(_scan(source.withColumn("h", F.xxhash64("text")), sent, True).drop("text"), "hits"))
        sent.unpersist()
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)

    def merge(batches):
        for pdf in batches:
            pdf["hits"] = [_merged([int(v) for x in hits for v in x]) for hits in pdf["hits"]]
            yield pdf

    one = found.distinct().groupBy("doc_id", "h").agg(F.collect_list("hits").alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    one = one.mapInPandas(merge, "doc_id long, h long, hits array<int>, items array<string>")
    empty = Index([])
    base = _scan(source.withColumn("h", F.xxhash64("text")), spark.sparkContext.broadcast(empty), False).drop("hits", "items")
    out = base.join(one, base["doc_id"].eqNullSafe(one["doc_id"]) & (base["h"] == one["h"]), "left").drop(one["doc_id"]).drop("h")
    return out.select("doc_id", "text", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(scanned: DataFrame, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    pairs = F.expr("transform(sequence(1, size(hits) div 2), i -> hits[2 * i - 1] - hits[2 * i - 2])")
    n_hit = F.when(F.size("hits") > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0)).cast("long")
    n_items = F.size("items").cast("long")
    return scanned.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"))


def without_spans(text: str, hits: list[int]) -> str:
    """The text without its hit stretches of words (from the first byte of a stretch's first word to its last word's last)."""
    data = text.encode("utf-8", "surrogatepass")
    flat = data.translate(_WORDS)
    spots, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        spots.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for lo, hi in zip(hits[::2], hits[1::2], strict=True):
        out.append(data[last : spots[lo][0]])
        last = spots[hi - 1][1]
    return b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass")


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def without_contaminated(docs: DataFrame, bench: DataFrame, n: int = 8, least_items: int = 2, least_run: int | None = None, text_col: str = "text", **names) -> DataFrame:
    """The rows of docs, all columns, that hold windows of fewer than least_items items and no stretch of least_run hit
    words (n unless given): one short item alone, which common words may spell, does not condemn a document."""
    spark = docs.sparkSession
    ship(spark)
    rows = cut(windows(bench, n, names.get("item_col", "item_id"), names.get("bench_text_col", "text")), "windows")
    blocks = max(1, -(-rows.count() // MOST_WINDOWS))
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("item", "window"), F.lit(blocks)))
    least_run = least_run or n
    at = docs.columns.index(text_col)
    if blocks > 1:  # items of several blocks add up, so look at all of them first
        number = next(x for x in ("_row" + "_" * k for k in itertools.count()) if x not in {c.lower() for c in docs.columns})
        marked = cut(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
        hits = report_runs(scan(marked.select(F.col(number).alias("doc_id"), text_col), bench, n, text_col=text_col), least_items, least_run)
        return marked.join(hits, marked[number] == hits["doc_id"], "left_anti").drop(number)
    sent = spark.sparkContext.broadcast(Index([(r.item, bytes(r.window)) for r in keyed.collect()]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for part, texts in text_slices(batch, at):
                starts, hit, items = index.scan([words(x) for x in texts])
                edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
                longest = np.zeros(len(texts), dtype=np.int64)
                np.maximum.at(longest, np.searchsorted(starts, edge[::2], side="right") - 1, edge[1::2] - edge[::2])
                bad = (longest >= least_run) | (np.array([len(x) for x in items]) >= least_items)
                yield part.filter(pa.array(~bad))
        give_back()

    return docs.mapInArrow(work, docs.schema)


def report_runs(scanned: DataFrame, least_items: int, least_run: int) -> DataFrame:
    """doc_id of the documents to drop."""
    longest = F.expr("array_max(transform(sequence(1, size(hits) div 2), i -> hits[2 * i - 1] - hits[2 * i - 2]))")
    return scanned.where((F.size("items") >= least_items) | (F.when(F.size("hits") > 0, longest).otherwise(0) >= least_run)).select("doc_id")
