"""Operator 3: an interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped files.

Counting. A task hashes its words and counts the n-grams of a bounded stretch of text at a time; each stretch leaves one
sorted block for each bucket, a bucket being a range of the hash of an n-gram's context. Merging a bucket's blocks gives
exact counts, the context's totals and the number of its followers seen once, twice and more often. Every distinct
n-gram also tells its suffix that one more word precedes it: these continuation counts, summed by the suffix's bucket,
are the next lower order's counts, down to single words.

Buckets are as many as the counted bytes of the texts ask for. A frequent word is followed by a good part of all others, so
the n-grams whose context ends in one of the hot words (those that make up half a bucket's share of all words, at most
MOST_HOT) are dealt by the hash of the whole n-gram instead, and what each bucket counts of such a context is summed in
one more step. Which words are hot decides only where counts are kept, not what they are.

Storing. Each order's bucket is a file of the sorted hashes of its n-grams with their counts, and one of the sorted
hashes of its contexts with their totals, in the shared folder, which must be mounted as files. Workers map these files;
pages that no text needs are never read.

Scoring. P(w|h) = max(c(hw) - D(c), 0) / c(h) + g(h) P(w|h'), D for counts of 1, 2 and more from the counts of counts of
each order; below single words stands the uniform distribution over the vocabulary and one unknown word. Sentences are
whole texts: words, then one end; contexts at the start are filled with a begin mark that is never predicted.

Words are told apart by 64-bit hashes; n-grams by 64-bit hashes of their context and 48 bits of their word.

Defined results: a null or empty text is just its end; rows that repeat a doc_id count and are scored each; a null
doc_id counts as the empty id when rows are held out; no training rows give a model in which every token is unknown; no
rows to score give no rows; very long texts are counted and scored whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import MIX_A, coded_words, crc_of, cut, fresh_path, give_back, hashed_words, local_path, mix, partitions, parts, ship, store, word_hashes

#: Hashes of the end of a text and of the mark before its start (fixed values; a word's hash may equal them by chance only).
END, BEGIN = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
#: Tokens that a task counts before it flushes a block.
STRETCH = 2_000_000
#: Additive constant of the base score.
ADDED = 0.1


#: Bytes of text for each bucket; buckets at most (a stretch's block has some 50 n-grams then); hot words at most.
BUCKET_BYTES, MOST_BUCKETS, MOST_HOT = 8_000_000, STRETCH // 50, 8192


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of texts (words, then the end) laid end to end, and where each text begins."""
    flat, starts = hashed_words(texts)
    return np.insert(flat, starts[1:], END), starts + np.arange(len(starts))


def contexts(flat: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order-1: the hash of the k tokens before each token of texts laid end to end (starts: their starts)."""
    out: list[np.ndarray] = []
    place = np.arange(len(flat)) - np.repeat(starts, np.diff(np.r_[starts, len(flat)]))
    for k in range(1, order):
        before = np.full(len(flat), BEGIN, dtype=np.uint64)
        before[k:] = flat[: len(flat) - k]
        before[place < k] = BEGIN
        # the hash grows to the left, so the context of k tokens ends in that of k - 1
        out.append(scattered(before) if k == 1 else mix(out[-1], before))
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash: sorted hashes stand in order of their bucket."""
    return (((hashes >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def scattered(words: np.ndarray) -> np.ndarray:
    return words * MIX_A ^ (words >> np.uint64(29))


def grouped(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns (sorted by the first) with the sums of their counts, or how often they occur."""
    n = len(columns[0])
    if not n:
        return columns, np.zeros(0, dtype=np.int64)
    if len(columns) == 1:
        order = np.argsort(columns[0], kind="stable")
    else:  # inside the first column sort by a hash of the others: equal rows meet, whatever the number of columns
        rest = columns[-1]
        for c in columns[1:-1]:
            rest = mix(c, rest)
        order = np.lexsort((rest, columns[0]))
        del rest
    columns = [c[order] for c in columns]
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    sums = np.diff(np.r_[first, n]) if counts is None else np.add.reduceat(counts[order], first)
    return [c[first] for c in columns], sums


#: In n-grams a word is told by 48 bits of its hash, which keeps what is shuffled small.
WORD_BITS = np.uint64((1 << 48) - 1)


def packed(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Contexts (8 bytes each), the last column (6 bytes if it stands behind contexts), and counts in the fewest bytes
    that hold them all."""
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << 8 * w - 1)
    last = columns[-1].tobytes() if len(columns) == 1 else columns[-1].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return bytes([width]) + b"".join(c.tobytes() for c in columns[:-1]) + last + counts.astype(f"<i{width}").tobytes()


def unpacked(data: bytes, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    width, last = data[0], 6 if columns > 1 else 8
    n = (len(data) - 1) // (8 * (columns - 1) + last + width)
    out = [np.frombuffer(data, dtype="<u8", count=n, offset=1 + 8 * n * k) for k in range(columns - 1)]
    at = 1 + 8 * n * (columns - 1)
    word = np.zeros((n, 8), dtype=np.uint8)
    word[:, :last] = np.frombuffer(data, dtype=np.uint8, count=n * last, offset=at).reshape(-1, last)
    return [*out, word.view("<u8").ravel()], np.frombuffer(data, dtype=f"<i{width}", count=n, offset=at + n * last).astype(np.int64)


ROW = "level int, bucket int, block binary, sums array<bigint>"
NAMES = ["level", "bucket", "block", "sums"]


#: The level of a hot context's partial sums is that of its n-grams plus this.
SUMS_OF_HOT = 100


def _rows(level: int, buckets: list[int], data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays([pa.array([level] * n, pa.int32()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], names=NAMES)


def is_hot(context: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether contexts of one word are among the hot ones (sorted)."""
    if not len(hot):
        return np.zeros(len(context), dtype=bool)
    return hot[np.minimum(np.searchsorted(hot, context), len(hot) - 1)] == context


def _cut(level: int, keys: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows whose buckets' keys ascend, cut at the buckets' edges."""
    edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    own = np.flatnonzero(edges[:-1] < edges[1:]).tolist()
    for at in range(0, len(own), 16):
        some = own[at : at + 16]
        yield _rows(level, some, [packed([c[edges[b] : edges[b + 1]] for c in columns], counts[edges[b] : edges[b + 1]]) for b in some])


def _blocks(level: int, columns: list[np.ndarray], counts: np.ndarray, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column: to the bucket of their context (or of the word, where they have none), those of hot
    contexts to the bucket of the n-gram."""
    if level < 2:
        yield from _cut(level, columns[0], columns, counts, buckets)
        return
    apart = is_hot(columns[-2], hot)
    yield from _cut(level, columns[0][~apart], [c[~apart] for c in columns], counts[~apart], buckets)
    if apart.any():
        columns, counts = [c[apart] for c in columns], counts[apart]
        gram = mix(columns[0], columns[-1])
        by = np.argsort(gram >> np.uint64(40), kind="stable")
        yield from _cut(level, gram[by], [c[by] for c in columns], counts[by], buckets)


def count_blocks(texts: DataFrame, order: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Blocks of the highest order (columns: context hashes, longest first, then the word) and, as level 0, of single
    words (column: the scattered word)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(held)
            starts = np.cumsum([0, *(len(x) for x in held[:-1])])
            held.clear()
            if order > 1:
                yield from _blocks(order, *grouped([*contexts(flat, starts, order)[::-1], flat & WORD_BITS]), buckets, hot)
            yield from _blocks(0, *grouped([scattered(flat)]), buckets, hot)

        for batch in batches:
            for _, part in parts(batch.column(0), 4_000_000):
                flat, starts = tokens_of(part)
                for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    held.append(flat[lo:hi])
                    size += hi - lo
                    if size >= STRETCH:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()
        give_back()

    return texts.mapInArrow(work, ROW)


def hot_words(texts: DataFrame, buckets: int) -> np.ndarray:
    """One-word contexts that make up half a bucket's share of all words or more, by counters of bounded size: of a batch
    only words that are frequent in it are counted. The begin mark is one of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        words = 0
        for batch in batches:
            for _, part in parts(batch.column(0), 4_000_000):
                of, distinct, _ = coded_words(part)
                n = np.bincount(of, minlength=len(distinct))
                words += len(of)
                often = np.flatnonzero(n > len(of) // MOST_HOT)
                for h, x in zip(scattered(word_hashes().array(distinct.take(often).cast(pa.binary()).to_pylist())).tolist(), n[often].tolist(), strict=True):
                    counts[h] = counts.get(h, 0) + x
            if len(counts) > 8 * MOST_HOT:
                counts = dict(sorted(counts.items(), key=lambda x: x[1])[-MOST_HOT:])
        keys = np.fromiter(counts, dtype=np.uint64, count=len(counts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys.tolist()], pa.int64()), pa.array([words, *counts.values()], pa.int64())], names=["word", "n"])

    found = cut(texts.mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent-words")
    total = found.where("word is null").first()
    rows = found.where(F.col("word").isNotNull() & (F.col("n") * (2 * buckets) >= (total.n if total else 0))).orderBy(F.desc("n"), "word").limit(MOST_HOT).collect()
    own = np.array([r.word for r in rows], dtype=np.int64).view(np.uint64)
    return np.sort(np.r_[own, scattered(np.array([BEGIN]))])


def part_uri(root: str, level: int, bucket: int) -> str:
    return f"{root}/{level}-{bucket}"


#: Files that a worker holds mapped.
MOST_MAPPED = 8192
_mapped: OrderedDict[str, np.ndarray] = OrderedDict()


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A file of the shared folder as a memory-mapped array."""
    if uri not in _mapped:
        path = local_path(uri)
        _mapped[uri] = np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=dtype)
        if len(_mapped) > MOST_MAPPED:
            _mapped.popitem(last=False)
    _mapped.move_to_end(uri)
    return _mapped[uri]


def pack_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """56 bits of the hash with the count in the low 8; 255 there means that the count stands in the overflow file."""
    return (hashes & ~np.uint64(255)) | np.minimum(counts, 255).astype(np.uint64)


def _merge(blocks: DataFrame, order: int, buckets: int, root: str, hot: np.ndarray) -> DataFrame:
    """Merge the blocks of each (level, bucket): write its files; give back a row of sums (total, distinct, c1..c4), the
    blocks of the next lower order, and what was counted of hot contexts. Rows of sums pass through."""

    def told(level: int, bucket: int, sums: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([bucket], pa.int32()), pa.nulls(1, pa.binary()), pa.array([sums], pa.list_(pa.int64()))], names=NAMES)

    def summed(level: int, bucket: int, rows: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Totals of hot contexts: the sums of what all buckets counted."""
        some = np.concatenate([np.frombuffer(x, dtype=CONTEXT) for x in rows])
        some = some[np.argsort(some["w"], kind="stable")]
        first = np.flatnonzero(np.r_[True, some["w"][1:] != some["w"][:-1]])
        whole = some[first]
        for k in ("n", "n1", "n2", "n3"):
            whole[k] = np.add.reduceat(some[k], first, dtype=np.int64)
        store(f"{part_uri(root, level - SUMS_OF_HOT, bucket)}.hot", whole.tobytes())
        yield told(level, bucket, [])

    def merged(level: int, bucket: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        width = max(level, 1)
        rows = [unpacked(x, width) for x in data]
        data.clear()
        columns, counts = grouped([np.concatenate([c[k] for c, _ in rows]) for k in range(width)], np.concatenate([n for _, n in rows]))
        rows.clear()
        of = part_uri(root, level, bucket)
        if level <= 1:
            store(f"{of}.words", np.rec.fromarrays([columns[0], counts.astype(np.uint64)], dtype=PAIR).tobytes())
        else:
            first = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
            sums = [np.add.reduceat(x, first, dtype=np.int64) for x in (counts, counts == 1, counts == 2, counts > 2)]
            whole = np.rec.fromarrays([columns[0][first], *(s.astype(t) for s, (_, t) in zip(sums, CONTEXT[1:], strict=True))], dtype=CONTEXT)
            apart = is_hot(columns[-2][first], hot)
            store(f"{of}.contexts", whole[~apart].tobytes())
            if apart.any():
                whole = whole[apart]
                place = bucket_of(whole["w"], buckets)
                own, edges = np.unique(place, return_index=True)
                yield _rows(SUMS_OF_HOT + level, own.tolist(), [x.tobytes() for x in np.split(whole, edges[1:])])
            gram = mix(columns[0], columns[-1])
            by = np.argsort(gram)
            gram, n = gram[by], counts[by]
            over = n >= 255
            store(f"{of}.grams", pack_counts(gram, n).tobytes())
            store(f"{of}.over", np.rec.fromarrays([gram[over] >> np.uint64(8), n[over].astype(np.uint64)], dtype=PAIR).tobytes())
            del gram, n, by, over, sums, whole
        yield told(level, bucket, [int(counts.sum()), len(counts), *(int((counts == k).sum()) for k in (1, 2, 3, 4))])
        if level > 1:
            below = columns[1:] if level > 2 else [scattered(columns[1])]
            del columns, counts
            yield from _blocks(level - 1, *grouped(below), buckets, hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if rows:
                yield from (summed if key[0] > SUMS_OF_HOT else merged)(*key, rows)
                rows.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                level, bucket = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if not batch.column(2)[i].is_valid:
                    yield batch.slice(i, 1)
                    continue
                if key != (level, bucket):
                    yield from done()
                key = level, bucket
                rows.append(batch.column(2)[i].as_py())
        yield from done()
        give_back()

    place = F.pmod(F.col("bucket") + F.when(F.col("level") == 0, buckets // 2).otherwise(0), F.lit(buckets))
    dealt = blocks.repartitionById(buckets, place).sortWithinPartitions("level", "bucket")
    return dealt.mapInArrow(work, ROW)


PAIR = [("w", "<u8"), ("n", "<u8")]
CONTEXT = [("w", "<u8"), ("n", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")]


def discounts(c1: int, c2: int, c3: int, c4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney; where the counts of counts do not give them, 0.5, 1 and 1.5, within 0 and the count."""
    if not (c1 and c2 and c3):
        return 0.5, 1.0, 1.5
    y = c1 / (c1 + 2 * c2)
    d = 1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))  # type: ignore[return-value]


class Model:
    """What is sent to workers: where the files are and a few sums. The files themselves are mapped when first needed."""

    def __init__(self, root: str, order: int, buckets: int, sums: dict[int, dict[int, list[int]]], hot: np.ndarray):
        self.root, self.order, self.buckets, self.hot = root, order, buckets, hot
        self.present = {level: sorted(of) for level, of in sums.items()}
        total = {level: np.sum(list(of.values()), axis=0).tolist() if of else [0] * 6 for level, of in sums.items() if level < SUMS_OF_HOT}
        self.train_tokens, self.vocabulary = total[0][:2]
        self.words_level = 1 if order > 1 else 0
        self.discounts = {max(level, 1): discounts(*total[level][2:]) for level in (self.words_level, *range(2, order + 1))}
        self.words_total, distinct, c1, c2 = total[self.words_level][:4]
        d1, d2, d3 = self.discounts[1]
        held = d1 * c1 + d2 * c2 + d3 * (distinct - c1 - c2)
        self.uniform = (held / self.words_total if self.words_total else 1.0) / (self.vocabulary + 1)

    def _each(self, level: int, keys: np.ndarray, kind: str, dtype, within: np.ndarray | None = None):
        """For keys (those at `within`): (positions, the bucket's file)."""
        within = np.arange(len(keys)) if within is None else within
        bucket = bucket_of(keys[within], self.buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.unique(bucket).tolist():
            if b in self._of(level):
                yield within[order[edges[b] : edges[b + 1]]], f"{part_uri(self.root, level % SUMS_OF_HOT, b)}.{kind}", dtype

    def _of(self, level: int) -> frozenset[int]:
        """The buckets that a level has files of."""
        if not hasattr(self, "_sets"):
            self._sets = {k: frozenset(x) for k, x in self.present.items()}
        return self._sets.get(level, frozenset())

    def words(self, level: int, words: np.ndarray) -> np.ndarray:
        """Counts of words (distinct, in any order)."""
        out = np.zeros(len(words), dtype=np.int64)
        keys = scattered(words)
        for at, uri, dtype in self._each(level, keys, "words", PAIR):
            file = mapped(uri, dtype)
            spot = np.minimum(np.searchsorted(file["w"], keys[at]), len(file) - 1)
            out[at] = np.where(file["w"][spot] == keys[at], file["n"][spot], 0)
        return out

    def contexts(self, level: int, hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
        out = np.zeros((len(hashes), 4), dtype=np.float64)
        for own, of, kind in ((np.flatnonzero(~hot), level, "contexts"), (np.flatnonzero(hot), level + SUMS_OF_HOT, "hot")):
            for at, uri, dtype in self._each(of, hashes, kind, CONTEXT, own):
                file = mapped(uri, dtype)
                if not len(file):
                    continue
                spot = np.minimum(np.searchsorted(file["w"], hashes[at]), len(file) - 1)
                true = file["w"][spot] == hashes[at]
                rows = file[spot[true]]
                out[at[true]] = np.stack([rows["n"], rows["n1"], rows["n2"], rows["n3"]], axis=1)
        return out

    def grams(self, level: int, context: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
        gram = mix(context, word)
        out = np.zeros(len(gram), dtype=np.int64)
        by = np.argsort(gram)  # files are searched in order
        for at, uri, dtype in self._each(level, np.where(hot, gram, context), "grams", "<u8", by):
            file = mapped(uri, dtype)
            want = gram[at] & ~np.uint64(255)
            spot = np.minimum(np.searchsorted(file, want), len(file) - 1)
            found = file[spot]
            n = np.where(found & ~np.uint64(255) == want, found & np.uint64(255), 0).astype(np.int64)
            big = np.flatnonzero(n == 255)
            if len(big):
                over = mapped(uri.removesuffix("grams") + "over", PAIR)
                n[big] = over["n"][np.searchsorted(over["w"], want[big] >> np.uint64(8))]
            out[at] = n
        return out

    def score(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the token hashes of texts (see tokens_of): n_tokens, n_known, base_score, score."""
        sizes, starts = np.diff(bounds), bounds[:-1]
        distinct, back = np.unique(flat, return_inverse=True)
        raw = self.words(0, distinct)
        base = np.log10((raw + ADDED) / (self.train_tokens + ADDED * (self.vocabulary + 1)))
        n = raw if self.words_level == 0 else self.words(1, distinct & WORD_BITS)
        p = (_less(n, self.discounts[1]) / self.words_total + self.uniform if self.words_total else np.full(len(n), self.uniform))[back]
        each = contexts(flat, starts, self.order)
        hot = is_hot(each[0], self.hot) if each else None
        for level, context in enumerate(each, 2):
            _, own, spot = np.unique(mix(context, flat & WORD_BITS), return_index=True, return_inverse=True)
            count = self.grams(level, context[own], flat[own] & WORD_BITS, hot[own])[spot]
            heads, at, of = np.unique(context, return_index=True, return_inverse=True)
            total, n1, n2, n3 = self.contexts(level, heads, hot[at]).T
            d1, d2, d3 = self.discounts[level]
            with np.errstate(divide="ignore", invalid="ignore"):
                keep = np.where(total > 0, (d1 * n1 + d2 * n2 + d3 * n3) / total, 1.0)[of]
                p = np.where(total[of] > 0, _less(count, self.discounts[level]) / total[of], 0.0) + keep * p
        known = (raw > 0)[back]
        return sizes, np.add.reduceat(known, starts, dtype=np.int64), np.add.reduceat(base[back], starts), np.add.reduceat(np.log10(p), starts)


def _less(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0)


def train(texts: DataFrame, order: int = 2, buckets: int | None = None) -> Model:
    """Count a model over a column of texts. What the driver gets are sums for each bucket and the hot words."""
    spark = texts.sparkSession
    ship(spark)
    texts = texts.select(F.col(texts.columns[0]).cast("string").alias("text"))
    root = fresh_path(spark, "lm")
    if local_path(root) is None:
        raise ValueError(f"the model's files are memory-mapped: {root} must be a folder that all machines mount as files")
    if buckets is None:
        counted = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(partitions(spark), -(-counted // BUCKET_BYTES)))
    hot = hot_words(texts, buckets) if order > 1 else np.zeros(0, dtype=np.uint64)
    rows = _merge(count_blocks(texts, order, buckets, hot), order, buckets, root, hot)
    for _ in range(1, order):
        rows = _merge(rows, order, buckets, root, hot)
    sums: dict[int, dict[int, list[int]]] = {level: {} for level in range(order + 1)}
    for r in rows.select("level", "bucket", "sums").collect():
        sums.setdefault(r.level, {})[r.bucket] = r.sums
    return Model(root, order, buckets, sums, hot)


def held_out(id_col: str) -> Column:
    return F.pmod(crc_of(id_col), F.lit(10)) == 0


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for first, part in parts(batch.column(1), 4_000_000):
                n, known, base, score = own.score(*tokens_of(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), own.train_tokens, dtype=np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
