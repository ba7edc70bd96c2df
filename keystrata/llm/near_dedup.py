"""Operator 4: near-duplicates by b-bit MinHash.

1. Documents to sets of hashed word shingles. Rows with equal sets form a class; the row with its smallest id stands for
   it, so a thousand copies cost one set.
2. Minima under `bands * rows` permutations give band keys; representatives that share a key share a bucket. Bands are
   chosen so that a pair at the threshold shares no bucket with a chance below MISS. Buckets with the same members
   (near copies meet in most bands) are kept once.
3. Only members of buckets get a signature: the low 8 bits of SIGNATURE further minima, packed, and their set. In a
   bucket two documents are compared by size, then by the share of equal signature bytes, corrected for chance collisions
   (p = J + (1 - J) / 256), then by their sets. Documents that are linked already are not compared again, and what comes
   out is a forest of links, not pairs. A large bucket is dealt into blocks (find_links), so no task holds a bucket.
4. Links are confirmed on 64-bit sets, and components of links give the answer.

Every row is a document of its own, numbered when its set is first written; classes, links and components are of these
numbers, so rows that share a doc_id with different texts stay apart.

Defined results: a text without words (null, empty, blank) has an empty set and is linked with nothing; with fewer words
than a shingle takes, the whole sequence is one shingle; component_id is the smallest doc_id reachable, null where no row
has one (a null is larger than any id); kept says that a row's doc_id is its component_id, stays marks one row of each
component (of several with the smallest id, the first); very long texts are taken whole; no rows give no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm import rowset
from keystrata.llm.common import MIX_A, MIX_B, apart, cut, give_back, hand_out, hashed_words, least_of_group, partitions, parts, ship
from keystrata.llm.components import components

#: Chance that a pair just at the threshold shares no bucket.
MISS = 1e-6
#: Bytes of a signature (8 low bits each) and how many standard deviations below the threshold an estimate may fall.
SIGNATURE, DEVIATIONS = 256, 5.5
NO_ID = np.iinfo(np.int64).max
#: Members and shingles of a block of a large bucket.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000


def shingles(a: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of hashed words; the whole sequence is one if it is shorter."""
    n = len(a)
    if not n:
        return a
    if n < k:
        h = np.array([n], dtype=np.uint64)
        for i in range(n):
            h = (h ^ (h >> np.uint64(31))) * MIX_A + a[i : i + 1]
    else:
        h = a[: n - k + 1]
        for j in range(1, k):
            h = (h ^ (h >> np.uint64(31))) * MIX_A + a[j : n - k + 1 + j]
    h = (h ^ (h >> np.uint64(29))) * MIX_B
    return np.unique(h ^ (h >> np.uint64(32)))


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingles of each text."""
    for _, part in parts(texts, 4_000_000):
        flat, starts = hashed_words(part)
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield shingles(flat[lo:hi], k)


class Permutations:
    """h -> a * h + b on 32 bits, for odd a: `count` of them from a seed."""

    def __init__(self, count: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, count, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)[:, None]

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 4096):
            np.minimum(low, (self.a * x[None, i : i + 4096] + self.b).min(axis=1), out=low)
        return low


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows)"""
    rows = 5 if threshold >= 0.84 else 4 if threshold >= 0.7 else 3
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows)), rows


def set_digests(texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """texts (doc_id, text, file, row) to doc_id, file, row, n_shingles, digest (of the set), keys (of the bands; empty for
    empty sets)."""
    bands, rows = bands_for(threshold)
    schema = "doc_id long, file long, row long, n_shingles long, digest binary, keys array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = Permutations(bands * rows, 11)
        salt = np.arange(bands, dtype=np.uint64) * MIX_B
        for batch in batches:
            sizes, digests, keys = [], [], []
            for s in sets_of(batch.column(1), k):
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    low = perms.minima(s).reshape(bands, rows)
                    h = salt.copy()
                    for r in range(rows):
                        h = (h ^ (h >> np.uint64(31))) * MIX_A + low[:, r]
                    h = (h ^ (h >> np.uint64(29))) * MIX_B
                    keys.append((h ^ (h >> np.uint64(32))).view(np.int64))
                else:
                    keys.append(np.array([], dtype=np.int64))
            flat = np.concatenate(keys) if keys else np.array([], dtype=np.int64)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 2, 3)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "file", "row", "n_shingles", "digest", "keys"],
            )
        give_back()

    return texts.mapInArrow(work, schema)


def _signed(texts: DataFrame, wanted: rowset.RowSet, k: int) -> DataFrame:
    """Signature and sets of the texts (text, file, row, bucket) whose rows are wanted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = Permutations(SIGNATURE, 23)
        for batch in batches:
            batch = batch.filter(pa.array(wanted.holds(*(batch.column(i).to_numpy() for i in (1, 2, 3)))))
            for at in range(0, batch.num_rows, 512):
                part, signs, sets = batch.slice(at, 512), [], []
                for s in sets_of(part.column(0), k):
                    signs.append(perms.minima(s).astype(np.uint8).tobytes())
                    sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(signs, pa.binary()), pa.array(sets, pa.binary())], names=["file", "row", "sign", "hashes"])
        give_back()

    return texts.mapInArrow(work, "file long, row long, sign binary, hashes binary")


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return self.up
            self.up = nxt


def linked(ids: np.ndarray, side: np.ndarray, comp: np.ndarray, signs: np.ndarray, sets: list[np.ndarray], share: Fraction, crossing: bool) -> list[tuple[int, int]]:
    """A forest of links among documents with 64-bit sets, between components that are known to be linked (comp).
    crossing: compare only documents of different sides."""
    n, p, q = len(ids), share.numerator, share.denominator
    size = np.array([len(s) for s in sets])
    by = np.argsort(size, kind="stable")
    size, side, comp, signs, ids, sets = size[by], side[by], comp[by], signs[by], ids[by], [sets[i] for i in by]
    t = float(share)
    cut_at = t - DEVIATIONS * math.sqrt(t * (1 - t) / SIGNATURE)
    least = (cut_at * (1 - 1 / 256) + 1 / 256) * SIGNATURE
    forest, links = Forest(n), []
    first = np.unique(comp, return_index=True, return_inverse=True)[1:]
    forest.up = first[0][first[1]]  # a known component starts as one tree
    for i in range(n - 1):
        upto = np.searchsorted(size, size[i] * q // p, side="right")  # larger sets cannot reach the share
        if upto <= i + 1:
            continue
        others = np.arange(i + 1, upto)
        roots = forest.roots()
        others = others[roots[others] != roots[i]]
        if crossing:
            others = others[side[others] != side[i]]
        if not len(others):
            continue
        others = others[(signs[others] == signs[i]).sum(axis=1) >= least]
        if not len(others):
            continue
        own, ends = sets[i], np.cumsum(size[others])
        flat = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat(own[at] == flat, np.r_[0, ends[:-1]], dtype=np.int64)
        for j in others[q * both >= p * (size[others] + size[i] - both)]:
            x, y = forest.root(i), forest.root(j)
            if x != y:
                forest.up[max(x, y)] = min(x, y)
                links.append((int(ids[i]), int(ids[j])))
    return links


def _compare(groups: DataFrame, signed: DataFrame, share: Fraction) -> DataFrame:
    """groups (bucket, i, j, own, rep, comp) to links (a, b): all of a group with i = j, else sides against each other."""
    names = ["bucket", "i", "j", "own", "rep", "comp", "sign", "hashes"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for at in range(0, b.num_rows, 256) for row in zip(*(b.slice(at, 256).column(c).to_pylist() for c in names), strict=True))
        for (_, i, j), group in itertools.groupby(stream, key=lambda x: x[:3]):
            rows = list(group)
            if len(rows) < 2:
                continue
            ids, side, comp = (np.array([x[k] for x in rows]) for k in (4, 3, 5))
            signs = np.frombuffer(b"".join(x[6] for x in rows), dtype=np.uint8).reshape(-1, SIGNATURE)
            found = linked(ids, side, comp, signs, [np.frombuffer(x[7], dtype=np.uint64) for x in rows], share, i != j)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            rows.clear()
        give_back()

    dealt = groups.join(apart(signed), "rep").withColumn("g", F.xxhash64("bucket", "i", "j")).repartition(partitions(groups.sparkSession), "g").sortWithinPartitions("bucket", "i", "j")
    return dealt.select(*names).mapInArrow(work, "a long, b long").distinct()


def find_links(members: DataFrame, signed: DataFrame, share: Fraction) -> DataFrame:
    """members (bucket, rep, n_shingles; rep: a row's number) and signed sets to confirmed links (a, b).

    A small bucket is one group. A large one is first dealt into blocks by two different hashes, which takes two rows a
    member and joins nearly all that have links into components. Then only documents of different components are left to
    compare: components of a block or more have blocks of their own, all others share mixed blocks, and a block meets
    those of other components. That takes rows in proportion to the members times the mixed blocks.
    """
    count = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"), F.sum(F.shiftrightunsigned(F.xxhash64("rep"), 32)).alias("s1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("s2"))
    once = count.groupBy("n", "m", "s1", "s2").agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") / BLOCK_SHINGLES)).cast("long")
    dealt = cut(hand_out(members, "rep", ["bucket"], once.select("bucket", blocks.alias("blocks"))), "dealt")

    def block(salt: int) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(salt)), F.col("blocks"))

    large = dealt.where("blocks > 1")
    first = dealt.select("bucket", block(3).alias("i"), "rep").union(large.select("bucket", (block(5) + F.col("blocks")).alias("i"), "rep"))
    links = cut(_compare(first.select("bucket", "i", F.col("i").alias("j"), F.col("i").alias("own"), "rep", F.col("rep").alias("comp")), signed, share), "links-1")
    if large.isEmpty():
        return links

    lead = components(links).select(F.col("node").alias("rep"), "component")
    known = cut(large.join(apart(lead), "rep", "left").select("bucket", "rep", "n_shingles", F.coalesce("component", "rep").alias("comp")), "known")
    sizes = known.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"))
    whole = (F.col("n") >= BLOCK) | (F.col("m") >= BLOCK_SHINGLES)
    size = lambda c: F.sum(F.when(~whole, F.col(c)).otherwise(0))
    need = lambda n, m: F.greatest(F.ceil(n / BLOCK), F.ceil(m / BLOCK_SHINGLES), F.lit(1)).cast("long")
    several = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), need(size("n"), size("m")).alias("mixed")).where("k > 1").select("bucket", "mixed")
    own = sizes.where(whole).select("bucket", "comp", F.col("comp").alias("of"), need(F.col("n"), F.col("m")).alias("parts"))
    placed = hand_out(hand_out(known, "rep", ["bucket"], several), "rep", ["bucket", "comp"], own, "left")
    placed = placed.withColumns({"of": F.coalesce("of", F.lit(-1).cast("long")), "blocks": F.coalesce("parts", "mixed")}).withColumn("at", F.xxhash64("of", block(9)))
    placed = cut(placed.select("bucket", "of", "at", "rep", "comp"), "placed")
    spots = cut(placed.select("bucket", "of", "at").distinct(), "spots")
    x, y = (spots.select("bucket", F.col("of").alias(f"of_{k}"), F.col("at").alias(k)) for k in "ij")
    mixed = x.where("of_i = -1").join(y.where("of_j = -1"), "bucket").where("i <= j").union(x.where("of_i = -1").join(y.where("of_j <> -1"), "bucket"))
    heads = spots.where("of <> -1").select("bucket", "of").distinct()
    rivals = heads.select("bucket", F.col("of").alias("of_i")).join(heads.select("bucket", F.col("of").alias("of_j")), "bucket").where("of_i < of_j")
    whole = rivals.join(x, ["bucket", "of_i"]).join(y, ["bucket", "of_j"])
    pairs = cut(mixed.select("bucket", "i", "j").union(whole.select("bucket", "i", "j")), "block-pairs")
    one = pairs.join(placed.withColumnRenamed("at", "i"), ["bucket", "i"]).select("bucket", "i", "j", F.col("i").alias("own"), "rep", "comp")
    other = pairs.where("i <> j").join(placed.withColumnRenamed("at", "j"), ["bucket", "j"]).select("bucket", "i", "j", F.col("j").alias("own"), "rep", "comp")
    return links.union(_compare(one.union(other), signed, share))


#: A bucket with more than one in so many of all band rows is handed out apart; there are fewer such than that.
LARGE = 1000


def near_duplicates(docs: DataFrame, k: int = 5, share: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, class_id (smallest id with the same set), stays,
    and the file and row that tell it (see rowset; for a frame that is no scan of files, those of its written copy)."""
    spark = docs.sparkSession
    ship(spark)
    docs = rowset.filed(docs)
    text = F.col(text_col).cast("string").alias("text")
    digests = set_digests(docs.select(F.col(id_col).cast("long").alias("doc_id"), text, *rowset.place(docs)), k, float(share))
    found = cut(digests.withColumn("node", F.monotonically_increasing_id()), "digests")  # fixed once written
    full = found.where("n_shingles > 0").select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "file", "row", "node", "n_shingles", "digest")
    classed = least_of_group(full, ["digest"], ["id", "node"]).select(*full.columns[:-1], F.col("least.id").alias("class_id"), F.col("least.node").alias("class_node"))
    classed = cut(classed, "classes")
    reps = cut(classed.where("node = class_node").select("node", "id", "file", "row"), "representatives")

    keyed = cut(found.join(apart(reps.select("node")), "node", "left_semi").select(F.explode("keys").alias("bucket"), F.col("node").alias("rep"), "n_shingles"), "bands")
    shared = cut(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    most = -(-keyed.count() // LARGE)
    hot = F.broadcast(shared.where(F.col("n") > most).select("bucket"))  # fewer than LARGE
    members = cut(keyed.join(apart(shared.where(F.col("n") <= most).select("bucket")), "bucket").union(keyed.join(hot, "bucket")), "members")

    wanted = cut(members.select(F.col("rep").alias("node")).distinct().join(apart(reps), "node").select(F.col("node").alias("rep"), "file", "row"), "wanted")
    held = rowset.build(wanted.select("file", "row"))
    signed = cut(_signed(docs.select(text, *held.keys(docs)), held, k).join(apart(wanted), ["file", "row"]).select("rep", "sign", "hashes"), "signed")
    labels = components(cut(find_links(members, signed, share), "found"))

    # components are told by a row's number; what is reported is the smallest id
    led = cut(labels.join(apart(reps.select("node", "id")), "node"), "led")
    lead = least_of_group(led, ["component"], ["id", "node"]).select(F.col("node").alias("class_node"), F.col("least.id").alias("lead_id"), F.col("least.node").alias("lead_node"))
    linked = hand_out(classed, "node", ["class_node"], lead, "left")
    first_id, first = F.coalesce("lead_id", "class_id"), F.coalesce("lead_node", "class_node")
    told = linked.select("doc_id", "n_shingles", F.nullif(first_id, F.lit(NO_ID)).alias("component_id"), F.nullif("class_id", F.lit(NO_ID)).alias("class_id"), (F.col("node") == first).alias("stays"), "file", "row")
    empty = found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(True).alias("stays"), "file", "row")
    return told.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
