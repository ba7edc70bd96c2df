"""Operator 8: toxicity by a factorization machine over hashed terms.

A document's terms are its lower-case words and their first PREFIX bytes (which stand for inflected forms), each hashed
to one of BUCKETS slots. Besides a linear weight w, a slot has a vector v of FACTORS numbers, and each pair of terms in
one window adds <v_a, v_b>, so that an insult and a group's mention together can weigh more than both alone. The sum over
pairs costs no more than the terms: ((sum v)^2 - sum v^2) / 2.

Linear weights are learnt with an L1 penalty (follow-the-regularised-leader), so that the terms of neutral prose get none.
Vectors are learnt for every term that is met often enough, whatever its linear weight, as a term that is neutral alone may
weigh in a pair; a penalty of their own takes the vectors of terms without a weight that pair with nothing
back to zero. Terms with neither weight nor vector drop out of the machine, and scoring passes over them.

Long texts are taken in windows and the most toxic one decides, so a few sentences are not diluted by the rest.

Learning takes at most `most` labelled rows (those with the smallest hashes of their id, so that it does not depend on
how the table is split), and all windows of each. The driver holds up to 16 bytes for each of their words, 8 more until all
windows are made or in the two rounds that take whole texts, and weights, vectors and their sums of the learnt terms only;
it gives that memory back when the machine is made.
Every row is scored. Score = sigmoid; labels, language,
source and id are never features.

Defined results: a null or empty text has no terms and gets the bias's score; no labelled rows give a model that scores
every text alike; an empty table gives no rows; rows that repeat a doc_id, or have none, are scored each, and a label of an id
holds for each of its rows; ids with several labels take one of them; very long texts are learnt from and scored whole; other
columns are not read, whatever their names; a label that is null, or for no document, is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import crc_of, give_back, only, ship, text_slices

BUCKETS, FACTORS, PREFIX = 1 << 20, 4, 4
#: A term is learnt if that many texts of the sample have it. L1, L2 and the rate of the linear weights.
LEAST_TEXTS, L1, L2, RATE = 2, 15.0, 1.0, 2.0
#: The penalty on the vector's length of a term without a weight, and the sum of squares that its steps begin with (neutral terms move little).
SHRINK, CALM = 0.4, 0.1
#: Words of a window (windows overlap by half) and labelled rows to learn from.
WINDOW, MOST = 256, 12_000
#: Letters of any script part words from all else: ASCII non-letters are separators, A-Z become a-z.
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def slot_of(term: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(term, seed=seed) & (BUCKETS - 1)


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


class Slots(dict):
    """Words to (slot of the word) << 20 | slot of its prefix, for the first `most` words met."""

    def __init__(self, most: int = 1 << 17):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = slot_of(word, 1) << 20 | slot_of(word[:PREFIX], 2)
        if len(self) < self.most:
            self[word] = value
        return value


class Live(Slots):
    """As Slots, but with places in the list of slots that have a weight or a vector (from 1), 0 for those that have none."""

    def __init__(self, live: np.ndarray):
        super().__init__()
        self.live = {int(slot): i for i, slot in enumerate(live, 1)}

    def __missing__(self, word: bytes) -> int:
        value = self.live.get(slot_of(word, 1), 0) << 20 | self.live.get(slot_of(word[:PREFIX], 2), 0)
        if len(self) < self.most:
            self[word] = value
        return value


def terms(text: str | None, slots: Slots) -> np.ndarray:
    """The slots of all words, in order."""
    words = split(text)
    return np.fromiter(map(slots.__getitem__, words), dtype=np.int64, count=len(words))


def windows(codes: np.ndarray, size: int = WINDOW) -> list[np.ndarray]:
    """Stretches of size words that overlap by half; each as its distinct slots."""
    if not codes.any():
        return [np.zeros(0, dtype=np.int32)]
    parts = [codes] if len(codes) <= size else [codes[at : at + size] for at in range(0, len(codes) - size // 2, size // 2)]
    out = []
    for x in parts:
        x = x[x != 0]
        if len(x):
            out.append(np.unique(np.concatenate([x >> 20, x & (BUCKETS - 1)])).astype(np.int32))
    return out


class Machine:
    """bias, w and v (FACTORS wide) of a factorization machine, by slot; or by place in `live` once compact."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray, live: np.ndarray | None = None):
        self.bias, self.w, self.v, self.live = bias, w, v, live

    def compact(self) -> Machine:
        """The same with the slots that have a weight or a vector only; place 0 has none."""
        at = np.flatnonzero((self.w != 0) | self.v.any(axis=1))
        return Machine(self.bias, np.r_[0.0, self.w[at]], np.vstack([np.zeros((1, FACTORS)), self.v[at]]), at)

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of rows of distinct slots."""
        sizes = np.array([len(x) for x in rows])
        out = np.full(len(rows), self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate([rows[i] for i in full])
            at = np.r_[0, np.cumsum(sizes[full])[:-1]]
            v = self.v[flat]
            out[full] += np.add.reduceat(self.w[flat], at) + (np.add.reduceat(v, at, axis=0) ** 2 - np.add.reduceat(v * v, at, axis=0)).sum(axis=1) / 2
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The most toxic window's probability, for each text."""
        if self.live is None:
            return self.compact().score(texts)
        slots = only(("terms", self.bias, self.live.tobytes()), lambda: Live(self.live))
        rows, owner = [], []
        for i, text in enumerate(texts):
            for x in windows(terms(text, slots)):
                rows.append(x)
                owner.append(i)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, np.array(owner, dtype=np.int64), self.logits(rows))
        return 1 / (1 + np.exp(-best))


def fit(rows: Iterable[tuple[bytes, int]], seed: int = 5, epochs: int = 12, batch: int = 32, rate: float = 0.05) -> Machine:
    """Learn from (codes as int64 bytes, label). A toxic text is toxic somewhere: its most toxic window is what a step
    learns from, so clean windows of a toxic text are not taught as toxic; of a clean text it is that window too. The first
    two rounds take whole texts, as no window is known yet to be the one."""
    parts, labels, texts = [], [], np.zeros(BUCKETS, dtype=np.int32)
    for x, y in rows:  # none is kept: a generator's are gone after this
        parts.append(windows(np.frombuffer(x, dtype=np.int64)))
        labels.append(y)
        texts[np.unique(np.concatenate(parts[-1]))] += 1
    if not parts:
        return Machine(0.0, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)))
    labels = np.array(labels, dtype=np.float64)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    kept = np.flatnonzero(texts >= LEAST_TEXTS)  # the terms that are learnt; from here on a term is its place there
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    for p in parts:
        p[:] = [at[at >= 0] for at in (place[x] for x in p)]
    whole = [[np.unique(np.concatenate(p))] for p in parts]
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(len(kept)), np.zeros((len(kept), FACTORS)))
    w, v = machine.w, machine.v
    z, n, bias_n = np.zeros(len(kept)), np.zeros(len(kept)), 0.0
    g_v = np.full((len(kept), FACTORS), CALM)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        if epoch == epochs // 2:  # from here on pairs of terms count as well, those of terms without a weight too
            v[:] = rng.normal(0, 0.05, v.shape)
        if epoch == 2:
            whole.clear()
        order = rng.permutation(len(parts))
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            sides = whole if epoch < 2 else parts
            cand = [x for i in some for x in sides[i]]
            ends = np.cumsum([len(sides[i]) for i in some])
            logits = machine.logits(cand)
            pick = [int(lo + np.argmax(logits[lo:hi])) for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            err = 1 / (1 + np.exp(-logits[pick])) - labels[some]
            bias_n += float(err.sum()) ** 2
            machine.bias -= 0.1 * float(err.sum()) / (1 + np.sqrt(bias_n))
            chosen = [(cand[k], e) for k, e in zip(pick, err, strict=True) if len(cand[k])]
            if not chosen:
                continue
            size = np.array([len(x) for x, _ in chosen])
            flat, e = np.concatenate([x for x, _ in chosen]), np.repeat([y for _, y in chosen], size)
            slots, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, e, len(slots))
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / RATE
            z[slots] += g - sigma * w[slots]
            n[slots] += g * g
            zs = z[slots]
            w[slots] = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((1 + np.sqrt(n[slots])) / RATE + L2))
            if epoch >= epochs // 2:
                vx = v[flat]
                total = np.repeat(np.add.reduceat(vx, np.r_[0, np.cumsum(size)[:-1]], axis=0), size, axis=0)
                dv = e[:, None] * (total - vx)
                dv = np.stack([np.bincount(back, dv[:, f], len(slots)) for f in range(FACTORS)], axis=1) + 0.01 * v[slots]
                g_v[slots] += dv**2
                step = rate / np.sqrt(g_v[slots])
                moved = v[slots] - step * dv
                long = np.sqrt((moved**2).sum(axis=1, keepdims=True))
                less = np.maximum(0.0, 1 - SHRINK * step.mean(axis=1, keepdims=True) / np.maximum(long, 1e-12))
                v[slots] = np.where(w[slots, None] != 0, moved, moved * less)  # terms with a weight stay anyway
    v[(g_v == CALM).all(axis=1)] = 0.0  # in no window that was learnt from: still what chance gave
    machine.w, machine.v = np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS))
    machine.w[kept], machine.v[kept] = w, v
    return machine


def held_out(id_col: str) -> Column:
    return F.pmod(crc_of(id_col), F.lit(3)) == 1


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `most` rows (text, label) that are not held out: those with the smallest hashes of their id."""
    own = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    some = own.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("text", "label", "doc_id")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    ship(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = only("slots", Slots)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([terms(x, own).tobytes() for x in b.column(0).to_pylist()], pa.binary()), b.column(1)], names=["doc_id", "slots", "label"])

    def by_id() -> Iterator[tuple[pa.Buffer, int]]:  # holds what came to the driver, without a copy, until its end
        rows = labelled(docs, labels, label_col, most, id_col, text_col).mapInArrow(hashed, "doc_id long, slots binary, label int").toArrow()
        slots, label = rows.column("slots"), rows.column("label").to_pylist()
        for i in np.argsort(rows.column("doc_id").to_numpy(), kind="stable").tolist():
            yield slots[i].as_buffer(), label[i]

    machine = fit(by_id())
    give_back()  # what learning took is several times the machine
    return machine


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(machine.compact())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part, texts in text_slices(batch, rows=200):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score(texts))], names=["doc_id", "score"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine.compact())
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, at):
                yield part.filter(pa.array(sent.value.score(texts) < threshold))
        give_back()

    return docs.mapInArrow(work, docs.schema)
