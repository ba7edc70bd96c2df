import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keystrata.llm import best_fit, packing
from keystrata.llm.common import parts
from keystrata.llm.tokens import ChunkTokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["End. End, END. it's. x'S, H\u0331. \u1e96, ?!. 5. a.b. É. é, <|STARTOFTEXT|>. <|endoftext|>, ..", "Σ. ΟΔΟΣ. İ, ǅ.", "", None, "hello world", "a" * 3000, "x \x1c y z <|endoftext|> Ünï İΣς", " \n\t ", "word " * 50, "word " * 50, "It's 12 o'clock?!", "日本語 テスト", "heat*** re%%% are.*** straße,öl; ÿ! don't. l's, word<|endoftext|> a<b µm ªº x@y.z {brace} `tick` ½"] + [f"some text number {i} " * (i % 13) for i in range(40)]


def encode(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def test_chunked_tokens_equal_whole_texts():
    whole = [np.array(encode(t)[:-1], dtype="<u4").tobytes() for t in TEXTS]
    for most in (0, 7, 10_000):
        c = ChunkTokens(PATH, most=most)
        for _ in range(2):
            flat, starts = c.encode(pa.array(TEXTS, pa.string()))
            assert [flat[a:b].astype("<u4").tobytes() for a, b in zip(starts, starts[1:])] == whole
            closed, ends = c.encode(pa.array(TEXTS, pa.string()).slice(3, 5), 2)
            assert [closed[a:b].tolist() for a, b in zip(ends, ends[1:])] == [encode(t) for t in TEXTS[3:8]]
        assert len(c.words.place) <= most and len(c.chunks.place) <= most
    assert [len(x) for x in c.encode(pa.array([], pa.string()), 2)] == [0, 1] and c.dtype == "<u2"


def test_light_words_equal_the_whole_tokenizer():
    """Every run of Latin letters and punctuation, through the light way and the whole one."""
    rng = random.Random(4)
    letters, marks = "abcdefghijklmnopqrstuvwxyzßàéîöøüýþÿ", "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + "".join(rng.choice(marks) for _ in range(rng.choice([0, 0, 1, 3]))) for _ in range(4000)]
    c = ChunkTokens(PATH, most=0)
    assert c.light is not None and [len(x) for x in c.encode(pa.array(words))] == [len(c.encode(pa.array(words))[0]), 4001]
    flat, starts = c.encode(pa.array(words))
    whole = Tokenizer.from_file(PATH)
    assert [flat[a:b].tolist() for a, b in zip(starts, starts[1:])] == [e.ids for e in whole.encode_batch(words, add_special_tokens=False)]


def test_parts_cover_all_texts():
    texts = pa.array(["a" * 5, None, "", "b" * 50, "c", "d"])
    for most in (1, 6, 20, 1000):
        got = [x for _, part in parts(texts, most) for x in part.to_pylist()]
        assert got == texts.to_pylist() and [f for f, _ in parts(texts, most)][0] == 0


def check_pieces(rows, texts, capacity):
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids, at = np.array(encode(text), dtype="<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows), len(seqs)


@pytest.mark.parametrize("capacity", [8, 64, 4096])
def test_pack_documents(docs_of, capacity):
    rows = packing.pack_documents(docs_of(TEXTS, clash=["length", "bucket"]), PATH, capacity).collect()
    check_pieces(rows, TEXTS, capacity)


def test_ties_and_one_length_for_all(docs_of):
    texts = ["same words here"] * 101
    rows = packing.pack_documents(docs_of(texts), PATH, 16).collect()
    total, n = check_pieces(rows, texts, 16)
    assert n == -(-101 // (16 // len(encode(texts[0]))))


def test_shuffled_join_of_many_placements(docs_of, spark):
    pieces = packing.cut_into_pieces(docs_of(TEXTS), PATH, 32, 2, 4)
    a = {(r.doc_id, r.start): (r.sequence_id, r.offset) for r in packing.pack(pieces, 32).collect()}
    b = {(r.doc_id, r.start): (r.sequence_id, r.offset) for r in packing.pack(pieces, 32, most_sent=0).collect()}
    assert a == b and len(a) > 50


def test_empty_table_and_ids(docs_of, spark):
    assert packing.pack_documents(docs_of(["x"]).where("doc_id < 0"), PATH).count() == 0
    packed = packing.pack_documents(docs_of(["one two", "three"]), PATH, keep_ids=True)
    row = packing.sequences(packed).first()
    assert list(np.frombuffer(bytes(row.ids), "<u4")) in ([*encode("one two"), *encode("three")], [*encode("three"), *encode("one two")])


def test_placement_is_shortest_pack_first():
    rng = random.Random(1)
    for _ in range(50):
        capacity = rng.choice([10, 50])
        hist = {n: rng.randint(1, 9) for n in rng.sample(range(1, capacity + 1), rng.randint(1, 8))}
        placed, count = packing.place(hist, capacity)
        rooms = []
        for n in sorted(hist, reverse=True):  # one pack at a time
            for _ in range(hist[n]):
                k = max(range(len(rooms)), key=rooms.__getitem__, default=None)
                if k is None or rooms[k] < n:
                    rooms.append(capacity)
                    k = len(rooms) - 1
                rooms[k] -= n
        used = np.zeros(count, dtype=int)
        for length, _, n, first, at in placed:
            assert (used[first : first + n] == at).all()
            used[first : first + n] += length
        assert sorted(capacity - used) == sorted(rooms) and used.sum() == sum(k * v for k, v in hist.items())
    assert packing.place({}, 8)[1] == 0
    big, n = packing.place({5: 10**12, 3: 10**12}, 8)
    assert (len(big), n) == (2, 10**12)  # counts, not pieces


# --- best fit -----------------------------------------------------------------------------------------------------------
def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(100):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 120))]
        rooms = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [k for k, r in enumerate(rooms) if r >= lengths[i]]
            if fits:
                rooms[min(fits, key=rooms.__getitem__)] -= lengths[i]
            else:
                rooms.append(40 - lengths[i])
        got = best_fit.best_fit(lengths, 40)
        assert sorted(i for s in got for i in s) == list(range(len(lengths)))
        assert sorted(40 - sum(lengths[i] for i in s) for s in got) == sorted(rooms)


@pytest.mark.parametrize("window", [50, 4_000_000])
def test_best_fit_documents(docs_of, window):
    rows = best_fit.pack_best_fit(docs_of(TEXTS, clash=["starts"]), PATH, 64, matrices=True, window_tokens=window).collect()
    got, seen = defaultdict(list), set()
    for r in rows:
        ids = np.frombuffer(bytes(r.input_ids), "<u4")
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] <= 64 and zlib.crc32(bytes(r.input_ids)) == r.ids_crc32
        want = np.concatenate([np.arange(b - a) for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])])
        assert (np.frombuffer(bytes(r.position_ids), "<u4") == want).all() and zlib.crc32(bytes(r.position_ids)) == r.positions_crc32
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            got[d].append((s, list(ids[a:b])))
        seen.add(r.sequence_id)
    assert len(seen) == len(rows)
    for i, t in enumerate(TEXTS):
        assert sum((x for _, x in sorted(got[i])), []) == encode(t)


def test_registered_query_writes_matrices(spark):
    import os

    from keystrata.llm.common import shared_root
    from keystrata.llm.queries import op2_best_fit

    top = f"{shared_root(spark).removeprefix('file://')}/keystrata"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    rows = op2_best_fit(spark, "/root/testdata/sf0.001").collect()
    [new] = [x for x in set(os.listdir(top)) - before if x.startswith("matrices-")]
    names = sorted(x.removesuffix(".ids.u2") for x in os.listdir(f"{top}/{new}") if x.endswith(".ids.u2"))
    got = []
    for name in names:
        cu = np.fromfile(f"{top}/{new}/{name}.cu.i4", "<i4")
        ends = cu[np.flatnonzero(cu == -1) - 1]
        pair = [np.fromfile(f"{top}/{new}/{name}.{ext}.u2", "<u2").reshape(len(ends), 4096).astype("<u4") for ext in ("ids", "positions")]
        got += [(int(n), *(zlib.crc32(m[i, :n].tobytes()) for m in pair), name, i) for i, n in enumerate(ends)]
    assert rows and sorted(got) == sorted((r.n_tokens, r.ids_crc32, r.positions_crc32, r.file, r.file_row) for r in rows)
    plain = best_fit.pack_best_fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PATH).collect()
    assert sorted((tuple(r)[:7] for r in rows), key=str) == sorted(map(tuple, plain), key=str)
    texts = {r.doc_id: encode(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    pieces = defaultdict(list)
    for r in rows:
        assert r.n_tokens == r.cu_seqlens[-1] <= 4096
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces[d].append((s, b - a))
    for d, ids in texts.items():
        at = 0
        for s, n in sorted(pieces.pop(d)):
            assert s == at
            at += n
        assert at == len(ids)
    assert not pieces


@pytest.mark.parametrize("words,each", [(32, 1), (61, 1), (20, 3)])
def test_what_waits_is_bounded(spark, words, each):
    """Pieces that fill 52 % or 97 % of a sequence, or fit by threes, over many windows: no window is packed again and again."""
    import time

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("word " * words).alias("text")).coalesce(1)
    began = time.perf_counter()
    rows = best_fit.pack_best_fit(docs, PATH, 64, window_tokens=64 * 200).select("doc_ids").collect()
    assert time.perf_counter() - began < 30
    assert len(rows) == -(-20_000 // each) and sorted(d for r in rows for d in r.doc_ids) == list(range(20_000))


def test_repeated_and_missing_ids(docs_of):
    """Rows that repeat an id, or have none, are documents of their own; and a very long text."""
    texts = [(5, "one two"), (5, "one two"), (5, "three"), (None, "four five"), (None, None), (9, "long " * 300_000)]
    lengths = sorted(len(encode(t)) for _, t in texts)
    first = packing.pack_documents(docs_of(texts), PATH).collect()
    assert sorted(r.doc_tokens for r in first if r.start == 0) == lengths and sum(r.length for r in first) == sum(lengths)
    places = {(r.sequence_id, r.offset) for r in first}
    assert len(places) == len(first)
    second = best_fit.pack_best_fit(docs_of(texts), PATH).collect()
    assert sum(r.n_tokens for r in second) == sum(lengths) and sum(s == 0 for r in second for s in r.starts) == len(texts)


def test_matrices_round_trip(docs_of, tmp_path):
    packed = best_fit.pack_best_fit(docs_of(TEXTS), PATH, 32, matrices=True).cache()
    files = best_fit.write_matrices(packed, str(tmp_path / "m"), 32, pad_id=9, rows=5).collect()
    assert sum(f.rows for f in files) == packed.count()
    tokens = 0
    for f in files:
        ids = np.fromfile(tmp_path / "m" / f"{f.name}.ids.u4", "<u4").reshape(f.rows, 32)
        cu = np.fromfile(tmp_path / "m" / f"{f.name}.cu.i4", "<i4")
        ends = [x[-1] for x in np.split(cu, np.flatnonzero(cu == -1) + 1)[:-1] for x in [x[:-1]]]
        assert len(ends) == f.rows and all((row[n:] == 9).all() for row, n in zip(ids, ends))
        tokens += sum(ends)
    assert tokens == sum(len(encode(t)) for t in TEXTS)
    assert best_fit.pack_best_fit(docs_of(["x"]).where(F.lit(False)), PATH).count() == 0
