"""Token ids of whole texts by a public tokenizer, a batch of texts at a time.

The tokenizer drops white space and never looks across it (normalisation, added tokens and pre-tokens all stay inside
a chunk), so a text's ids are its chunks' ids in a row. Texts are cut at ASCII white space (other white space may stay
inside a chunk, where the tokenizer drops it), and Arrow numbers the distinct chunks of a batch. Lower-case Latin words and
the punctuation behind them are pre-tokens of their own; such words, which are most, go many at a time through a copy of the
tokenizer that need not look for pre-tokens, and frequent ones come from a bounded cache. All else goes through the whole
tokenizer, chunk by chunk. The ids of the texts are then gathered from those of the chunks.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from keystrata.llm.common import only, strings

#: Lower-case letters of Latin-1, and ASCII punctuation (without ' and <, which begin contractions and added tokens) behind them.
_WORD = r"\A(?P<word>[a-zß-öø-ÿ]+)(?P<marks>[!-&(-/:;=-@\[-`{-~]*)\z"
#: Words that the light tokenizer takes in one text, and texts that it takes at a time.
_LINE, _LINES = 100, 200


def lowered(chunk: str) -> str:
    """A-Z to a-z, as the tokenizer will do, where that cannot change anything else: without characters that compose
    with letters (all of Latin-1 is safe) and without marks of added tokens, which are told by case."""
    if "<|" in chunk:
        return chunk
    try:
        return chunk.encode("latin-1").lower().decode("latin-1")
    except UnicodeEncodeError:
        return chunk


def lower(texts: pa.Array) -> pa.Array:
    """The same for texts."""
    narrow = pc.string_is_ascii(texts)
    others = pc.invert(narrow)
    if pc.any(others).as_py():
        wide = np.zeros(len(texts), dtype=bool)
        at = np.flatnonzero(others.fill_null(False).to_numpy(zero_copy_only=False))
        wide[at] = pc.match_substring_regex(texts.take(pa.array(at)), r"[^\x{0}-\x{ff}]").to_numpy(zero_copy_only=False)
        narrow = pa.array(~wide)
    return pc.if_else(pc.and_(narrow, pc.invert(pc.match_substring(texts, "<|"))), pc.ascii_lower(texts), texts)


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of a pool laid end to end."""
    ends = np.cumsum(sizes)
    at = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return pool[at]


def _light(path: str):
    """A tokenizer of the same merges for texts of lower-case Latin letters and blanks, without a search for pre-tokens, and
    which ids end a word; None where the vocabulary is of another kind: no mark at the ends of words, or another way to part
    words or to write their bytes."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
    suffix = made["model"].get("end_of_word_suffix")
    if made["model"].get("type") != "BPE" or not suffix or [x["type"] for x in steps] != ["Split", "ByteLevel"] or "[\\p{L}]+" not in str(steps[0]["pattern"].get("Regex")) or steps[1]["add_prefix_space"]:
        return None, None
    light = Tokenizer.from_file(path)
    light.normalizer = normalizers.Sequence([])
    light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocab = light.get_vocab(with_added_tokens=True)
    last = np.zeros(max(vocab.values()) + 1, dtype=bool)
    last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
    return light, last


class Kept:
    """The ids of at most `most` strings; a string is kept when it is met in a second batch, so that the many that occur once
    do not fill it."""

    def __init__(self, most: int, longest: int = 64, seen_bits: int = 22):
        self.most, self.longest = most, longest
        self.place: dict[str, int] = {}
        self.starts, self.pool = np.zeros(most + 2, dtype=np.int64), np.zeros(4 * most + 4, dtype="<u4")
        self.seen = np.zeros(1 << seen_bits, dtype=bool)

    def look(self, names: list[str], make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, starts, sizes) of the ids of distinct strings; make gives (ids, sizes) of those that are not kept."""
        place = np.fromiter(map(self.place.get, names, [-1] * len(names)), dtype=np.int64, count=len(names))
        at = np.flatnonzero(place < 0)
        if not len(at):
            return self.pool, self.starts[place], self.starts[place + 1] - self.starts[place]
        fresh = [names[i] for i in at.tolist()]
        ids, size = make(fresh)
        used = int(self.starts[len(self.place)])
        starts, sizes = self.starts[place], self.starts[np.maximum(place, 0) + 1] - self.starts[np.maximum(place, 0)]
        own = np.cumsum(size) - size
        starts[at], sizes[at] = used + own, size
        pool = np.concatenate([self.pool[:used], ids])
        self._keep(fresh, ids, own, size)
        return pool, starts, sizes

    def _keep(self, fresh: list[str], ids: np.ndarray, own: np.ndarray, size: np.ndarray) -> None:
        slot = np.fromiter(map(hash, fresh), dtype=np.int64, count=len(fresh)) & (len(self.seen) - 1)
        again = np.flatnonzero(self.seen[slot])
        self.seen[slot] = True
        for i in again[: self.most - len(self.place)].tolist():
            k = len(self.place)
            lo, hi = int(self.starts[k]), int(self.starts[k]) + int(size[i])
            if hi > len(self.pool):
                return
            if len(fresh[i]) <= self.longest:
                self.pool[lo:hi] = ids[own[i] : own[i] + size[i]]
                self.starts[k + 1] = hi
                self.place[fresh[i]] = k


class ChunkTokens:
    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.light, self.last = _light(path)
        self.words, self.chunks = Kept(most), Kept(most // 5)

    @property
    def dtype(self) -> str:
        """The smallest unsigned type that holds the vocabulary."""
        return "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def encode(self, texts: pa.Array, closing: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts laid end to end, each with the closing id behind it, and where each text begins (and, last,
        where all end). A null text is empty."""
        split = pc.ascii_split_whitespace(lower(texts))
        per = split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        of = coded.indices.to_numpy()
        pool, sizes = self._chunks(coded.dictionary)
        n = sizes[of]
        flat = gathered(pool, (np.cumsum(sizes) - sizes)[of], n)
        starts = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(per)].astype(np.int64)].astype(np.int64)
        if closing is None:
            return flat, starts
        return np.insert(flat, starts[1:], closing), starts + np.arange(len(starts))

    def _chunks(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks laid end to end, and how many each has."""
        n = len(distinct)
        starts, sizes = np.zeros((n, 2), dtype=np.int64), np.zeros((n, 2), dtype=np.int64)
        pools, used = [], 0

        def put(at: np.ndarray, side: int, found: tuple[np.ndarray, np.ndarray, np.ndarray], of: np.ndarray) -> None:
            nonlocal used
            starts[at, side], sizes[at, side] = used + found[1][of], found[2][of]
            pools.append(found[0])
            used += len(found[0])

        odd = np.arange(n)
        if self.light is not None:
            parts = pc.extract_regex(distinct, _WORD)
            plain = parts.is_valid().to_numpy(zero_copy_only=False)
            odd, at = np.flatnonzero(~plain), np.flatnonzero(plain)
            both = parts.filter(pa.array(plain)).flatten()
            for side, (column, kept, make) in enumerate(((both[0], self.words, self._words), (both[1], self.chunks, self._whole))):
                coded = column.dictionary_encode()
                put(at, side, kept.look(strings(coded.dictionary), make), coded.indices.to_numpy())
        if len(odd):
            names = [lowered(x) for x in strings(distinct.take(pa.array(odd)))]
            own = {x: i for i, x in enumerate(dict.fromkeys(names))}
            put(odd, 0, self.chunks.look(list(own), self._whole), np.fromiter(map(own.__getitem__, names), dtype=np.int64, count=len(names)))
        flat = gathered(np.concatenate(pools) if pools else np.zeros(0, dtype="<u4"), starts.ravel(), sizes.ravel())
        return flat, sizes.sum(axis=1)

    def _whole(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for at in range(0, len(chunks), 20_000):
            for enc in self.tokenizer.encode_batch_fast(chunks[at : at + 20_000], add_special_tokens=False):
                ids += enc.ids
                sizes.append(len(enc))
        return np.array(ids, dtype="<u4"), np.array(sizes, dtype=np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin letters, many at a time: the last token of each is told by its end mark."""
        lines = [words[at : at + _LINE] for at in range(0, len(words), _LINE)]
        ids, sizes = [], []
        for at in range(0, len(lines), _LINES):
            for line, enc in zip(lines[at : at + _LINES], self.light.encode_batch_fast([" ".join(x) for x in lines[at : at + _LINES]], add_special_tokens=False), strict=False):
                own = np.array(enc.ids, dtype="<u4")
                size = np.diff(np.r_[0, np.flatnonzero(self.last[own]) + 1])
                if len(size) != len(line):  # a word of which the vocabulary lacks a letter
                    own, size = self._whole(line)
                ids.append(own)
                sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)


def chunk_tokens(path: str) -> ChunkTokens:
    """One tokenizer and cache for each worker process."""
    return only(("chunks", path), lambda: ChunkTokens(path))


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is (on the machine that asks)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(values: list, cost: list[int], most: int):
    """Consecutive slices of values whose costs sum to about `most`, so that a batch of long texts is taken in parts."""
    start = total = 0
    for i, c in enumerate(cost):
        total += c
        if total >= most:
            yield start, values[start : i + 1]
            start, total = i + 1, 0
    if start < len(values):
        yield start, values[start:]
