"""Operator 7: edit-aware token counts.

A document's pre-tokens are kept in leaves of a segment tree; every node has the sum of its characters and of its tokens.
An edit finds its leaves by descending through the sums of characters, re-encodes these leaves with what stands before
them as context, goes on leaf by leaf until a pre-token ends where an untouched leaf began (from there on the old
pre-tokens stand, as a pre-token depends only on what follows its start), and updates the sums on the way up. The total
is at the root.

count_with_edits builds trees and edits them in one pass; build_trees keeps them as rows, which edit_trees takes with a later
batch of edits and gives back edited.

A pre-token depends on at most LOOK characters beyond its end, so leaves whose text ends that far before an edit stand.

Defined results: a null or empty text has 0 tokens; null edits mean none; edits are applied in order, each to the text
that the one before has left; bounds outside the text are moved to its ends; rows that repeat a doc_id, or have none, are
counted each; a very long text is one tree of its task; no rows give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import only, ship

#: Pre-tokens of a leaf when it is built; a leaf is split when it has four times as many. Characters that a pre-token may look ahead.
LEAF, LOOK = 64, 4


class Counter:
    """Pre-tokens of texts and their numbers of tokens, through a bounded cache."""

    def __init__(self, ranks_path: str, pattern: str, most: int = 500_000):
        import base64

        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, int] = {}
        self.most = most
        self.encoded = 0

    def count(self, pieces: list[str]) -> int:
        self.encoded += len(pieces)
        try:
            return sum(map(self.cache.__getitem__, pieces))
        except KeyError:
            pass
        total = 0
        for p in pieces:
            n = self.cache.get(p)
            if n is None:
                n = len(self.encoding.encode_ordinary(p))
                if len(self.cache) < self.most and len(p) <= 64:
                    self.cache[p] = n
            total += n
        return total


def counter(ranks_path: str, pattern: str) -> Counter:
    return only(("counts", ranks_path, pattern), lambda: Counter(ranks_path, pattern))


class TokenTree:
    """A text as leaves of whole pre-tokens under sums of characters and tokens."""

    def __init__(self, text: str, counter: Counter, leaf: int = LEAF):
        self.counter, self.leaf = counter, leaf
        self._build(self._leaves(counter.split(text)))

    def _leaves(self, pieces: list[str]) -> list[tuple[str, int]]:
        out = []
        for at in range(0, len(pieces), self.leaf):
            own = pieces[at : at + self.leaf]
            out.append(("".join(own), self.counter.count(own)))
        return out

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.size = 1 << max(0, (len(leaves) - 1).bit_length()) if leaves else 1
        self.texts = [x for x, _ in leaves] + [""] * (self.size - len(leaves))
        pad = [0] * (self.size - len(leaves))
        self.chars = [0] * self.size + [len(x) for x, _ in leaves] + pad
        self.tokens = [0] * self.size + [n for _, n in leaves] + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at a position, and where it starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i] and (start + self.chars[i] < self.chars[1]):
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _set(self, k: int, text: str, n: int) -> None:
        self.texts[k] = text
        i = k + self.size
        chars, tokens = len(text) - self.chars[i], n - self.tokens[i]
        while i:
            self.chars[i] += chars
            self.tokens[i] += tokens
            i //= 2

    def dumped(self) -> bytes:
        """The leaves: their sizes and numbers of tokens, then the text."""
        texts, tokens = self.texts, self.tokens[self.size :]
        own = [k for k in range(self.size) if texts[k]]
        head = np.array([len(own), *(len(texts[k]) for k in own), *(tokens[k] for k in own)], dtype="<i8")
        return head.tobytes() + "".join(texts).encode("utf-8", "surrogatepass")

    @classmethod
    def loaded(cls, data: bytes, counter: Counter, leaf: int = LEAF) -> TokenTree:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        head = np.frombuffer(data, "<i8", 2 * n, 8).tolist()
        text, at, leaves = data[8 * (2 * n + 1) :].decode("utf-8", "surrogatepass"), 0, []
        for size, tokens in zip(head[:n], head[n:], strict=True):
            leaves.append((text[at : at + size], tokens))
            at += size
        tree = cls.__new__(cls)
        tree.counter, tree.leaf = counter, leaf
        tree._build(leaves)
        return tree

    def change(self, edits: list[dict | None] | None) -> None:
        for c in edits or ():
            if c is not None:
                self.edit(c["start"] or 0, c["end"] if c["end"] is not None else c["start"] or 0, c["text"] or "")

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters start..end."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        if not self.length:
            self._build(self._leaves(self.counter.split(replacement)))
            return
        first, at = self._find(max(0, start - LOOK))
        last, last_at = self._find(max(end - 1, start - 1, 0))
        upto = last + 1
        old_end = last_at + len(self.texts[last])
        region = "".join(self.texts[first:upto])
        region = region[: start - at] + replacement + region[end - at :]
        while True:
            # what follows the region only decides where its last pre-tokens end
            ahead, k = "", upto
            while k < self.size and len(ahead) <= LOOK:
                ahead += self.texts[k]
                k += 1
            done, pieces, spot = False, [], 0
            for p in self.counter.split(region + ahead):
                if spot >= len(region):
                    break
                pieces.append(p)
                spot += len(p)
            done = spot == len(region)
            if done or upto >= self.size:
                break
            region += self.texts[upto]
            old_end += len(self.texts[upto])
            upto += 1
        slots = upto - first
        if len(pieces) > 4 * self.leaf * slots or (slots > 1 and self.size > 1 and not self.length):
            leaves = [(x, n) for x, n in zip(self.texts[:first], self.tokens[self.size : self.size + first], strict=True) if x]
            leaves += self._leaves(pieces)
            leaves += [(x, n) for x, n in zip(self.texts[upto:], self.tokens[self.size + upto :], strict=True) if x]
            self._build(leaves)
            return
        share = -(-len(pieces) // slots) or 1
        for k in range(slots):
            own = pieces[k * share : (k + 1) * share]
            self._set(first + k, "".join(own), self.counter.count(own))


SCHEMA = "doc_id long, n_chars_edited long, n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long"


def count_with_edits(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """Token counts of each text before and after its edits (array of structs start, end, text). n_pretokens: how many
    were encoded to build the tree; n_reencoded: how many more the edits took."""
    ship(docs.sparkSession)
    edits = F.col(edits_col) if edits_col else F.lit(None).cast("array<struct<start:int,end:int,text:string>>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(ranks_path, pattern)
        for batch in batches:
            columns: list[list[int]] = [[] for _ in range(5)]
            for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                before = own.encoded
                tree = TokenTree(text or "", own)
                built, total = own.encoded, tree.total
                tree.change(changes)
                for column, value in zip(columns, (tree.length, total, tree.total, built - before, own.encoded - built), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_chars_edited", "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), edits.alias("edits")).mapInArrow(work, SCHEMA)


TREE = "doc_id long, tree binary, n_tokens long"


def _trees(rows: DataFrame, ranks_path: str, pattern: str, make) -> DataFrame:
    """rows (doc_id, text or tree, edits) to trees."""
    ship(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                trees = []
                for x, changes in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    trees.append(make(x, own))
                    trees[-1].change(changes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.dumped() for t in trees], pa.binary()), pa.array([t.total for t in trees], pa.int64())], names=["doc_id", "tree", "n_tokens"])

    return rows.mapInArrow(work, TREE)


def build_trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text: doc_id, its tree, n_tokens. Write it, for edits to come."""
    none = F.lit(None).cast("array<struct<start:int,end:int,text:string>>")
    return _trees(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"), none), ranks_path, pattern, lambda x, own: TokenTree(x or "", own))


def edit_trees(trees: DataFrame, ranks_path: str, pattern: str, edits_col: str = "edits") -> DataFrame:
    """Trees (doc_id, tree, and an array of edits) after their edits; only what the edits touch is encoded."""
    return _trees(trees.select("doc_id", "tree", edits_col), ranks_path, pattern, TokenTree.loaded)
