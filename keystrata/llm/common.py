"""What the corpus operators share: the shared folder, tables that cut lineage, words, hashes and group minima."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: \x20 and \x09-\x0D (what bytes.split() splits at).
SPACES = r"[\x20\x09-\x0D]+"

_shipped: set[str] = set()
_own_root: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give every executor this package once per application, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="keystrata-"), f"{package}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where that is unset (local mode, as in tests) our own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = tempfile.mkdtemp(prefix="keystrata-shared-")
        spark.sparkContext.setCheckpointDir(_own_root[app])
    return _own_root[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/keystrata/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled, never broadcast, whatever its estimated size."""
    return df.hint("merge")


def crc_of(column: str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """xxh64 of words (bytes); keeps the first `most` words it meets, so memory is bounded and frequent words are kept."""

    def __init__(self, most: int = 1 << 17):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_live: dict[Any, Any] = {}


def only(key: Any, make: Callable[[], Any]) -> Any:
    """A worker process keeps the cache of one operator: asking for another's drops it."""
    if key not in _live:
        _live.clear()
        give_back()
        _live[key] = make()
    return _live[key]


def word_hashes() -> WordHashes:
    return only("words", WordHashes)


def strings(values: pa.Array) -> list:
    """The values of a string or binary array; several times as fast as to_pylist()."""
    return values.to_numpy(zero_copy_only=False).tolist()


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of texts (A-Z lowered; maximal runs of anything but ASCII white space) laid end to end, as numbers into an
    array of the distinct ones, and where each text begins (and, last, where all end). A null text has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    per = split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = split.flatten().dictionary_encode()
    of, distinct = coded.indices.to_numpy(), coded.dictionary
    real = (pc.binary_length(distinct).to_numpy() > 0)[of]  # a text that begins or ends with a blank has an empty one there
    starts = np.r_[0, np.cumsum(real)][np.r_[0, np.cumsum(per)].astype(np.int64)].astype(np.int64)
    return of[real], distinct, starts


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of texts, laid end to end, and where each text begins (and, last, where all end)."""
    of, distinct, starts = coded_words(texts)
    return word_hashes().array(strings(distinct.cast(pa.binary())))[of], starts


def parts(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of texts of about `most` bytes: (first, texts)."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most)) + 1
        yield first, texts.slice(first, last - first)
        first = last


#: Odd multipliers of the 64-bit mixer (fixed values, from the golden ratio and from xxHash).
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash pairs of 64-bit values, order-sensitive."""
    h = (a ^ (a >> np.uint64(31))) * MIX_A + b
    h = (h ^ (h >> np.uint64(29))) * MIX_B
    return h ^ (h >> np.uint64(32))


def salts(spark: SparkSession) -> int:
    """Under how many keys the rows of a large group meet what is known of it."""
    return max(16, partitions(spark))


def least_of_group(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """df with least (a struct of the order columns: the group's smallest) and group_size.

    Two levels: each (key, salt) is reduced first and the answer comes back to it, so a group that holds a third of
    all rows is spread over many join keys. Give a df that is cheap to read twice, and order columns without nulls.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts(df.sparkSession))))
    part = salted.groupBy(*key, "_salt").agg(F.min(F.struct(*order)).alias("least"), F.count(F.lit(1)).alias("group_size"))
    whole = part.groupBy(*key).agg(F.min("least").alias("least"), F.sum("group_size").alias("group_size"))
    back = part.select(*key, "_salt").join(apart(whole), key)
    return salted.join(apart(back), [*key, "_salt"]).drop("_salt")


def hand_out(rows: DataFrame, by: str, key: list[str], facts: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the facts of their key (one row a key), where one key may hold most rows: facts first go to the (key, salt)
    pairs that rows have, salts being hashes of the column `by`, and rows meet them there. rows is read twice."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts(rows.sparkSession))))
    near = salted.select(*key, "_salt").distinct().join(apart(facts), key)
    return salted.join(apart(near), [*key, "_salt"], how).drop("_salt")


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, beside their executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batch: pa.RecordBatch, column: int = 1, rows: int = 500):
    """A batch in parts of a few hundred rows: (part, its texts)."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, part.column(column).to_pylist()


def local_path(uri: str) -> str | None:
    """The path behind a URI that is mounted as files, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def store(uri: str, data: bytes) -> None:
    """Write a file of the shared folder whole: a retried or doubled task leaves one copy."""
    path = local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, inner)


def read_file(uri: str, dtype: str) -> np.ndarray:
    """A file of the shared folder, whole."""
    path = local_path(uri)
    if path:
        return np.fromfile(path, dtype)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(inner) as f:
        return np.frombuffer(f.read(), dtype)
