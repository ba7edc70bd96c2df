"""File and directory objects: whole reads, reads at an offset, status and listings, by object id under a root folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.types import EngineError

#: Bytes that are copied at a time.
COPIED = 1 << 20


def new_id() -> str:
    """An object id: 32 hex digits, so that text order is numeric order."""
    return uuid.uuid4().hex


class Objects:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, object_id: str, path: str = "") -> str:
        parts = [p for p in path.split("/") if p]
        if ".." in parts or "/" in object_id:
            raise EngineError("invalid_path", path)
        return "/".join([self.root, object_id, *parts])

    def files(self, object_id: str, path: str = "") -> DataFrame:
        """path, modificationTime, length, content of all files below; Spark reads content only if it is asked for."""
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self._at(object_id, path))

    def read(self, object_id: str, path: str = "") -> DataFrame:
        return self.files(object_id, path).select("content")

    def pieces(self, object_id: str, path: str, offset: int, length: int) -> DataFrame:
        """The same piece of every file below, as rows; each file is read whole by its task."""
        return self.files(object_id, path).select(piece(F.col("content"), offset, length).alias("content"))

    def _open(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def pread(self, object_id: str, path: str, offset: int = 0, length: int | None = None) -> bytes:
        """A piece of one file, without reading what stands before or behind it."""
        _, at, fs = self._open(self._at(object_id, path))
        if not fs.exists(at):
            raise EngineError("not_found", f"{object_id}/{path}")
        size = fs.getFileStatus(at).getLen()
        if offset >= size:
            return b""
        stream = fs.open(at)
        try:
            stream.seek(offset)
            return bytes(stream.readNBytes(min(size - offset, size if length is None else length)))
        finally:
            stream.close()

    def pwrite(self, object_id: str, path: str, offset: int, data: bytes) -> None:
        """Bytes at an offset. Files of a distributed store do not change in place: what stands before and behind is copied
        into a new file, zeros fill a gap, and the new file takes the old one's place."""
        jvm, at, fs = self._open(self._at(object_id, path))
        part = jvm.org.apache.hadoop.fs.Path(self._at(object_id, f".{uuid.uuid4().hex}"))
        size = fs.getFileStatus(at).getLen() if fs.exists(at) else 0
        out = fs.create(part, True)

        def copy(start: int, end: int) -> None:
            if end > start:
                stream = fs.open(at)
                stream.seek(start)
                while start < end:
                    some = stream.readNBytes(min(COPIED, end - start))
                    out.write(some)
                    start += len(some)
                stream.close()

        try:
            copy(0, min(size, offset))
            out.write(bytes(max(0, offset - size)) + data)
            copy(offset + len(data), size)
        finally:
            out.close()
        self._move(fs, part, at)

    def remove(self, object_id: str, path: str = "") -> bool:
        """An object, or a file or folder in it; False where there is none."""
        _, at, fs = self._open(self._at(object_id, path))
        return bool(fs.exists(at) and fs.delete(at, True))

    def _move(self, fs, part, at) -> None:
        fs.mkdirs(at.getParent())
        fs.delete(at, False)
        if not fs.rename(part, at):
            raise EngineError("io_error", str(at))

    def stat(self, object_id: str, path: str = "") -> DataFrame:
        return self.files(object_id, path).select("path", "length", "modificationTime")

    def readdir(self, object_id: str, path: str = "") -> list[tuple[str, bool, int]]:
        """(name, is a directory, length) of what is directly below."""
        _, at, fs = self._open(self._at(object_id, path))
        if not fs.exists(at):
            raise EngineError("not_found", f"{object_id}/{path}")
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in fs.listStatus(at))

    def write(self, object_id: str, path: str, data: bytes) -> None:
        """Whole files are written at once, then moved into place."""
        jvm, at, fs = self._open(self._at(object_id, path))
        part = jvm.org.apache.hadoop.fs.Path(self._at(object_id, f".{uuid.uuid4().hex}"))
        out = fs.create(part, True)
        try:
            out.write(data)
        finally:
            out.close()
        self._move(fs, part, at)


def piece(content: Column, offset: int, length: int) -> Column:
    """Bytes offset..offset+length of a binary column."""
    return F.substring(content, offset + 1, length)
