"""Tables as immutable Parquet files under a manifest: a base and the changes since (merge on read).

A commit writes the changed rows of each table (with op and the version that they make) and then creates manifest N+1,
which must not exist yet: creating it is the commit, and whoever comes second has lost. So a statement costs what it
changes, not what the table holds. Reading joins the base with the newest change of each key.

Bases are dealt by key range and sorted by key, so a filter on the key, which reaches the base's scan, skips files and row
groups by their statistics; a table under a partition rule has a folder for each partition, and readers that know the
partitions they need list only those. The first rows of a table become its base, as far as they are puts. When a table has MOST_DELTAS change
files they are merged into one; compact() folds them into a new base. Readers hold the manifest that they began with.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions.types import EngineError
from keystrata.operators import partition, versions
from keystrata.sources.catalog import Catalog, TableDef

#: Change files of a table before they are merged into one.
MOST_DELTAS = 8
#: The folders' column of a table under a partition rule, and a table that holds nothing.
PART, EMPTY = "part_id", {"base": None, "deltas": []}


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        if self.latest() is None:
            self.commit(-1, Catalog(), {}, {})

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def latest(self) -> int | None:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max((int(x[:-5]) for x in found if x.endswith(".json") and x[:-5].isdigit()), default=None)

    def manifest(self, version: int) -> tuple[Catalog, dict[str, dict]]:
        stream = self._fs.open(self._path(f"{self.root}/manifest/{version}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        x = json.loads(text)
        return Catalog.from_json(x["catalog"]), x["data"]

    def read(self, table: TableDef, entry: dict | None, parts: list[str] | None = None) -> DataFrame:
        """parts: which partitions of a table under a rule are wanted (all rows that they hold, maybe others)."""
        return self.read_frame(table.schema, table.key, entry, parts)

    def read_frame(self, schema: T.StructType, key: tuple[str, ...], entry: dict | None, parts: list[str] | None = None) -> DataFrame:
        base = self._base(schema, entry or EMPTY, parts)
        if not entry or not entry["deltas"]:
            return base
        changes = self._changes(schema, entry)
        if not key:  # only inserts are possible
            return base.unionByName(changes.select(*base.columns))
        return versions.overlay(base, versions.newest(changes, key).drop("_v"), key)

    def _base(self, schema: T.StructType, entry: dict, parts: list[str] | None) -> DataFrame:
        if not entry["base"]:
            return self.spark.createDataFrame([], schema)
        if not entry.get("parted"):
            return self.spark.read.schema(schema).parquet(f"{self.root}/{entry['base']}")
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.StringType())])).parquet(f"{self.root}/{entry['base']}")
        return (rows if parts is None else rows.where(F.col(PART).isin(parts))).select(*schema.names)

    def _changes(self, schema: T.StructType, entry: dict) -> DataFrame:
        wide = T.StructType([*schema.fields, T.StructField("op", T.StringType()), T.StructField("_v", T.LongType())])
        return self.spark.read.schema(wide).parquet(*[f"{self.root}/{p}" for p in entry["deltas"]])

    def changed_since(self, schema: T.StructType, key: tuple[str, ...], entry: dict, version: int) -> DataFrame | None:
        """Keys that changed after a version, with op; None where changes since then have gone into a base."""
        if entry.get("upto", -1) > version:
            return None
        if not entry["deltas"]:
            return self.spark.createDataFrame([], T.StructType([*[schema[k] for k in key], T.StructField("op", T.StringType())]))
        return versions.newest(self._changes(schema, entry).where(F.col("_v") > version).select(*key, "op", "_v"), key).drop("_v")

    def _write(self, name: str, df: DataFrame, key: tuple[str, ...] = ()) -> str:
        path = f"data/{name}/{uuid.uuid4().hex}"
        (df.sortWithinPartitions(*key) if key else df).write.parquet(f"{self.root}/{path}")
        return path

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Rows written beside a table's data, for a commit to come; no manifest names them, so vacuum() takes them away."""
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self._write(name, df)}")

    def _write_base(self, name: str, df: DataFrame, catalog: Catalog, version: int, key: tuple[str, ...]) -> dict:
        """Rows by key range, sorted by key; in a folder for each partition where a rule is bound."""
        path = f"data/{name}/{uuid.uuid4().hex}"
        table = catalog.tables.get(name)
        if table is not None and table.rule:
            df = partition.with_partition(df, catalog.rule(table.rule), list(table.rule_columns), PART)
            df.repartitionByRange(PART, *key).sortWithinPartitions(PART, *key).write.partitionBy(PART).parquet(f"{self.root}/{path}")
            return {"base": path, "deltas": [], "parted": True, "upto": version}
        (df.repartitionByRange(*key).sortWithinPartitions(*key) if key else df).write.parquet(f"{self.root}/{path}")
        return {"base": path, "deltas": [], "upto": version}

    def commit(self, base: int, catalog: Catalog, data: dict[str, dict], whole: dict[str, DataFrame | None], changed: dict[str, tuple[DataFrame, tuple[str, ...]]] | None = None) -> int:
        """Write new bases (whole; None: no rows) and changes (columns and op, with the key), and the next manifest; another commit since
        base is a conflict."""
        data = dict(data)
        for name, df in whole.items():
            key = catalog.tables[name].key if name in catalog.tables else ()
            data[name] = {**EMPTY, "upto": base + 1} if df is None else self._write_base(name, df, catalog, base, key)  # what it folds
        for name, (df, key) in (changed or {}).items():
            entry = data.get(name) or EMPTY
            if key and not entry["base"] and not entry["deltas"]:
                data[name] = self._write_base(name, df.where(F.col("op") == versions.PUT).drop("op"), catalog, base + 1, key)
                continue
            made = df.withColumn("_v", F.lit(base + 1).cast("long"))
            entry = {**entry, "deltas": [*entry["deltas"], self._write(name, made, key)]}
            if key and len(entry["deltas"]) >= MOST_DELTAS:
                schema = T.StructType([f for f in df.schema.fields if f.name != "op"])
                entry["deltas"] = [self._write(name, versions.newest(self._changes(schema, entry), key), key)]
            data[name] = entry
        data = {k: v for k, v in data.items() if k in catalog.tables or k.startswith("__")}
        self._create(f"{self.root}/manifest/{base + 1}.json", json.dumps({"catalog": catalog.to_json(), "data": data}).encode(), base + 1)
        return base + 1

    def _create(self, target: str, content: bytes, version: int) -> None:
        """A manifest, whole or not at all, and only where there is none: by a hard link in a local folder; elsewhere by a
        rename, which a distributed file system refuses where the target exists."""
        at, part = self._path(target), self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        try:
            out.write(content)
        finally:
            out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(part.toUri().getPath(), at.toUri().getPath())
                self._fs.delete(part, False)
            elif self._fs.exists(at) or not self._fs.rename(part, at):
                raise FileExistsError(target)
        except FileExistsError:
            self._fs.delete(part, False)
            raise EngineError("conflict", f"version {version} was committed meanwhile") from None

    def compact(self, name: str) -> int:
        """Fold a table's changes into a new base."""
        version = self.latest()
        catalog, data = self.manifest(version)
        table = catalog.table(name)
        return self.commit(version, catalog, data, {name.lower(): self.read(table, data.get(name.lower()))})

    def vacuum(self, keep: int = 1, grace: float = 3600) -> int:
        """Delete data that none of the last `keep` manifests names; returns how many folders went. Folders written in the
        last `grace` seconds stay, as a commit under way may be about to name them."""
        last = self.latest()
        used = {p for v in range(max(0, last - keep + 1), last + 1) if self._fs.exists(self._path(f"{self.root}/manifest/{v}.json")) for e in self.manifest(v)[1].values() for p in (e["base"], *e["deltas"])}
        gone, before = 0, (time.time() - grace) * 1000
        top = self._path(f"{self.root}/data")
        for table in self._fs.listStatus(top) if self._fs.exists(top) else []:
            for version in self._fs.listStatus(table.getPath()):
                if f"data/{table.getPath().getName()}/{version.getPath().getName()}" not in used and version.getModificationTime() <= before:
                    gone += bool(self._fs.delete(version.getPath(), True))
        return gone
