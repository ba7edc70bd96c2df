"""What is known of tables, partition rules, placements and file types, kept as one small JSON document."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from keystrata.functions.types import ColumnDef, ColumnType, EngineError, schema_of
from keystrata.operators.partition import RangeRule


@dataclass(frozen=True)
class TableDef:
    """columns in declared order; key: names of the primary key in key order."""

    name: str
    columns: tuple[ColumnDef, ...]
    key: tuple[str, ...]
    rule: str | None = None
    rule_columns: tuple[str, ...] = ()

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise EngineError("duplicate_column", f"{self.name}({', '.join(names)})")
        for k in self.key:
            if not self.column(k).type.keyable:
                raise EngineError("unsupported_type", f"{self.name}.{k} cannot be part of a key")

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise EngineError("not_found", f"no column {name} in {self.name}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def stored(self) -> tuple[ColumnDef, ...]:
        """Key columns first, then the others."""
        keys = tuple(self.column(k) for k in self.key)
        return keys + tuple(c for c in self.columns if c not in keys)

    @property
    def schema(self) -> T.StructType:
        return schema_of(self.columns)

    def to_json(self) -> dict:
        return {"name": self.name, "key": self.key, "rule": self.rule, "rule_columns": self.rule_columns, "columns": [[c.name, c.type.family, list(c.type.params), c.type.fs_type, c.nullable] for c in self.columns]}

    @staticmethod
    def from_json(x: dict) -> TableDef:
        columns = tuple(ColumnDef(n, ColumnType(f, tuple(p), fs), nullable, x["key"].index(n) if n in x["key"] else None) for n, f, p, fs, nullable in x["columns"])
        return TableDef(x["name"], columns, tuple(x["key"]), x["rule"], tuple(x["rule_columns"]))


@dataclass
class Catalog:
    tables: dict[str, TableDef] = field(default_factory=dict)
    rules: dict[str, RangeRule] = field(default_factory=dict)
    placements: dict[str, dict[str, int]] = field(default_factory=dict)
    fs_types: dict[str, str] = field(default_factory=dict)
    version: int = 0

    def table(self, name: str) -> TableDef:
        found = self.tables.get(name.lower())
        if found is None:
            raise EngineError("not_found", f"no table {name}")
        return found

    def rule(self, name: str) -> RangeRule:
        if name not in self.rules:
            raise EngineError("not_found", f"no partition rule {name}")
        return self.rules[name]

    def create(self, table: TableDef, if_not_exists: bool = False) -> bool:
        if table.name.lower() in self.tables:
            if if_not_exists:
                return False
            raise EngineError("already_exists", f"table {table.name}")
        if table.rule:
            rule = self.rule(table.rule)
            if len(rule.columns) != len(table.rule_columns) or tuple(table.key[: len(table.rule_columns)]) != table.rule_columns:
                raise EngineError("invalid_partition", f"{table.rule_columns} must be a prefix of the key {table.key} and match the rule")
        self.tables[table.name.lower()] = table
        self.version += 1
        return True

    def drop(self, name: str, if_exists: bool = False) -> bool:
        if name.lower() not in self.tables:
            if if_exists:
                return False
            raise EngineError("not_found", f"no table {name}")
        del self.tables[name.lower()]
        self.version += 1
        return True

    def add_rule(self, rule: RangeRule) -> None:
        if rule.name in self.rules:
            raise EngineError("already_exists", f"partition rule {rule.name}")
        self.rules[rule.name] = rule
        self.version += 1

    def place(self, rule: str, workers: dict[str, int]) -> None:
        known = {p.name for p in self.rule(rule).parts}
        if set(workers) - known:
            raise EngineError("not_found", f"no partition {sorted(set(workers) - known)} in {rule}")
        self.placements.setdefault(rule, {}).update(workers)
        self.version += 1

    def add_fs_type(self, name: str, kind: str) -> None:
        if name in self.fs_types:
            raise EngineError("already_exists", f"type {name}")
        self.fs_types[name] = kind
        self.version += 1

    def drop_fs_type(self, name: str) -> None:
        if name not in self.fs_types:
            raise EngineError("not_found", f"no type {name}")
        if any(c.type.fs_type == name for t in self.tables.values() for c in t.columns):
            raise EngineError("in_use", f"type {name}")
        del self.fs_types[name]
        self.version += 1

    def copy(self) -> Catalog:
        return replace(self, tables=dict(self.tables), rules=dict(self.rules), placements={k: dict(v) for k, v in self.placements.items()}, fs_types=dict(self.fs_types))

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "tables": [t.to_json() for t in self.tables.values()], "rules": [r.to_json() for r in self.rules.values()], "placements": self.placements, "fs_types": self.fs_types})

    @staticmethod
    def from_json(text: str) -> Catalog:
        x = json.loads(text)
        return Catalog({t["name"].lower(): TableDef.from_json(t) for t in x["tables"]}, {r["name"]: RangeRule.from_json(r) for r in x["rules"]}, x["placements"], x["fs_types"], x["version"])

    # --- catalogs as DataFrames ---------------------------------------------------------------------------------------
    def table_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, c.name, c.type.family, c.nullable, t.key.index(c.name) if c.name in t.key else None) for t in self.tables.values() for c in t.columns]
        return spark.createDataFrame(rows, "table_name string, column_name string, family string, nullable boolean, key_position int")

    def rule_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(r.name, i, p.name, str(p.start), str(p.end)) for r in self.rules.values() for i, p in enumerate(r.parts)]
        return spark.createDataFrame(rows, "rule string, position int, partition string, start_bound string, end_bound string")

    def placement_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(r, p, w) for r, of in self.placements.items() for p, w in of.items()]
        return spark.createDataFrame(rows, "rule string, partition string, worker int")

    def fs_type_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.fs_types.items()), "name string, kind string")
