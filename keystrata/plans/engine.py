"""The engine and its sessions: statements, transactions, prepared templates, key/value data and procedures.

A transaction stages the changes of its tables, and frames that its reads see. COMMIT writes the changed rows of each
table once and creates the next manifest; if another session has meanwhile committed a change to a key that this one changed,
it fails. Increments commute: where this session has only incremented a key and not read the table since, they are applied
to what the other session has left there.
Statements outside a transaction commit by themselves. Reads see the latest commit (read committed) and the session's
own staged writes; key/value reads inside a transaction keep the snapshot of its beginning.
"""

from __future__ import annotations

import dataclasses
import threading
import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions import exact
from keystrata.functions.types import ColumnDef, EngineError, fit
from keystrata.operators import dml, versions
from keystrata.operators.access import Condition, Path, classify, where_all
from keystrata.operators.partition import Part, RangeRule, partition_of
from keystrata.plans import parser as P
from keystrata.sources import csv_copy, kv
from keystrata.sources.catalog import Catalog, TableDef
from keystrata.sources.objects import Objects, new_id
from keystrata.sources.storage import Storage

KV = "__kv"
#: Parsed statements that are kept, by text and catalog version.
TEMPLATES = 4096
#: Inserted rows up to which only the table's rows under their leading key values are looked at.
FEW = 1000


class Engine:
    """compat: "default_for_not_null" fills omitted NOT NULL columns with their type's default instead of failing."""

    def __init__(self, spark: SparkSession, root: str, compat: frozenset[str] = frozenset()):
        self.spark, self.storage, self.compat = spark, Storage(spark, root), compat
        self.objects = Objects(spark, f"{self.storage.root}/objects")
        self.procedures: dict[tuple[str, str, str], Callable] = {}
        self.sessions: dict[str, Session] = {}
        self._templates: dict[tuple[str, int], tuple[Any, int]] = {}
        self._lock = threading.RLock()
        self.prefix = "ks_" + uuid.uuid4().hex[:8]

    def session(self, session_id: str | None = None) -> Session:
        """A new session, or an open one by its id."""
        if session_id:
            if session_id not in self.sessions:
                raise EngineError("not_found", f"session {session_id} does not exist")
            return self.sessions[session_id]
        s = Session(self)
        self.sessions[s.id] = s
        return s

    def template(self, text: str, catalog: Catalog) -> tuple[Any, int]:
        key = (text, catalog.version)
        if key not in self._templates:
            if len(self._templates) >= TEMPLATES:
                self._templates.clear()
            self._templates[key] = P.parse(text, catalog.fs_types)
        return self._templates[key]

    # --- packages of procedures ----------------------------------------------------------------------------------------
    def register(self, app: str, module: str, name: str, fn: Callable) -> None:
        self.procedures[app, module, name] = fn

    def install(self, package: Any) -> list[str]:
        """A package has NAME, DDL (a script), INIT (a script) and PROCEDURES (name -> function)."""
        s = self.session()
        for text in P.split_script(package.DDL) + P.split_script(getattr(package, "INIT", "")):
            s.execute(text)
        s.close()
        for name, fn in package.PROCEDURES.items():
            self.register(package.NAME, package.NAME, name, fn)
        return sorted(package.PROCEDURES)

    def uninstall(self, app: str) -> int:
        own = [k for k in self.procedures if k[0] == app]
        for k in own:
            del self.procedures[k]
        return len(own)

    def apps(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for app, module, name in sorted(self.procedures):
            out.setdefault(app, []).append(f"{module}.{name}")
        return out

    def invoke(self, app: str, module: str, name: str, *args: Any, session: Session | None = None, **kwargs: Any) -> Any:
        """Call a procedure in the session's transaction, or in one of its own that commits if it returns."""
        fn = self.procedures.get((app, module, name))
        if fn is None:
            raise EngineError("not_found", f"no procedure {app}/{module}/{name}")
        s = session or self.session()
        own = not s.in_transaction
        if own:
            s.begin()
        try:
            out = fn(s, *args, **kwargs)
        except BaseException:
            if own:
                s.rollback()
            raise
        if own:
            s.commit()
        if session is None:
            s.close()
        return out

    def route(self, rule: str, key: tuple) -> tuple[str, int | None]:
        catalog, _ = self.storage.manifest(self.storage.latest())
        part = catalog.rule(rule).route(key)
        return part, catalog.placements.get(rule, {}).get(part)


class Prepared:
    def __init__(self, session: Session, text: str):
        self.session, self.text, self.args = session, text, ()
        _, self.params = session.engine.template(text, session.catalog())

    def bind(self, *args: Any) -> Prepared:
        self.args = args
        return self

    def query(self, *args: Any) -> DataFrame:
        return self.session.query(self.text, args or self.args)

    def execute(self, *args: Any) -> int:
        return self.session.execute(self.text, args or self.args)

    def describe(self) -> T.StructType:
        return self.session.describe(self.text)

    def reset(self) -> None:
        self.args = ()


class Session:
    def __init__(self, engine: Engine):
        self.engine, self.id = engine, uuid.uuid4().hex
        self._base: int | None = None  # manifest at BEGIN
        self._catalog: Catalog | None = None  # staged
        self._staged: dict[str, DataFrame] = {}  # what this session sees of the tables that it changed
        self._delta: dict[str, tuple[DataFrame, tuple[str, ...]]] = {}  # their changes (columns and op) and key
        self._increments: dict[str, dict[tuple, list[dml.Delta]] | None] = {}  # by table and key; None: not increments alone
        self._fresh: set[str] = set()  # tables that this transaction has created
        self._unbound: list[str] = []  # objects whose column is deleted or overwritten: they go when this commits

    # --- transactions ---------------------------------------------------------------------------------------------------
    @property
    def in_transaction(self) -> bool:
        return self._base is not None

    def begin(self) -> None:
        if self.id not in self.engine.sessions:
            raise EngineError("not_found", f"session {self.id} does not exist")
        if self.in_transaction:
            raise EngineError("invalid_state", "a transaction is open already")
        self.rollback()
        self._base = self.engine.storage.latest()

    def commit(self) -> None:
        if not self.in_transaction:
            raise EngineError("invalid_state", "no transaction is open")
        try:
            if self._staged or self._catalog is not None:
                self._write()
                for name in self._unbound:
                    self.engine.objects.remove(name)
        finally:
            self.rollback()

    def _write(self) -> None:
        with self.engine._lock:
            storage, last = self.engine.storage, self.engine.storage.latest()
            catalog, data = storage.manifest(last)
            if last != self._base:
                began_catalog, began = storage.manifest(self._base)
                if self._catalog is not None and catalog.version != began_catalog.version:
                    raise EngineError("conflict", "changed by another session: the catalog")
                for name in self._staged:
                    if began.get(name) != data.get(name):
                        self._settle(name, catalog, data.get(name))
            whole = {n: None if n in self._fresh else df for n, df in self._staged.items() if n not in self._delta}
            whole |= {n: None for n in self._fresh if n in self._delta}
            storage.commit(last, self._catalog or catalog, data, whole, self._delta)

    def _settle(self, name: str, catalog: Catalog, entry: dict | None) -> None:
        """Another session has changed the table since this transaction began: a conflict where it changed a key that this
        one changed too, unless this one's changes of that key are increments, which then apply to the row as it is now."""
        storage, failed = self.engine.storage, EngineError("conflict", f"changed by another session: {name}")
        if name not in self._delta or entry is None or (name not in catalog.tables and name != KV):
            raise failed
        mine, key = self._delta[name]
        schema = kv.SCHEMA if name == KV else catalog.table(name).schema
        if not key:
            return  # rows without a key are only added
        theirs = storage.changed_since(schema, key, entry, self._base)
        if theirs is None:
            raise failed
        increments = self._increments.get(name) or {}
        both = mine.select(*key).join(theirs, list(key)).limit(len(increments) + 1).collect()
        again = []
        for row in both:
            own = tuple(row[k] for k in key)
            if own not in increments or row.op == versions.DELETE:
                raise failed
            where = dict(zip(key, own, strict=True))
            now = where_all(storage.read_frame(schema, key, entry), [Condition(k, "=", v) for k, v in where.items()])
            again += dml.update(now, where, deltas=increments[own]).collect()
        if again:
            rows = self.engine.spark.createDataFrame(again, schema).withColumn("op", F.lit(versions.PUT))
            self._delta[name] = versions.stack(mine, rows, key), key

    def rollback(self) -> None:
        self._base, self._staged, self._delta, self._catalog = None, {}, {}, None
        self._increments, self._fresh, self._unbound = {}, set(), []

    def close(self) -> None:
        self.rollback()
        self.engine.sessions.pop(self.id, None)

    def _auto(self, work: Callable[[], Any]) -> Any:
        if self.in_transaction:
            return work()
        self.begin()
        try:
            out = work()
        except BaseException:
            self.rollback()
            raise
        self.commit()
        return out

    # --- reads ----------------------------------------------------------------------------------------------------------
    def catalog(self) -> Catalog:
        return self._catalog or self.engine.storage.manifest(self.engine.storage.latest())[0]

    def _change_catalog(self) -> Catalog:
        if self._catalog is None:
            self._catalog = self.catalog().copy()
        return self._catalog

    def table(self, name: str) -> DataFrame:
        """The rows of a table as this session sees them."""
        if name.lower() in self._increments:
            self._increments[name.lower()] = None  # what is read now may decide what comes next
        return self._rows(name)

    def _rows(self, name: str, parts: list[str] | None = None) -> DataFrame:
        t = self.catalog().table(name)
        if t.name.lower() in self._staged:
            return self._staged[t.name.lower()]
        _, data = self.engine.storage.manifest(self.engine.storage.latest())
        return self.engine.storage.read(t, data.get(t.name.lower()), parts)

    def query(self, text: str, args: tuple | list = (), ordered: bool = False) -> DataFrame:
        """ordered: rows of one table come in the order of its key (of its partitions and the key, where a rule is bound,
        which is the same order); else in any."""
        statement, n = self.engine.template(text, self.catalog())
        if isinstance(statement, P.Explain):
            return self._explain(statement, args)
        if isinstance(statement, P.Native):
            return self._native(statement, args)
        if not isinstance(statement, P.Select):
            raise EngineError("invalid_statement", "not a query; use execute")
        self._count(n, args)
        return self._select(statement, args, ordered)

    def _count(self, n: int, args: tuple | list) -> None:
        if n != len(args):
            raise EngineError("invalid_argument", f"{n} parameters, {len(args)} given")

    def _conditions(self, table: TableDef, where: list, args: tuple | list) -> list[Condition]:
        out = []
        for c, op, v in where:
            column = table.column(c)
            out.append(Condition(column.name, op, _bound(v, args) if not isinstance(v, P.Param) else _compare(args[v.index], column)))
        return out

    def _select(self, s: P.Select, args: tuple | list, ordered: bool = False) -> DataFrame:
        t = self.catalog().table(s.table)
        own = self._conditions(t, s.where, args)
        self.table(t.name)
        rows = where_all(self._rows(t.name, self._parts(t, own) if t.rule and own else None), own)
        if ordered and t.key and not (s.terms and s.terms[0][0]):
            rows = rows.orderBy(*t.key)
        if s.star:
            out = rows.select(*t.names)
        elif s.terms[0][0]:
            items = [(fn, t.column(c).name if c else None, name) for fn, c, name in s.terms]
            names = [x[2] for x in items]
            items = [(fn, c, name if names.count(name) == 1 else f"{fn}_{c or 'all'}_{i}") for i, (fn, c, name) in enumerate(items)]
            return exact.aggregate(rows, items)
        else:
            out = rows.select(*[F.col(t.column(c).name).alias(name) for _, c, name in s.terms])
        return out.distinct() if s.distinct else out

    def _native(self, s: P.Native, args: tuple | list) -> DataFrame:
        """Any other query: tables become views just for the analysis."""
        self._count(s.params, args)
        spark, lower = self.engine.spark, s.text.lower()
        made = []
        with self.engine._lock:
            try:
                for name in self.catalog().tables:
                    if name in lower:
                        self.table(name).createOrReplaceTempView(name)
                        made.append(name)
                return spark.sql(s.text, args=list(args)) if args else spark.sql(s.text)
            finally:
                for name in made:
                    spark.catalog.dropTempView(name)

    def _explain(self, e: P.Explain, args: tuple | list) -> DataFrame:
        if isinstance(e.statement, P.Select):
            path = self.access_path(e.statement, args)
            df = self._select(e.statement, args)
            head = f"path {path.kind}; key {[(c.column, c.op) for c in path.key]}; residual {[(c.column, c.op) for c in path.residual]}\n"
        elif isinstance(e.statement, P.Native):
            df, head = self._native(e.statement, args), ""
        else:
            raise EngineError("not_implemented", "EXPLAIN takes queries")
        plan = df._jdf.queryExecution().explainString(self.engine.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.engine.spark.createDataFrame([(head + plan,)], "plan string")

    def access_path(self, s: P.Select | str, args: tuple | list = ()) -> Path:
        if isinstance(s, str):
            s = self.engine.template(s, self.catalog())[0]
        t = self.catalog().table(s.table)
        return classify(self._conditions(t, s.where, args), t.key)

    def partitions_of(self, text: str, args: tuple | list = ()) -> list[str]:
        """Which partitions of a partitioned table a SELECT can touch."""
        s = self.engine.template(text, self.catalog())[0]
        t = self.catalog().table(s.table)
        return self._parts(t, self._conditions(t, s.where, args))

    def _parts(self, t: TableDef, own: list[Condition]) -> list[str]:
        """The partitions that rows under these conditions can be in."""
        rule = self.catalog().rule(t.rule or "")
        own = [c for c in own if c.value is not None]
        low: list = []
        for c in t.rule_columns:
            eq = next((x for x in own if x.column == c and x.op == "="), None)
            if eq is None:
                break
            low.append(eq.value)
        if len(low) == len(t.rule_columns):
            return [p for p in (rule.find(tuple(low)),) if p]
        follow = t.rule_columns[len(low)]
        lo = max(((x.value, x.op) for x in own if x.column == follow and x.op in (">", ">=")), default=None, key=lambda x: (x[0], x[1] == ">"))
        hi = min(((x.value, x.op) for x in own if x.column == follow and x.op in ("<", "<=")), default=None, key=lambda x: (x[0], x[1] == "<="))
        base = tuple(low)
        return rule.prune(base + ((lo[0],) if lo else ()), base + ((hi[0],) if hi else ()), lo is None or lo[1] == ">=", hi is None or hi[1] == "<=")

    def describe(self, text: str) -> T.StructType:
        """The columns of a SELECT, without running it; parameters count as NULL."""
        statement, n = self.engine.template(text, self.catalog())
        return (self._native if isinstance(statement, P.Native) else self._select)(statement, [None] * (statement.params if isinstance(statement, P.Native) else n)).schema

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def one(self, text: str, args: tuple | list = ()) -> Row | None:
        return self.query(text, args).first()

    # --- writes ---------------------------------------------------------------------------------------------------------
    def execute(self, text: str, args: tuple | list = ()) -> int:
        """Run a statement; the number of rows that it touched."""
        statement, n = self.engine.template(text, self.catalog())
        if isinstance(statement, P.Control):
            {"begin": self.begin, "commit": self.commit, "rollback": self._rollback}[statement.what]()
            return 0
        self._count(n, args)
        work = {
            P.Insert: self._insert, P.Update: self._update, P.Delete: self._delete, P.CreateTable: self._create_table, P.DropTable: self._drop_table,
            P.CreateRule: self._create_rule, P.Place: self._place, P.FsType: self._fs_type, P.Copy: self._copy,
        }.get(type(statement))
        if work is None:
            raise EngineError("invalid_statement", "not a command; use query")
        return self._auto(lambda: work(statement, args))

    def _rollback(self) -> None:
        if not self.in_transaction:
            raise EngineError("invalid_state", "no transaction is open")
        self.rollback()

    def batch(self, script: str) -> int:
        """Statements without parameters, all or none; the sum of the rows that they touched."""
        return self._auto(lambda: sum(self.execute(x) for x in P.split_script(script)))

    def _stage(self, name: str, df: DataFrame, key: tuple[str, ...] = (), changes: DataFrame | None = None, increment: bool = False) -> None:
        """df: the table as the session now sees it; changes: the rows that make the difference, with op (none: a new table);
        increment: they come of increments, which may be applied again to other rows."""
        name = name.lower()
        if changes is None:
            self._delta.pop(name, None)
            self._fresh.add(name)
        elif name in self._delta or name not in self._staged or name in self._fresh:
            old = self._delta[name][0] if name in self._delta else None
            self._delta[name] = versions.stack(old, changes, key), key
        self._staged[name] = df
        if not increment:
            self._increments[name] = None

    def apply_changes(self, name: str, changes: DataFrame) -> None:
        """Changes by key (the table's columns and op: P puts a row, D deletes it; distinct keys)."""
        t = self.catalog().table(name)
        changes = changes.select(*t.names, "op")
        self._auto(lambda: self._stage(name, versions.overlay(self.table(name), changes, t.key), t.key, changes))

    def merge_frame(self, name: str, rows: DataFrame) -> None:
        """Upsert rows by key (distinct keys)."""
        self.apply_changes(name, rows.withColumn("op", F.lit(versions.PUT)))

    def _insert(self, s: P.Insert, args: tuple | list) -> int:
        t = self.catalog().table(s.table)
        columns = [t.column(c) for c in s.columns] if s.columns else list(t.columns)
        if len({c.name for c in columns}) != len(columns):
            raise EngineError("invalid_argument", "a column is named twice")
        rows = []
        for values in s.rows:
            if len(values) != len(columns):
                raise EngineError("invalid_argument", f"{len(columns)} columns, {len(values)} values")
            row = {c.name: fit(_bound(v, args), c) for c, v in zip(columns, values, strict=True)}
            for c in t.columns:
                if c.name not in row:
                    row[c.name] = new_id() if c.type.family == "fs" else c.type.default() if not c.nullable and c.name not in t.key and "default_for_not_null" in self.engine.compat else None
                if row[c.name] is None and (not c.nullable or c.name in t.key):
                    raise EngineError("null_value", f"{t.name}.{c.name}")
            rows.append(tuple(row[c] for c in t.names))
        lead = sorted({r[t.names.index(t.key[0])] for r in rows}) if t.key and len(rows) <= FEW else None
        return self.insert_frame(t.name, self.engine.spark.createDataFrame(rows, t.schema), len(rows), lead)

    def insert_frame(self, name: str, df: DataFrame, n: int | None = None, lead: list | None = None) -> int:
        """Insert the rows of a DataFrame; a key that exists is an error, and so is a row outside all partitions. lead: the
        values of the key's first column, where they are few, so that only their rows of the table are looked at."""
        t = self.catalog().table(name)
        new = df.select(*[F.col(c.name).cast(c.type.spark) for c in t.columns])

        def work() -> int:
            nonlocal new
            if n is None:  # the source runs once; what follows reads what it gave
                new = self.engine.storage.keep(t.name.lower(), new)
            before = self.table(name)
            if t.rule:
                stray = new.where(partition_of(self.catalog().rule(t.rule), list(t.rule_columns)).isNull()).select(*t.key).first()
                if stray is not None:
                    raise EngineError("invalid_partition", f"{tuple(stray)} lies in no partition of {t.rule}")
            if t.key:
                near = before if lead is None else before.where(F.col(t.key[0]).isin(lead))
                if bad := dml.conflicts(near, new, t.key).first():
                    raise EngineError("duplicate_key", str(bad.asDict()))
            self._stage(name, before.unionByName(new), t.key, new.withColumn("op", F.lit(versions.PUT)))
            return new.count() if n is None else n

        return self._auto(work)

    def _whole_key(self, t: TableDef, where: list, args: tuple | list) -> dict[str, Any]:
        path = classify(self._conditions(t, where, args), t.key)
        if path.kind != "key" or path.residual:
            raise EngineError("not_implemented", "UPDATE and DELETE need equality on the whole primary key and nothing else")
        return {c.column: c.value for c in path.key}

    def _hit(self, t: TableDef, key: dict[str, Any]) -> int:
        return 0 if where_all(self._rows(t.name), [Condition(c, "=", v) for c, v in key.items()]).isEmpty() else 1

    def _update(self, s: P.Update, args: tuple | list) -> int:
        t = self.catalog().table(s.table)
        key = self._whole_key(t, s.where, args)
        values, deltas = {}, []
        for c, op, v in s.sets:
            column = t.column(c)
            value = fit(_bound(v, args), column)
            if op == "=":
                if value is None and column.type.family == "fs":
                    value = new_id()  # NULL binds a fresh object
                if value is None and not column.nullable:
                    raise EngineError("null_value", f"{t.name}.{c}")
                values[column.name] = value
            else:
                if value is None:
                    raise EngineError("null_value", f"increment of {c}")
                deltas.append(dml.Delta(column.name, op, value))
        return self.relation_update(t.name, key, values, deltas)

    def _delete(self, s: P.Delete, args: tuple | list) -> int:
        t = self.catalog().table(s.table)
        return self.relation_delete(t.name, self._whole_key(t, s.where, args))

    def _unbind(self, t: TableDef, row: Row, columns: list[str]) -> None:
        self._unbound += [row[c] for c in columns if t.column(c).type.family == "fs" and row[c]]

    def _create_table(self, s: P.CreateTable, args: tuple | list) -> int:
        columns = tuple(replace(c, key=s.key.index(c.name) if c.name in s.key else None, nullable=c.nullable and c.name not in s.key) for c in s.columns)
        t = TableDef(s.table, columns, tuple(s.key), s.rule, tuple(s.rule_columns))
        catalog = self._change_catalog()
        if catalog.create(t, s.if_not_exists):
            self._stage(t.name, self.engine.spark.createDataFrame([], t.schema), t.key)
        return 0

    def _drop_table(self, s: P.DropTable, args: tuple | list) -> int:
        self._change_catalog().drop(s.table, s.if_exists)
        for of in (self._staged, self._delta, self._increments):
            of.pop(s.table.lower(), None)
        self._fresh.discard(s.table.lower())
        return 0

    def _create_rule(self, s: P.CreateRule, args: tuple | list) -> int:
        self._change_catalog().add_rule(RangeRule(s.name, tuple(s.columns), tuple(Part(*p) for p in s.parts)))
        return 0

    def _place(self, s: P.Place, args: tuple | list) -> int:
        self._change_catalog().place(s.rule, s.workers)
        return 0

    def _fs_type(self, s: P.FsType, args: tuple | list) -> int:
        catalog = self._change_catalog()
        catalog.drop_fs_type(s.name) if s.kind is None else catalog.add_fs_type(s.name, s.kind)
        return 0

    def _copy(self, s: P.Copy, args: tuple | list) -> int:
        t = self.catalog().table(s.table)
        if s.to:
            rows = self.table(t.name)
            csv_copy.copy_to(rows, t, s.path)
            return rows.count()
        new = csv_copy.copy_from(self.engine.spark, t, s.path)
        for c in t.columns:
            if (not c.nullable or c.name in t.key) and not new.where(F.col(c.name).isNull()).isEmpty():
                raise EngineError("null_value", f"{t.name}.{c.name}")
        return self.insert_frame(t.name, new)

    # --- the typed row interface ------------------------------------------------------------------------------------------
    def relation_get(self, name: str, key: dict[str, Any], columns: list[str] | None = None) -> Row | None:
        t = self.catalog().table(name)
        rows = where_all(self.table(name), [Condition(t.column(k).name, "=", fit(v, t.column(k))) for k, v in key.items()])
        return (rows.select(*columns) if columns else rows).first()

    def relation_insert(self, name: str, values: dict[str, Any]) -> int:
        return self._auto(lambda: self._insert(P.Insert(name, list(values), [list(values.values())]), ()))

    def relation_update(self, name: str, key: dict[str, Any], values: dict[str, Any] | None = None, deltas: list[dml.Delta] | None = None) -> int:
        t = self.catalog().table(name)

        def work() -> int:
            n = self._hit(t, key)
            if n:
                own = [Condition(t.column(k).name, "=", v) for k, v in key.items()]
                before = self._rows(name)
                if any(t.column(c).type.family == "fs" for c in values or {}):
                    self._unbind(t, where_all(before, own).first(), list(values))
                after = dml.update(where_all(before, own), key, values, deltas)
                rows = after.collect()  # the rows of one key; overflow and increments of NULL fail here, not at COMMIT
                after = self.engine.spark.createDataFrame(rows, t.schema).withColumn("op", F.lit(versions.PUT))
                log = self._increments.setdefault(name.lower(), {} if name.lower() not in self._staged else None)
                if log is not None and deltas and not values:
                    log.setdefault(tuple(fit(key[k], t.column(k)) for k in t.key), []).extend(deltas)
                    self._stage(name, versions.overlay(before, after, t.key), t.key, after, increment=True)
                else:
                    self._stage(name, versions.overlay(before, after, t.key), t.key, after)
            return n

        return self._auto(work)

    def relation_delete(self, name: str, key: dict[str, Any]) -> int:
        t = self.catalog().table(name)

        def work() -> int:
            before = self.table(name)
            row = where_all(before, [Condition(t.column(k).name, "=", v) for k, v in key.items()]).first()
            if row is None:
                return 0
            self._unbind(t, row, t.names)
            gone = self.engine.spark.createDataFrame([row], t.schema).withColumn("op", F.lit(versions.DELETE))
            self._stage(name, dml.delete(before, key), t.key, gone)
            return 1

        return self._auto(work)

    def entities(self, name: str, kind: type, where: dict[str, Any] | None = None) -> list:
        """Rows under equalities as objects of a dataclass whose fields are columns of the table."""
        t = self.catalog().table(name)
        own = [Condition(t.column(k).name, "=", fit(v, t.column(k))) for k, v in (where or {}).items()]
        fields = [f.name for f in dataclasses.fields(kind)]
        return [kind(**row.asDict()) for row in where_all(self.table(name), own).select(*fields).collect()]

    def put_entity(self, name: str, entity: Any) -> int:
        """Insert a dataclass object: its fields are columns."""
        return self.relation_insert(name, dataclasses.asdict(entity))

    # --- files: by the object id in a column ------------------------------------------------------------------------------
    def fs_read(self, object_id: str, path: str, offset: int = 0, length: int | None = None) -> bytes:
        return self.engine.objects.pread(object_id, path, offset, length)

    def fs_write(self, object_id: str, path: str, data: bytes, offset: int | None = None) -> None:
        """The whole file, or the bytes at an offset (a file of its own until then counts as empty)."""
        if offset is None:
            self.engine.objects.write(object_id, path, data)
        else:
            self.engine.objects.pwrite(object_id, path, offset, data)

    def fs_list(self, object_id: str, path: str = "") -> list[tuple[str, bool, int]]:
        return self.engine.objects.readdir(object_id, path)

    # --- key/value ----------------------------------------------------------------------------------------------------------
    def kv_frame(self) -> DataFrame:
        if KV in self._staged:
            return self._staged[KV]
        storage = self.engine.storage
        _, data = storage.manifest(self._base if self.in_transaction else storage.latest())
        return storage.read_frame(kv.SCHEMA, ("key",), data.get(KV))

    def get(self, key: bytes) -> bytes | None:
        row = kv.get(self.kv_frame(), key).first()
        return bytes(row.value) if row else None

    def put(self, key: bytes, value: bytes) -> None:
        rows = self.engine.spark.createDataFrame([(bytearray(key), bytearray(value))], kv.SCHEMA)
        self.put_frame(rows)

    def put_frame(self, rows: DataFrame) -> None:
        rows = rows.select("key", "value")
        self._auto(lambda: self._stage(KV, kv.put(self.kv_frame(), rows), ("key",), rows.withColumn("op", F.lit(versions.PUT))))

    def delete(self, key: bytes) -> None:
        rows = self.engine.spark.createDataFrame([(bytearray(key), None)], kv.SCHEMA)
        self._auto(lambda: self._stage(KV, kv.delete(self.kv_frame(), rows), ("key",), rows.withColumn("op", F.lit(versions.DELETE))))

    def range(self, start: bytes = b"", end: bytes = b"") -> DataFrame:
        return kv.scan(self.kv_frame(), start, end)


def _bound(v: Any, args: tuple | list) -> Any:
    return args[v.index] if isinstance(v, P.Param) else v


def _compare(v: Any, column: ColumnDef) -> Any:
    """A parameter that is compared with a column: fitted to it where it fits, else as it is (it then equals nothing)."""
    try:
        return fit(v, column)
    except EngineError:
        return v
