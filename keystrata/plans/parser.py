"""A parser for the statements that the engine runs itself: keyed DML, DDL, COPY, transaction control and the simple
SELECT (columns or aggregates of one table under a conjunction). Any other SELECT is left to Spark SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from keystrata.functions.types import ColumnDef, EngineError, parse_type
from keystrata.operators.access import MIRROR
from keystrata.operators.partition import MAX, MIN

TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(?P<num>\d+\.\d*|\.\d+|\d+)|(?P<str>'(?:[^']|'')*')|(?P<id>"[^"]+"|[A-Za-z_][A-Za-z0-9_]*)|(?P<par>\?|\$\d+)|(?P<op><>|!=|<=|>=|\|\||[=<>(),;*.+\-/%|&^~\[\]:])""", re.S)


@dataclass(frozen=True)
class Param:
    """A placeholder, by its order of appearance."""

    index: int


@dataclass
class Select:
    table: str
    terms: list[tuple[str, str | None, str]]  # (column or function, argument, output name); function "" is a column
    where: list[tuple[str, str, Any]]
    distinct: bool = False
    star: bool = False


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list[Any]]


@dataclass
class Update:
    table: str
    sets: list[tuple[str, str, Any]]  # (column, "=" or "add" or "sub", value)
    where: list[tuple[str, str, Any]]


@dataclass
class Delete:
    table: str
    where: list[tuple[str, str, Any]]


@dataclass
class CreateTable:
    table: str
    columns: list[ColumnDef]
    key: list[str]
    if_not_exists: bool = False
    rule: str | None = None
    rule_columns: list[str] = field(default_factory=list)


@dataclass
class DropTable:
    table: str
    if_exists: bool = False


@dataclass
class CreateRule:
    name: str
    columns: list[str]
    parts: list[tuple[str, tuple, tuple]]


@dataclass
class Place:
    rule: str
    workers: dict[str, int]


@dataclass
class FsType:
    name: str
    kind: str | None  # None drops it


@dataclass
class Copy:
    table: str
    path: str
    to: bool


@dataclass
class Explain:
    statement: Any
    analyze: bool = False


@dataclass
class Control:
    what: str


@dataclass
class Native:
    """A SELECT for Spark SQL; params counts its placeholders."""

    text: str
    params: int


AGGREGATES = ("count", "sum", "avg", "min", "max")


class NotSimple(Exception):
    pass


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise EngineError("syntax", f"at {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0], m.start()))
            at = m.end()
        self.at, self.params = 0, 0

    # --- tokens -------------------------------------------------------------------------------------------------------
    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1].upper() if self.at + ahead < len(self.tokens) else ""

    def take(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise EngineError("syntax", f"expected {' '.join(words)} at {self.peek() or 'the end'}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "id":
            self.at += 1
            return self.tokens[self.at - 1][1].strip('"')
        raise EngineError("syntax", f"expected a name at {self.peek() or 'the end'}")

    def qualified(self) -> str:
        out = self.name()
        while self.take("."):
            out = self.name()
        return out

    def names(self) -> list[str]:
        self.need("(")
        out = [self.qualified()]
        while self.take(","):
            out.append(self.qualified())
        self.need(")")
        return out

    def literal(self) -> Any:
        sign = -1 if self.take("-") else 1
        kind, text, _ = self.tokens[self.at] if self.at < len(self.tokens) else ("", "", 0)
        if kind == "num":
            self.at += 1
            return sign * (Decimal(text) if "." in text else int(text))
        if sign < 0:
            raise NotSimple
        if kind == "str":
            self.at += 1
            return text[1:-1].replace("''", "'")
        if kind == "par":
            self.at += 1
            self.params += 1
            return Param(self.params - 1)
        if self.take("NULL"):
            return None
        raise NotSimple

    # --- statements ---------------------------------------------------------------------------------------------------
    def statement(self) -> Any:
        if self.take("EXPLAIN"):
            analyze = self.take("ANALYZE")
            self.take("VERBOSE")
            return Explain(self.statement(), analyze)
        for word in ("BEGIN", "COMMIT", "ROLLBACK"):
            if self.take(word):
                self.take("TRANSACTION")
                return Control(word.lower())
        if self.peek() in ("SELECT", "WITH", "VALUES", "("):
            return self.select()
        if self.take("INSERT", "INTO"):
            return self.insert()
        if self.take("UPDATE"):
            return self.update()
        if self.take("DELETE", "FROM"):
            self.take("ONLY")
            table = self.qualified()
            return Delete(table, self.where(True))
        if self.take("CREATE", "TABLE"):
            return self.create_table()
        if self.take("DROP", "TABLE"):
            if_exists = self.take("IF", "EXISTS")
            return DropTable(self.qualified(), if_exists)
        if self.take("CREATE", "PARTITION", "RULE"):
            return self.create_rule()
        if self.take("CREATE", "PARTITION", "PLACEMENT", "FOR", "RULE"):
            rule, workers = self.name(), {}
            self.need("(")
            while True:
                self.need("PARTITION")
                part = self.name()
                self.need("ON", "WORKER")
                workers[part] = int(self.literal())
                if not self.take(","):
                    break
            self.need(")")
            return Place(rule, workers)
        if self.take("CREATE", "TYPE"):
            name = self.name()
            self.need("FILESYSTEM")
            kind = self.name().lower()
            if kind not in ("file", "directory"):
                raise EngineError("syntax", kind)
            return FsType(name, kind)
        if self.take("DROP", "TYPE"):
            return FsType(self.name(), None)
        if self.take("COPY"):
            table = self.qualified()
            to = self.take("TO")
            if not to:
                self.need("FROM")
            path = self.literal()
            if not isinstance(path, str):
                raise EngineError("syntax", "COPY needs a quoted path")
            return Copy(table, path, to)
        raise EngineError("not_implemented", f"statement {self.peek()}")

    def whole(self) -> Any:
        try:
            out = self.statement()
        except NotSimple:
            raise EngineError("syntax", f"unsupported expression at {self.peek() or 'the end'}") from None
        self.take(";")
        if self.at < len(self.tokens):
            raise EngineError("syntax", f"unexpected {self.peek()}")
        return out

    def select(self) -> Select | Native:
        start, params = self.at, self.params
        try:
            out = self.simple_select()
            if self.at < len(self.tokens) and self.peek() != ";":
                raise NotSimple
            return out
        except (NotSimple, EngineError):
            self.at, self.params = start, params
        end = self.at
        while end < len(self.tokens) and self.tokens[end][1] != ";":
            end += 1
        n = sum(t[0] == "par" for t in self.tokens[self.at : end])
        text = self.text[self.tokens[self.at][2] : self.tokens[end][2] if end < len(self.tokens) else len(self.text)]
        self.at = end
        return Native(re.sub(r"\$\d+", "?", text) if "$" in text else text, n)

    def simple_select(self) -> Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        terms, star = [], False
        while True:
            if self.take("*"):
                star = True
            else:
                word = self.peek().lower()
                if word in AGGREGATES and self.peek(1) == "(":
                    self.at += 2
                    arg = None if word == "count" and self.take("*") else self.qualified()
                    self.need(")")
                    terms.append((word, arg, self.alias() or word))
                else:
                    c = self.qualified()
                    if self.peek() == "(":
                        raise NotSimple
                    terms.append(("", c, self.alias() or c))
            if not self.take(","):
                break
        self.need("FROM")
        self.take("ONLY")
        table = self.qualified()
        out = Select(table, terms, self.where(False), distinct, star)
        fns = {bool(t[0]) for t in terms}
        if len(fns) > 1 or (star and terms) or (distinct and True in fns):
            raise NotSimple
        return out

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.name()
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "id" and self.peek() != "FROM":
            return self.name()
        return None

    def where(self, required: bool) -> list[tuple[str, str, Any]]:
        if not self.take("WHERE"):
            if required:
                raise EngineError("syntax", "WHERE is required")
            return []
        out = self.comparison()
        while self.take("AND"):
            out += self.comparison()
        return out

    def comparison(self) -> list[tuple[str, str, Any]]:
        if self.take("("):
            out = self.comparison()
            while self.take("AND"):
                out += self.comparison()
            self.need(")")
            return out
        left = self.atom()
        op = self.peek()
        if op not in MIRROR:
            raise NotSimple
        self.at += 1
        right = self.atom()
        if isinstance(left, tuple) and not isinstance(right, tuple):
            return [(left[0], op, right)]
        if isinstance(right, tuple) and not isinstance(left, tuple):
            return [(right[0], MIRROR[op], left)]
        raise NotSimple

    def atom(self) -> Any:
        """A literal, a Param, or (column,)."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "id" and self.peek() != "NULL":
            out = self.qualified()
            if self.peek() == "(":
                raise NotSimple
            return (out,)
        return self.literal()

    def insert(self) -> Insert:
        table = self.qualified()
        columns = self.names() if self.peek() == "(" else None
        self.need("VALUES")
        rows = []
        while True:
            self.need("(")
            row = [self.literal()]
            while self.take(","):
                row.append(self.literal())
            self.need(")")
            rows.append(row)
            if not self.take(","):
                return Insert(table, columns, rows)

    def update(self) -> Update:
        self.take("ONLY")
        table = self.qualified()
        self.need("SET")
        sets = []
        while True:
            c = self.qualified()
            self.need("=")
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "id" and self.peek() != "NULL":
                if self.qualified().lower() != c.lower():
                    raise EngineError("not_implemented", "SET takes a literal, a parameter, or the column itself plus or minus one")
                op = "add" if self.take("+") else "sub"
                if op == "sub":
                    self.need("-")
                sets.append((c, op, self.literal()))
            else:
                sets.append((c, "=", self.literal()))
            if not self.take(","):
                break
        return Update(table, sets, self.where(True))

    def create_table(self) -> CreateTable:
        soft = self.take("IF", "NOT", "EXISTS")
        table, columns, key = self.qualified(), [], []
        self.need("(")
        while True:
            if self.take("PRIMARY", "KEY"):
                if key:
                    raise EngineError("syntax", "two primary keys")
                key = self.names()
            else:
                columns.append(self.column(key))
            if not self.take(","):
                break
        self.need(")")
        out = CreateTable(table, columns, key, soft)
        if self.take("PARTITION", "BY", "GLOBAL", "RULE"):
            out.rule = self.name()
            self.need("REFERENCES")
            out.rule_columns = self.names()
        return out

    def column(self, key: list[str]) -> ColumnDef:
        name, kind = self.name(), self.name()
        if kind.upper() == "DOUBLE":
            self.take("PRECISION")
        params: list[int] = []
        if self.take("("):
            params.append(int(self.literal()))
            while self.take(","):
                params.append(int(self.literal()))
            self.need(")")
        if kind.upper() in ("TIME", "TIMESTAMP"):
            if self.take("WITH", "TIME", "ZONE"):
                kind = "TIMESTAMPTZ"
            else:
                self.take("WITHOUT", "TIME", "ZONE")
        nullable = True
        while True:
            if self.take("NOT", "NULL"):
                nullable = False
            elif self.take("PRIMARY", "KEY"):
                if key:
                    raise EngineError("syntax", "two primary keys")
                key.append(name)
            elif self.take("NULL") or self.take("UNIQUE"):
                pass
            elif self.take("DEFAULT"):
                self.literal()
            else:
                break
        return ColumnDef(name, parse_type(kind, tuple(params)) if kind.upper() not in self.fs else self.fs_column(kind), nullable)

    fs: dict[str, str] = {}

    def fs_column(self, kind: str):
        from keystrata.functions.types import ColumnType

        return ColumnType("fs", (), self.fs[kind.upper()])

    def create_rule(self) -> CreateRule:
        name = self.name()
        self.need("RANGE")
        columns, parts = self.names(), []
        self.need("(")
        while True:
            self.need("PARTITION")
            part = self.name()
            self.need("VALUES", "FROM")
            start = self.bound()
            self.need("TO")
            parts.append((part, start, self.bound()))
            if not self.take(","):
                break
        self.need(")")
        return CreateRule(name, columns, parts)

    def bound(self) -> tuple:
        self.need("(")
        out = []
        while True:
            out.append(MIN if self.take("MINVALUE") else MAX if self.take("MAXVALUE") else self.literal())
            if not self.take(","):
                break
        self.need(")")
        return tuple(out)


def parse(text: str, fs_types: dict[str, str] | None = None) -> tuple[Any, int]:
    """A statement and the number of its parameters."""
    p = Parser(text)
    p.fs = {k.upper(): k for k in fs_types or {}}
    return p.whole(), p.params


def split_script(text: str) -> list[str]:
    """Statements of a script, cut at the semicolons outside quotes and comments."""
    cuts = [m.start() for m in TOKEN.finditer(text) if m.lastgroup == "op" and m[0] == ";"]
    parts = [text[a:b] for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(text)], strict=True)]
    return [p.strip() for p in parts if p.strip()]
