"""A small command line: python -m keystrata.cli ROOT COMMAND ...

command SQL...           run statements, print affected rows or results
shell                    statements from standard input, one a line
put KEY VALUE | get KEY | range [START [END]]
partition-route RULE VALUE...
app-install PACKAGE      make the tables of a package (a module of keystrata.procs)
app-list | app-detail PACKAGE
invoke PACKAGE PROCEDURE [VALUE...]   (also app-invoke)
server-topology          partitions and the workers that they are placed on
"""

from __future__ import annotations

import importlib
import sys

from pyspark.sql import SparkSession

from keystrata.functions.types import EngineError
from keystrata.plans import parser as P
from keystrata.plans.engine import Engine, Session


def run(s: Session, text: str) -> str:
    statement, _ = s.engine.template(text, s.catalog())
    if isinstance(statement, (P.Select, P.Native, P.Explain)):
        return "\n".join("\t".join("NULL" if v is None else str(v) for v in row) for row in s.query(text).toLocalIterator())
    return f"{s.execute(text)} row(s)"


PACKAGES = ("kv", "seckill", "tpcc", "vote", "wallet", "ycsb")


def package(name: str):
    if name not in PACKAGES:
        raise EngineError("not_found", f"package {name}")
    if name == "kv":
        return importlib.import_module("keystrata.procs.ycsb").KV
    return importlib.import_module(f"keystrata.procs.{name}")


def value(text: str):
    return int(text) if text.lstrip("-").isdigit() else text


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = spark or SparkSession.builder.appName("keystrata").getOrCreate()
    engine = Engine(spark, args[0])
    s, what, rest = engine.session(), args[1], args[2:]
    try:
        if what == "command":
            for text in rest:
                print(run(s, text))
        elif what == "shell":
            for line in sys.stdin:
                if line.strip():
                    try:
                        print(run(s, line))
                    except EngineError as e:
                        print(e, file=sys.stderr)
        elif what == "put":
            s.put(rest[0].encode(), rest[1].encode())
        elif what == "get":
            found = s.get(rest[0].encode())
            if found is None:
                return 1
            print(found.decode())
        elif what == "range":
            for r in s.range(*[x.encode() for x in rest]).toLocalIterator():
                print(f"{bytes(r.key).decode()}\t{bytes(r.value).decode()}")
        elif what == "partition-route":
            print(*engine.route(rest[0], tuple(value(x) for x in rest[1:])))
        elif what == "app-install":
            print(*engine.install(package(rest[0])))
        elif what == "app-list":
            print(*PACKAGES)
        elif what == "app-detail":
            print(*sorted(package(rest[0]).PROCEDURES))
        elif what in ("invoke", "app-invoke"):
            own = package(rest[0])
            for name, fn in own.PROCEDURES.items():
                engine.register(own.NAME, own.NAME, name, fn)
            print(engine.invoke(own.NAME, own.NAME, rest[1], *[value(x) for x in rest[2:]]))
        elif what == "server-topology":
            for rule, of in s.catalog().placements.items():
                for part, worker in of.items():
                    print(f"{rule}\t{part}\t{worker}")
        else:
            print(__doc__)
            return 2
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
