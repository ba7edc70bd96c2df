"""Key/value workloads: insert, read, update, scan, read-modify-write, and the usual mixes."""

from __future__ import annotations

from keystrata.functions.types import EngineError
from keystrata.plans.engine import Session

NAME = "ycsb"
DDL = ""
PREFIX = "user:"
#: Shares in percent. Fixed values.
MIXES = {"a": {"read": 50, "update": 50}, "b": {"read": 95, "update": 5}, "c": {"read": 100}, "e": {"scan": 95, "insert": 5}, "f": {"read": 50, "read_modify_write": 50}}


def _key(user: str) -> bytes:
    return (PREFIX + user).encode()


def insert(s: Session, user: str, value: str) -> None:
    s.put(_key(user), value.encode())


def read(s: Session, user: str) -> str:
    value = s.get(_key(user))
    if value is None:
        raise EngineError("not_found", f"key {user}")
    return value.decode()


def update(s: Session, user: str, value: str) -> None:
    read(s, user)
    s.put(_key(user), value.encode())


def scan(s: Session, start: str, end: str) -> list[str]:
    """key=value for the keys from start up to, but without, end, in order."""
    return [f"{bytes(r.key).decode()}={bytes(r.value).decode()}" for r in s.range(_key(start), _key(end)).toLocalIterator()]


def read_modify_write(s: Session, user: str, more: str) -> str:
    value = (s.get(_key(user)) or b"").decode() + more
    s.put(_key(user), value.encode())
    return value


class KV:
    """The package of the key/value demo: the same procedures under its names."""

    NAME, DDL = "kv", ""
    PROCEDURES = {f"kv_{f.__name__}": f for f in (insert, read, update, scan, read_modify_write)}


PROCEDURES = {f.__name__: f for f in (insert, read, update, scan, read_modify_write)}
