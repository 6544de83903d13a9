"""What a schema holds: tables, columns, keys, indexes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from tidewater.functions.scalar import glob_pattern
from tidewater.functions.types import ColumnType, declared
from tidewater.sources.engine import Engine


@dataclass(frozen=True)
class ForeignKey:
    table: str
    columns: tuple[str, ...]
    to_table: str
    to_columns: tuple[str, ...]


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: ColumnType
    nullable: bool = True


@dataclass(frozen=True)
class TableInfo:
    name: str
    columns: tuple[ColumnInfo, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[Index, ...] = field(default=())


def facts(engine: Engine, name: str) -> dict[str, Any]:
    """What is known of a table besides its columns; a catalog table's facts are read from its properties."""
    if name not in engine.constraints:
        text = engine.property(name) if engine.in_catalog(name) else None
        engine.constraints[name] = _facts_of(json.loads(text)) if text else {}
    return engine.constraints[name]


def keep_facts(engine: Engine, *names: str) -> None:
    """Write what is known of catalog tables into their properties, so that it outlives the engine."""
    for name in names:
        if engine.in_catalog(name):
            engine.set_property(name, json.dumps(engine.constraints.get(name, {}), default=vars))


def _facts_of(kept: dict[str, Any]) -> dict[str, Any]:
    listed = lambda what: tuple({k: tuple(v) if isinstance(v, list) else v for k, v in x.items()} for x in kept.get(what, ()))
    known: dict[str, Any] = {what: tuple(kept[what]) for what in ("primary_key", "required") if what in kept}
    known["types"] = {column: ColumnType(**t) for column, t in kept.get("types", {}).items()}
    known["foreign_keys"] = tuple(ForeignKey(**x) for x in listed("foreign_keys"))
    known["indexes"] = tuple(Index(**x) for x in listed("indexes"))
    return known


def all_facts(engine: Engine) -> dict[str, dict[str, Any]]:
    for name in engine.names():
        facts(engine, name)
    return engine.constraints


def read_table(engine: Engine, name: str) -> TableInfo:
    known = facts(engine, name)
    required = set(known.get("required", ()))
    columns = []
    for f in engine.frame(name).schema:
        try:
            kind = declared(f)
        except ValueError:  # arrays and other nested types lie outside the model
            continue
        columns.append(ColumnInfo(f.name, known.get("types", {}).get(f.name, kind), f.nullable and f.name not in required))
    return TableInfo(name, tuple(columns), tuple(known.get("primary_key", ())), tuple(known.get("foreign_keys", ())), tuple(known.get("indexes", ())))


def read_schema(engine: Engine, wanted: Callable[[str], bool] | None = None, visit: Callable[[TableInfo], None] | None = None) -> list[TableInfo]:
    """All tables by name, those that ``wanted`` accepts; ``visit`` is called with each."""
    found = []
    for name in engine.names():
        if wanted is None or wanted(name):
            found.append(read_table(engine, name))
            if visit:
                visit(found[-1])
    return found


def foreign_keys_to(engine: Engine, table: str) -> list[ForeignKey]:
    return [k for known in all_facts(engine).values() for k in known.get("foreign_keys", ()) if k.to_table == table]


def foreign_keys_from(engine: Engine, table: str) -> list[ForeignKey]:
    return list(facts(engine, table).get("foreign_keys", ()))


def table_filter(globs: str, default_schema: str = "default") -> Callable[[str], bool]:
    """Accepts tables that one of the comma-separated globs names; ``schema.table`` or ``table`` alone."""
    patterns = []
    for glob in filter(None, map(str.strip, globs.split(","))):
        schema, dot, table = glob.rpartition(".")
        patterns.append((re.compile(glob_pattern(schema if dot else "*")), re.compile(glob_pattern(table))))

    def accepts(name: str) -> bool:
        schema, dot, table = name.rpartition(".")
        return not patterns or any(s.match(schema if dot else default_schema) and t.match(table) for s, t in patterns)

    return accepts


def in_key_order(tables: list[TableInfo]) -> list[TableInfo]:
    """Tables with those that they refer to before them, else by name; tables in a cycle come last."""
    waiting, done, out = {t.name: t for t in tables}, set(), []
    while waiting:
        ready = sorted(n for n, t in waiting.items() if all(k.to_table in done or k.to_table == n or k.to_table not in waiting for k in t.foreign_keys))
        for name in ready or sorted(waiting):
            out.append(waiting.pop(name))
            done.add(name)
    return out
