"""Schema changes as values: each has a text, for previews and checksums, and applies itself to an engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import functions as F

from tidewater.functions.types import ColumnType, Timestamp, quoted, sql_text
from tidewater.operators import changes
from tidewater.operators.predicate import Where
from tidewater.sources.engine import Engine
from tidewater.sources.introspect import ForeignKey, Index, TableInfo, all_facts, facts, keep_facts


@dataclass(frozen=True)
class Column:
    name: str
    type: ColumnType
    required: bool = False
    primary_key: bool = False
    auto: bool = False
    unique: bool = False
    indexed: bool = False
    references: tuple[str, str] | None = None
    default: Any = None

    def text(self) -> str:
        marks = [quoted(self.name), self.type.ddl()]
        marks += ["NOT NULL"] * (self.required or self.primary_key) + ["PRIMARY KEY"] * self.primary_key + ["AUTO"] * self.auto + ["UNIQUE"] * self.unique
        marks += [f"REFERENCES {quoted(self.references[0])}({quoted(self.references[1])})"] if self.references else []
        marks += [f"DEFAULT {sql_text(self.default)}"] if self.default is not None else []
        return " ".join(marks)


class Change:
    """A step of a plan."""

    def text(self) -> str:
        raise NotImplementedError

    def apply(self, engine: Engine) -> None:
        raise NotImplementedError


def _known(engine: Engine, table: str) -> dict[str, Any]:
    return facts(engine, table)


def renamed_key(key: ForeignKey, table: str, new: Callable[[str], str]) -> ForeignKey:
    """A key after columns of a table have new names, whichever side the table is on."""
    key = replace(key, columns=tuple(map(new, key.columns))) if key.table == table else key
    return replace(key, to_columns=tuple(map(new, key.to_columns))) if key.to_table == table else key


def moved_key(key: ForeignKey, table: str, to: str) -> ForeignKey:
    """A key after a table has a new name, whichever side the table is on."""
    return replace(key, table=to if key.table == table else key.table, to_table=to if key.to_table == table else key.to_table)


def _change_keys(engine: Engine, change: Callable[[ForeignKey], ForeignKey | None]) -> None:
    """Change, or drop, the keys of every table that the engine knows."""
    for name, known in all_facts(engine).items():
        old = tuple(known.get("foreign_keys", ()))
        new = tuple(k for k in map(change, old) if k is not None)
        if new != old:
            known["foreign_keys"] = new
            keep_facts(engine, name)


def _note(engine: Engine, table: str, what: str, *items: Any) -> None:
    known = _known(engine, table)
    known[what] = (*known.get(what, ()), *items)


@dataclass(frozen=True)
class CreateTable(Change):
    table: str
    columns: tuple[Column, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    if_not_exists: bool = False

    # -- building -----------------------------------------------------------------------------

    def column(self, name: str, type: ColumnType, **more: Any) -> "CreateTable":
        return replace(self, columns=(*self.columns, Column(name, type, **more)))

    def required(self, name: str, type: ColumnType, **more: Any) -> "CreateTable":
        return self.column(name, type, required=True, **more)

    def primary_key(self, name: str, type: ColumnType, auto: bool = False) -> "CreateTable":
        return self.column(name, type, primary_key=True, auto=auto)

    def foreign_key(self, name: str, type: ColumnType, table: str, column: str, required: bool = False) -> "CreateTable":
        return self.column(name, type, required=required, references=(table, column))

    def composite_foreign_key(self, columns: tuple[str, ...], table: str, to: tuple[str, ...]) -> "CreateTable":
        return replace(self, foreign_keys=(*self.foreign_keys, ForeignKey(self.table, columns, table, to)))

    def timestamps(self) -> "CreateTable":
        """Moments of creation and change, required and indexed."""
        return self.required("created_at", Timestamp, indexed=True).required("updated_at", Timestamp, indexed=True)

    # -- applying -----------------------------------------------------------------------------

    def text(self) -> str:
        keys = [f"FOREIGN KEY ({', '.join(map(quoted, k.columns))}) REFERENCES {quoted(k.to_table)}({', '.join(map(quoted, k.to_columns))})" for k in self.foreign_keys]
        return f"CREATE TABLE {'IF NOT EXISTS ' * self.if_not_exists}{quoted(self.table)} ({', '.join([*[c.text() for c in self.columns], *keys])})"

    def apply(self, engine: Engine) -> None:
        if engine.spark.catalog.tableExists(quoted(self.table)):
            if self.if_not_exists:
                return
            raise ValueError(f"{self.table} exists")
        engine.spark.sql(f"CREATE TABLE {quoted(self.table)} ({', '.join(f'{quoted(c.name)} {c.type.ddl()}' for c in self.columns)}) USING parquet")
        engine.constraints[self.table] = {}
        for c in self.columns:
            _note_column(engine, self.table, c)
        _note(engine, self.table, "foreign_keys", *self.foreign_keys)
        keep_facts(engine, self.table)


def _note_column(engine: Engine, table: str, c: Column) -> None:
    _known(engine, table).setdefault("types", {})[c.name] = c.type
    if c.primary_key:
        _note(engine, table, "primary_key", c.name)
    if c.required or c.primary_key:
        _note(engine, table, "required", c.name)
    if c.references:
        _note(engine, table, "foreign_keys", ForeignKey(table, (c.name,), c.references[0], (c.references[1],)))
    if c.unique or c.indexed:
        _note(engine, table, "indexes", Index(f"{table}_{c.name}_index", table, (c.name,), c.unique))


@dataclass(frozen=True)
class DropTable(Change):
    table: str
    if_exists: bool = False
    cascade: bool = False

    def text(self) -> str:
        return f"DROP TABLE {'IF EXISTS ' * self.if_exists}{quoted(self.table)}{' CASCADE' * self.cascade}"

    def apply(self, engine: Engine) -> None:
        if self.cascade:  # keys that refer to the table go, their tables stay
            _change_keys(engine, lambda k: None if k.to_table == self.table else k)
        engine.spark.sql(f"DROP TABLE {'IF EXISTS ' * self.if_exists}{quoted(self.table)}")
        engine.constraints.pop(self.table, None)


@dataclass(frozen=True)
class RenameTable(Change):
    table: str
    to: str

    def text(self) -> str:
        return f"ALTER TABLE {quoted(self.table)} RENAME TO {quoted(self.to)}"

    def apply(self, engine: Engine) -> None:
        engine.own(self.table)
        known = _known(engine, self.table)
        engine.spark.sql(self.text())
        engine.constraints.pop(self.table, None)
        known["indexes"] = tuple(replace(i, table=self.to) for i in known.get("indexes", ()))
        engine.constraints[self.to] = known
        engine.moved(self.table, self.to)
        _change_keys(engine, lambda k: moved_key(k, self.table, self.to))
        keep_facts(engine, self.to)


@dataclass(frozen=True)
class AddColumn(Change):
    table: str
    column: Column
    if_not_exists: bool = False

    def text(self) -> str:
        return f"ALTER TABLE {quoted(self.table)} ADD COLUMN {'IF NOT EXISTS ' * self.if_not_exists}{self.column.text()}"

    def apply(self, engine: Engine) -> None:
        frame = engine.frame(self.table)
        if self.column.name in frame.columns:
            if self.if_not_exists:
                return
            raise ValueError(f"{self.table} has a column {self.column.name}")
        if self.column.default is None:
            engine.own(self.table)
            engine.spark.sql(f"ALTER TABLE {quoted(self.table)} ADD COLUMNS ({quoted(self.column.name)} {self.column.type.ddl()})")
        else:
            engine.replace(self.table, frame.withColumn(self.column.name, F.lit(self.column.default).cast(self.column.type.spark())))
        _note_column(engine, self.table, self.column)
        keep_facts(engine, self.table)


@dataclass(frozen=True)
class AlterColumn(Change):
    """A new type; the table is rewritten, as by a rename or drop of a column."""

    table: str
    column: str
    type: ColumnType
    required: bool = False

    def text(self) -> str:
        return f"ALTER TABLE {quoted(self.table)} ALTER COLUMN {quoted(self.column)} {self.type.ddl()}{' NOT NULL' * self.required}"

    def apply(self, engine: Engine) -> None:
        frame = engine.frame(self.table)
        engine.replace(self.table, frame.withColumn(self.column, F.col(quoted(self.column)).cast(self.type.spark())))
        known = _known(engine, self.table)
        known.setdefault("types", {})[self.column] = self.type
        known["required"] = tuple(c for c in known.get("required", ()) if c != self.column) + (self.column,) * self.required
        keep_facts(engine, self.table)


@dataclass(frozen=True)
class RenameColumn(Change):
    table: str
    column: str
    to: str

    def text(self) -> str:
        return f"ALTER TABLE {quoted(self.table)} RENAME COLUMN {quoted(self.column)} TO {quoted(self.to)}"

    def apply(self, engine: Engine) -> None:
        engine.replace(self.table, engine.frame(self.table).withColumnRenamed(self.column, self.to))
        known, new = _known(engine, self.table), lambda c: self.to if c == self.column else c
        for what in ("primary_key", "required"):
            known[what] = tuple(map(new, known.get(what, ())))
        known["types"] = {new(c): t for c, t in known.get("types", {}).items()}
        known["indexes"] = tuple(replace(i, columns=tuple(map(new, i.columns))) for i in known.get("indexes", ()))
        _change_keys(engine, lambda k: renamed_key(k, self.table, new))
        keep_facts(engine, self.table)


@dataclass(frozen=True)
class DropColumn(Change):
    table: str
    column: str
    if_exists: bool = False

    def text(self) -> str:
        return f"ALTER TABLE {quoted(self.table)} DROP COLUMN {'IF EXISTS ' * self.if_exists}{quoted(self.column)}"

    def apply(self, engine: Engine) -> None:
        frame = engine.frame(self.table)
        if self.column not in frame.columns:
            if self.if_exists:
                return
            raise ValueError(f"{self.table} has no column {self.column}")
        engine.replace(self.table, frame.drop(self.column))
        known = _known(engine, self.table)
        for what in ("primary_key", "required"):
            known[what] = tuple(c for c in known.get(what, ()) if c != self.column)
        for what in ("foreign_keys", "indexes"):
            known[what] = tuple(k for k in known.get(what, ()) if self.column not in k.columns)
        known.get("types", {}).pop(self.column, None)
        _change_keys(engine, lambda k: None if k.to_table == self.table and self.column in k.to_columns else k)
        keep_facts(engine, self.table)


@dataclass(frozen=True)
class AddForeignKey(Change):
    key: ForeignKey

    def text(self) -> str:
        k = self.key
        return f"ALTER TABLE {quoted(k.table)} ADD FOREIGN KEY ({', '.join(map(quoted, k.columns))}) REFERENCES {quoted(k.to_table)}({', '.join(map(quoted, k.to_columns))})"

    def apply(self, engine: Engine) -> None:
        _note(engine, self.key.table, "foreign_keys", self.key)
        keep_facts(engine, self.key.table)


@dataclass(frozen=True)
class DropForeignKey(Change):
    table: str
    columns: tuple[str, ...]

    def text(self) -> str:
        return f"ALTER TABLE {quoted(self.table)} DROP FOREIGN KEY ({', '.join(map(quoted, self.columns))})"

    def apply(self, engine: Engine) -> None:
        known = _known(engine, self.table)
        known["foreign_keys"] = tuple(k for k in known.get("foreign_keys", ()) if k.columns != self.columns)
        keep_facts(engine, self.table)


@dataclass(frozen=True)
class CreateIndex(Change):
    """An index is kept as a fact only: Parquet statistics and sorting do its work."""

    index: Index

    def text(self) -> str:
        return f"CREATE {'UNIQUE ' * self.index.unique}INDEX {quoted(self.index.name)} ON {quoted(self.index.table)} ({', '.join(map(quoted, self.index.columns))})"

    def apply(self, engine: Engine) -> None:
        _note(engine, self.index.table, "indexes", self.index)
        keep_facts(engine, self.index.table)


@dataclass(frozen=True)
class DropIndex(Change):
    table: str
    name: str

    def text(self) -> str:
        return f"DROP INDEX {quoted(self.name)} ON {quoted(self.table)}"

    def apply(self, engine: Engine) -> None:
        known = _known(engine, self.table)
        known["indexes"] = tuple(i for i in known.get("indexes", ()) if i.name != self.name)
        keep_facts(engine, self.table)


@dataclass(frozen=True)
class InsertRow(Change):
    table: str
    values: dict[str, Any] = field(default_factory=dict)

    def text(self) -> str:
        return f"INSERT INTO {quoted(self.table)} ({', '.join(map(quoted, self.values))}) VALUES ({', '.join(map(sql_text, self.values.values()))})"

    def apply(self, engine: Engine) -> None:
        engine.append_rows(self.table, [self.values])


@dataclass(frozen=True)
class UpdateRows(Change):
    """Sets constants, and ``expressions`` in SQL text, where the condition holds."""

    table: str
    values: dict[str, Any] = field(default_factory=dict)
    where: Where = Where()
    expressions: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        sets = [f"{quoted(c)} = {sql_text(v)}" for c, v in self.values.items()] + [f"{quoted(c)} = {e}" for c, e in self.expressions.items()]
        return f"UPDATE {quoted(self.table)} SET {', '.join(sets)}" + (f" WHERE {self.where.text()}" if self.where.terms else "")

    def apply(self, engine: Engine) -> None:
        sets = self.values | {c: F.expr(e) for c, e in self.expressions.items()}
        engine.replace(self.table, changes.update(engine.frame(self.table), sets, self.where))


@dataclass(frozen=True)
class DeleteRows(Change):
    table: str
    where: Where = Where()

    def text(self) -> str:
        return f"DELETE FROM {quoted(self.table)}" + (f" WHERE {self.where.text()}" if self.where.terms else "")

    def apply(self, engine: Engine) -> None:
        engine.replace(self.table, changes.delete(engine.frame(self.table), self.where))


@dataclass(frozen=True)
class RawSql(Change):
    sql: str

    def text(self) -> str:
        return self.sql

    def apply(self, engine: Engine) -> None:
        engine.spark.sql(self.sql)


@dataclass(frozen=True)
class Native(Change):
    """A callable that gets the engine; its name stands for it in texts."""

    name: str
    call: Callable[[Engine], None] = field(compare=False)

    def text(self) -> str:
        return f"-- {self.name}"

    def apply(self, engine: Engine) -> None:
        self.call(engine)


def plan_of_record(record: Any) -> CreateTable:
    """The table that a record needs."""
    links = {r.columns: r for r in record.relations.values() if hasattr(r, "columns")}
    made = CreateTable(record.table_name)
    for f in record.members.values():
        to = links.get((f.column,))
        target = None
        if to is not None:
            from tidewater.operators.records import record_named

            target = (record_named(to.to).table_name, record_named(to.to).keys()[0].column)
        made = made.column(f.column, f.type, required=not f.nullable, primary_key=f.key != "none", auto=f.key == "auto", references=target)
    return made


def plan_of_table(info: TableInfo) -> CreateTable:
    """The plan that would make a table that was read."""
    single = {k.columns[0]: (k.to_table, k.to_columns[0]) for k in info.foreign_keys if len(k.columns) == 1}
    columns = tuple(Column(c.name, c.type, required=not c.nullable, primary_key=c.name in info.primary_key, references=single.get(c.name)) for c in info.columns)
    return CreateTable(info.name, columns, tuple(k for k in info.foreign_keys if len(k.columns) > 1))
