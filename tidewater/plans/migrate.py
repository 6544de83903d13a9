"""Versioned migrations: order, checksums, history, and folding to one net schema."""

from __future__ import annotations

import datetime as dt
import hashlib
import heapq
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from tidewater.functions.types import quoted
from tidewater.plans import ddl
from tidewater.sources.engine import Engine
from tidewater.sources.introspect import ForeignKey

HISTORY = "schema_migrations"


@dataclass(frozen=True)
class Migration:
    """Steps up, and down if they can be undone; ``version`` is a timestamp, ``depends`` names others."""

    version: int
    title: str
    up: tuple[ddl.Change, ...]
    down: tuple[ddl.Change, ...] | None = None
    depends: tuple[int, ...] = ()

    def checksum(self) -> str:
        return hashlib.sha256("\n".join(c.text() for c in self.up).encode()).hexdigest()


@dataclass
class Status:
    version: int
    title: str
    applied_at: dt.datetime | None
    matches: bool | None  # whether the recorded checksum is that of the migration; None if unapplied or unknown


@dataclass
class Migrations:
    engine: Engine
    known: dict[int, Migration] = field(default_factory=dict)
    releases: dict[str, int] = field(default_factory=dict)

    def register(self, *migrations: Migration) -> "Migrations":
        for m in migrations:
            if m.version in self.known:
                raise ValueError(f"two migrations are version {m.version}")
            self.known[m.version] = m
        return self

    def release(self, name: str, version: int) -> "Migrations":
        """Name the state after a version."""
        self.releases[name] = version
        return self

    def ordered(self) -> list[Migration]:
        """Every migration after those it depends on, else by version."""
        for m in self.known.values():
            if missing := [d for d in m.depends if d not in self.known]:
                raise ValueError(f"{m.version} depends on {missing[0]}, which isn't known")
        waits = {v: set(m.depends) for v, m in self.known.items()}
        ready = [v for v, w in waits.items() if not w]
        heapq.heapify(ready)
        out = []
        while ready:
            version = heapq.heappop(ready)
            out.append(self.known[version])
            for other, w in waits.items():
                if version in w:
                    w.remove(version)
                    if not w:
                        heapq.heappush(ready, other)
        if len(out) < len(self.known):
            raise ValueError("migrations depend on each other in a circle: " + ", ".join(str(v) for v, w in sorted(waits.items()) if w))
        return out

    # -- history ------------------------------------------------------------------------------

    def _history(self) -> dict[int, Any]:
        self.engine.spark.sql(f"CREATE TABLE IF NOT EXISTS {HISTORY} (version BIGINT, title STRING, checksum STRING, applied_at TIMESTAMP_NTZ) USING parquet")
        return {r["version"]: r for r in self.engine.spark.table(HISTORY).collect()}  # a row for each migration

    def _record(self, m: Migration) -> None:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self.engine.append_rows(HISTORY, [{"version": m.version, "title": m.title, "checksum": m.checksum(), "applied_at": now}])

    def _forget(self, versions: Iterable[int]) -> None:
        from tidewater.operators.changes import delete

        versions = list(versions)
        self.engine.replace(HISTORY, delete(self.engine.spark.table(HISTORY), lambda w: w.where_in("version", versions)))

    def pending(self, until: str | int | None = None) -> list[Migration]:
        last = self.releases[until] if isinstance(until, str) else until
        done = self._history()
        return [m for m in self.ordered() if m.version not in done and (last is None or m.version <= last)]

    def preview(self, until: str | int | None = None) -> list[str]:
        return [c.text() for m in self.pending(until) for c in m.up]

    def apply(self, until: str | int | None = None, visit: Callable[[Migration], None] | None = None) -> list[int]:
        """Apply what is pending, each recorded as soon as it is done."""
        done = []
        for m in self.pending(until):
            self._run(m)
            done.append(m.version)
            if visit:
                visit(m)
        return done

    def apply_one(self, version: int) -> None:
        """Apply one migration, if what it depends on is applied."""
        m, done = self.known[version], self._history()
        if version in done:
            raise ValueError(f"{version} is applied")
        if missing := [d for d in m.depends if d not in done]:
            raise ValueError(f"{version} depends on {missing[0]}, which isn't applied")
        self._run(m)

    def _run(self, m: Migration) -> None:
        with self.engine.told(f"migration {m.version}"):
            for change in m.up:
                change.apply(self.engine)
            self._record(m)

    def revert(self, version: int) -> None:
        m = self.known[version]
        if version not in self._history():
            raise ValueError(f"{version} isn't applied")
        if m.down is None:
            raise ValueError(f"{version} can't be undone")
        if later := [o.version for o in self.known.values() if version in o.depends and o.version in self._history()]:
            raise ValueError(f"{later[0]} depends on {version}")
        for change in m.down:
            change.apply(self.engine)
        self._forget([version])

    def revert_to(self, version: int) -> list[int]:
        """Undo, last first, all that were applied after a version."""
        done = self._history()
        later = [m.version for m in reversed(self.ordered()) if m.version in done and m.version > version]
        for v in later:
            self.revert(v)
        return later

    def mark_applied(self, version: int) -> None:
        """Record a migration without running it."""
        if version not in self._history():
            self._record(self.known[version])

    def verify(self) -> list[int]:
        """Versions whose recorded checksum is no longer that of the migration."""
        return [v for v, r in sorted(self._history().items()) if v in self.known and r["checksum"] != self.known[v].checksum()]

    def rewrite_checksums(self) -> list[int]:
        changed = self.verify()
        self._forget(changed)
        for v in changed:
            self._record(self.known[v])
        return changed

    def status(self) -> list[Status]:
        done = self._history()
        rows = [Status(m.version, m.title, done[m.version]["applied_at"] if m.version in done else None, done[m.version]["checksum"] == m.checksum() if m.version in done else None) for m in self.ordered()]
        return rows + [Status(v, r["title"], r["applied_at"], None) for v, r in sorted(done.items()) if v not in self.known]

    def hard_reset(self) -> None:
        """Drop every table that the migrations made, and the history."""
        for change in fold(self.ordered()):
            if isinstance(change, (ddl.CreateTable, ddl.RenameTable)):
                ddl.DropTable(change.to if isinstance(change, ddl.RenameTable) else change.table, if_exists=True, cascade=True).apply(self.engine)
        self.engine.spark.sql(f"DROP TABLE IF EXISTS {quoted(HISTORY)}")


class _Fold:
    """The state of a fold: tables by the name they have now, indexes, and what runs after them."""

    def __init__(self) -> None:
        self.tables: dict[str, ddl.CreateTable] = {}
        self.indexes: dict[str, ddl.CreateIndex] = {}
        self.rest: list[ddl.Change] = []
        self.fixed: dict[str, str] = {}  # tables that data steps have read, by the name they have now: the name they are made under

    def steps_of(self, *tables: str) -> list[ddl.Change]:
        return [r for r in self.rest if getattr(r, "table", None) in tables]

    def fix(self, *tables: str) -> None:
        """What follows on these tables keeps its place after the data steps so far."""
        for name in tables:
            self.fixed.setdefault(name, name)

    def keys(self, change: Callable[[ForeignKey], ForeignKey | None]) -> None:
        """Change, or drop, every key, whether a table's or a column's."""
        for name, made in self.tables.items():
            kept = [k for k in map(change, made.foreign_keys) if k is not None]
            columns = []
            for c in made.columns:
                if c.references:
                    key = change(ForeignKey(name, (c.name,), c.references[0], (c.references[1],)))
                    c = replace(c, references=(key.to_table, key.to_columns[0]) if key else None)
                columns.append(c)
            self.tables[name] = replace(made, columns=tuple(columns), foreign_keys=tuple(kept))

    def drop_table(self, step: ddl.DropTable) -> None:
        made = self.fixed.pop(step.table, step.table)
        self.tables.pop(made, None)
        self.keys(lambda k: None if k.to_table in (made, step.table) else k)
        self.indexes = {n: i for n, i in self.indexes.items() if i.index.table not in (made, step.table)}
        gone = self.steps_of(made, step.table)
        self.rest = [r for r in self.rest if r not in gone]

    def rename_table(self, step: ddl.RenameTable) -> None:
        self.tables[step.to] = replace(self.tables.pop(step.table), table=step.to)
        self.keys(lambda k: ddl.moved_key(k, step.table, step.to))
        self.indexes = {n: ddl.CreateIndex(replace(i.index, table=step.to)) if i.index.table == step.table else i for n, i in self.indexes.items()}
        self.rest = [replace(r, table=step.to) if getattr(r, "table", None) == step.table else r for r in self.rest]

    def on_column(self, table: str, name: str, change: Callable[[ddl.Column], ddl.Column | None]) -> None:
        made = self.tables[table]
        self.tables[table] = replace(made, columns=tuple(n for c in made.columns for n in [change(c) if c.name == name else c] if n is not None))

    def on_rows(self, table: str, change: Callable[[dict[str, Any]], dict[str, Any]]) -> None:
        self.rest = [replace(r, values=change(r.values)) if isinstance(r, ddl.InsertRow) and r.table == table else r for r in self.rest]

    def rename_column(self, step: ddl.RenameColumn) -> None:
        new = lambda c: step.to if c == step.column else c
        self.keys(lambda k: ddl.renamed_key(k, step.table, new))
        self.on_column(step.table, step.column, lambda c: replace(c, name=step.to))
        self.indexes = {n: ddl.CreateIndex(replace(i.index, columns=tuple(map(new, i.index.columns)))) if i.index.table == step.table else i for n, i in self.indexes.items()}
        self.on_rows(step.table, lambda values: {new(c): v for c, v in values.items()})

    def drop_column(self, step: ddl.DropColumn) -> None:
        uses = lambda table, columns: table == step.table and step.column in columns
        self.keys(lambda k: None if uses(k.table, k.columns) or uses(k.to_table, k.to_columns) else k)
        self.on_column(step.table, step.column, lambda c: None)
        self.indexes = {n: i for n, i in self.indexes.items() if not uses(i.index.table, i.index.columns)}
        self.on_rows(step.table, lambda values: {c: v for c, v in values.items() if c != step.column})

    def take(self, step: ddl.Change) -> None:
        table = step.key.table if isinstance(step, ddl.AddForeignKey) else step.index.table if isinstance(step, ddl.CreateIndex) else getattr(step, "table", None)
        folded = table in self.tables and table not in self.fixed
        made = self.tables.get(table)
        if isinstance(step, ddl.CreateTable):
            if not (step.if_not_exists and (step.table in self.tables or step.table in self.fixed)):
                self.tables[step.table] = replace(step, if_not_exists=False)
        elif isinstance(step, ddl.DropTable):
            self.drop_table(step)
        elif isinstance(step, ddl.InsertRow) and folded:
            self.rest.append(step)
        elif isinstance(step, ddl.AlterColumn) and folded and self.steps_of(table):  # its rows are to be cast
            self.fix(table)
            self.rest.append(step)
        elif isinstance(step, ddl.RenameTable) and folded:
            self.rename_table(step)
        elif isinstance(step, ddl.AddColumn) and folded:
            if step.column.name not in [c.name for c in made.columns]:
                self.tables[table] = replace(made, columns=(*made.columns, step.column))
                if step.column.default is not None:
                    self.on_rows(table, lambda values: {step.column.name: step.column.default} | values)
        elif isinstance(step, ddl.AlterColumn) and folded:
            self.on_column(table, step.column, lambda c: replace(c, type=step.type, required=step.required))
        elif isinstance(step, ddl.RenameColumn) and folded:
            self.rename_column(step)
        elif isinstance(step, ddl.DropColumn) and folded:
            self.drop_column(step)
        elif isinstance(step, ddl.AddForeignKey) and folded:
            self.tables[table] = replace(made, foreign_keys=(*made.foreign_keys, step.key))
        elif isinstance(step, ddl.DropForeignKey) and folded:
            self.keys(lambda k: None if k.table == table and k.columns == step.columns else k)
        elif isinstance(step, ddl.CreateIndex) and folded:
            self.indexes[step.index.name] = step
        elif isinstance(step, ddl.DropIndex) and folded:
            self.indexes.pop(step.name, None)
        else:
            if isinstance(step, ddl.RenameTable) and table in self.fixed:
                self.fixed[step.to] = self.fixed.pop(table)
            elif table is None:  # SQL or a callable may read any table
                self.fix(*self.tables)
            else:
                self.fix(table)
            self.rest.append(step)


def fold(migrations: Iterable[Migration]) -> list[ddl.Change]:
    """The net effect of migrations in order: tables first, then indexes, then data steps and the rest.

    Names in keys, indexes and inserted rows follow renames, wherever they point.  A step that reads
    rows (an update, a deletion, SQL, a callable) finds its tables as they were: later changes of
    these tables stay after it, in order.  Steps of tables that are gone go too.
    """
    state = _Fold()
    for step in (c for m in migrations for c in m.up):
        state.take(step)
    return [*state.tables.values(), *state.indexes.values(), *state.rest]
