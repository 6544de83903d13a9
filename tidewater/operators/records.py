"""Records, and the relations between them as joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.types import CONVERTERS, ColumnType, literal, quoted
from tidewater.operators.changes import delete_rows, with_new_keys
from tidewater.operators.query import Query
from tidewater.sources.engine import Engine, row_stream
from tidewater.sources.introspect import ForeignKey, keep_facts

NOT_KEY, KEY, AUTO_KEY, GUID_KEY = "none", "manual", "auto", "guid"


@dataclass
class Field:
    """One stored member of a record: its type, its key kind, its column if that has another name."""

    type: ColumnType
    key: str = NOT_KEY
    column: str | None = None
    nullable: bool = True
    name: str = ""

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name
        self.column = self.column or name

    def __get__(self, record: Any, owner: type) -> Any:
        return self if record is None else record._values.get(self.name)

    def __set__(self, record: Any, value: Any) -> None:
        if record._values.get(self.name) != value or self.name not in record._values:
            record._dirty.add(self.name)
        record._values[self.name] = value


@dataclass
class BelongsTo:
    """A foreign key of this record and the record that it names."""

    to: str
    columns: tuple[str, ...]
    name: str = ""

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name


@dataclass
class HasMany:
    """Records of another table whose foreign key names this one; ``fk`` tells several keys apart."""

    of: str
    fk: str | None = None
    name: str = ""

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name


@dataclass
class Through:
    """Records that a junction record links with this one; ``one`` takes the first by key."""

    of: str
    by: str
    own_fk: str | None = None
    other_fk: str | None = None
    one: bool = False
    name: str = ""

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name


_RECORDS: dict[str, type["Record"]] = {}


class Record:
    """Base of records: ``class Person(Record, table="person")`` with fields and relations as members."""

    table_name: ClassVar[str]
    members: ClassVar[dict[str, Field]]
    relations: ClassVar[dict[str, Any]]

    def __init_subclass__(cls, table: str | None = None, **more: Any):
        super().__init_subclass__(**more)
        cls.table_name = table or cls.__name__
        cls.members = {k: v for base in reversed(cls.__mro__) for k, v in vars(base).items() if isinstance(v, Field)}
        cls.relations = {k: v for base in reversed(cls.__mro__) for k, v in vars(base).items() if isinstance(v, (BelongsTo, HasMany, Through))}
        if sum(f.key in (AUTO_KEY, GUID_KEY) for f in cls.members.values()) > 1:
            raise TypeError("at most one member is assigned by itself")
        _RECORDS[cls.__name__] = cls

    def __init__(self, **values: Any):
        self._values: dict[str, Any] = {}
        self._dirty: set[str] = set(self.members)  # new: everything is to be written
        if unknown := set(values) - set(self.members):
            raise TypeError(f"no member {', '.join(sorted(unknown))}")
        self._values.update(values)

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self._values == other._values  # type: ignore[attr-defined]

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={self._values.get(k)!r}' for k in self.members)})"

    @property
    def modified(self) -> bool:
        return bool(self._dirty)

    def set_modified(self, modified: bool) -> None:
        self._dirty = set(self.members) if modified else set()

    def differs_from(self, other: "Record") -> dict[str, tuple[Any, Any]]:
        """Members with different values, and both values."""
        return {k: (self._values.get(k), other._values.get(k)) for k in self.members if self._values.get(k) != other._values.get(k)}

    def as_row(self) -> dict[str, Any]:
        return {f.column: CONVERTERS.to_spark(self._values.get(k)) for k, f in self.members.items()}

    @classmethod
    def column_names(cls) -> list[str]:
        return [f.column for f in cls.members.values()]

    @classmethod
    def keys(cls) -> list[Field]:
        return [f for f in cls.members.values() if f.key != NOT_KEY]

    @classmethod
    def schema(cls) -> T.StructType:
        return T.StructType([T.StructField(f.column, f.type.spark(), f.nullable and f.key == NOT_KEY, f.type.metadata()) for f in cls.members.values()])

    @classmethod
    def from_row(cls, row: Any) -> "Record":
        record, by_column = cls(), row.asDict()
        record._values = {k: by_column[f.column] for k, f in cls.members.items() if f.column in by_column}
        record.set_modified(False)
        return record

    @classmethod
    def belongs(cls, to: type["Record"], fk: str | None = None) -> BelongsTo:
        """The relation to another record; with several to the same one, ``fk`` names its column."""
        found = [r for r in cls.relations.values() if isinstance(r, BelongsTo) and r.to == to.__name__ and (fk is None or fk in r.columns)]
        if len(found) != 1:
            raise ValueError(f"{cls.__name__} has {len(found)} keys to {to.__name__}" + (": name one" if found else ""))
        return found[0]


def record_named(name: str) -> type[Record]:
    return _RECORDS[name]


class Mapper:
    """Records in and out of an engine's tables, and their relations for whole sets of owners at once."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def query(self, record: type[Record], *members: str) -> Query:
        """A query of all stored columns, or of some members only."""
        return self.engine.table(record.table_name).fields([record.members[m].column for m in members] if members else record.column_names())

    def records(self, record: type[Record], frame: DataFrame) -> Iterator[Record]:
        return map(record.from_row, row_stream(frame))

    def single(self, record: type[Record], *key: Any) -> Record | None:
        keys = record.keys()
        if len(keys) != len(key):
            raise ValueError(f"{record.__name__} has {len(keys)} key columns")
        query = self.query(record)
        for f, value in zip(keys, key):
            query = query.where(f.column, "=", value)
        row = query.first().first()
        return None if row is None else record.from_row(row)

    # -- changes ------------------------------------------------------------------------------

    def create_table(self, record: type[Record]) -> None:
        columns = ", ".join(f"{quoted(f.column)} {f.type.ddl()}" for f in record.members.values())
        self.engine.spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(record.table_name)} ({columns}) USING parquet")
        links = [r for r in record.relations.values() if isinstance(r, BelongsTo) and r.to in _RECORDS]
        self.engine.constraints[record.table_name] = {
            "primary_key": tuple(f.column for f in record.keys()),
            "required": tuple(f.column for f in record.members.values() if not f.nullable or f.key != NOT_KEY),
            "types": {f.column: f.type for f in record.members.values()},
            "foreign_keys": tuple(ForeignKey(record.table_name, r.columns, record_named(r.to).table_name, tuple(f.column for f in record_named(r.to).keys())) for r in links),
        }
        keep_facts(self.engine, record.table_name)

    def _assign(self, record: Record) -> None:
        for name, f in record.members.items():
            if record._values.get(name) is None and f.key == GUID_KEY:
                setattr(record, name, str(uuid.uuid4()))
            elif record._values.get(name) is None and f.key == AUTO_KEY:
                last = self.engine.frame(record.table_name).agg(F.max(f.column)).first()[0]
                setattr(record, name, (last or 0) + 1)

    def create(self, record: Record) -> Record:
        """Add a record; a key that it lacks is made and written back."""
        self._assign(record)
        self.create_explicit(record)
        record.set_modified(False)
        return record

    def create_explicit(self, record: Record) -> None:
        """Add a record as it is, without a new key or marks."""
        self.engine.append_rows(record.table_name, [record.as_row()])

    def create_copy(self, record: Record) -> Record:
        """Add a copy under a new key."""
        own = {k: v for k, v in record._values.items() if record.members[k].key not in (AUTO_KEY, GUID_KEY)}
        return self.create(type(record)(**own))

    def create_all(self, records: Iterable[Record]) -> None:
        """Add many records at once; keys that the engine assigns aren't written back."""
        records = list(records)
        if not records:
            return
        kind = type(records[0])
        rows = self.engine.spark.createDataFrame([list(r.as_row().values()) for r in records], kind.schema() if not self._auto(kind) else T.StructType([T.StructField(f.name, f.dataType) for f in kind.schema()]))
        if auto := self._auto(kind):
            missing = rows.where(F.col(auto).isNull())
            given = rows.where(F.col(auto).isNotNull())
            rows = given.unionByName(with_new_keys(missing, auto, self.engine.frame(kind.table_name).unionByName(given.select(*self.engine.frame(kind.table_name).columns))))
        self.engine.append(kind.table_name, rows)

    @staticmethod
    def _auto(kind: type[Record]) -> str | None:
        return next((f.column for f in kind.members.values() if f.key == AUTO_KEY), None)

    def update(self, record: Record) -> bool:
        """Write the changed members; nothing happens if none has changed.

        Parquet tables have no row changes: this and ``delete`` rewrite the table, whatever the
        number of records.  For more than a few use ``update_all``, ``delete_all`` or ``delete_where``.
        """
        names = [n for n in record._dirty if record.members[n].key == NOT_KEY]
        if not names:
            return False
        from tidewater.operators.changes import update

        table = self.engine.frame(record.table_name)
        self.engine.replace(record.table_name, update(table, {record.members[n].column: record._values.get(n) for n in names}, lambda w: self._by_key(w, record)))
        record.set_modified(False)
        return True

    def update_all(self, records: Iterable[Record]) -> None:
        """Write all members but the keys of many records, changed or not, in one pass."""
        from tidewater.operators.changes import update_rows

        records = list(records)
        if records:
            kind = type(records[0])
            rows = self.engine.spark.createDataFrame([list(r.as_row().values()) for r in records], T.StructType([T.StructField(f.name, f.dataType) for f in kind.schema()]))
            self.engine.replace(kind.table_name, update_rows(self.engine.frame(kind.table_name), rows, [f.column for f in kind.keys()]))

    def delete(self, record: Record) -> int:
        """Remove a record by its key; the number of rows that went."""
        return self.delete_all([record])

    def delete_all(self, records: Iterable[Record]) -> int:
        """Remove many records of one kind by their keys, in one pass; the number of rows that went."""
        records = list(records)
        if not records:
            return 0
        table = self.engine.frame(records[0].table_name)
        key = [f.column for f in records[0].keys()]
        rows = self.engine.spark.createDataFrame([[r.as_row()[c] for c in key] for r in records], T.StructType([table.schema[c] for c in key]))
        return self._left(records[0].table_name, table, delete_rows(table, rows, key))

    def delete_where(self, record: type[Record], where: Any) -> int:
        """Remove the records of which a condition is true; the number that went."""
        from tidewater.operators.changes import delete

        table = self.engine.frame(record.table_name)
        return self._left(record.table_name, table, delete(table, where))

    def _left(self, name: str, table: DataFrame, left: DataFrame) -> int:
        """Replace a table by what is left of it, unless that is all; the number of rows that went."""
        gone = table.count() - left.count()
        if gone:
            self.engine.replace(name, left)
        return gone

    def each(self, kind: type[Record], relation: str, owner: Record, visit: Callable[[Record], Any]) -> int:
        """Visit what a relation holds for one record, in the order of its key, a partition at a time; how many there were."""
        link = kind.relations[relation]
        to = record_named(link.to if isinstance(link, BelongsTo) else link.of)
        if isinstance(link, BelongsTo):
            frame = self.query(to)
            for f, column in zip(to.keys(), link.columns):
                frame = frame.where(f.column, "=", next(owner._values.get(n) for n, m in kind.members.items() if m.column == column))
            frame = frame.all()
        else:
            key = kind.keys()[0]
            owners = self.engine.frame(kind.table_name).where(F.col(quoted(key.column)) == literal(owner._values.get(key.name)))
            frame = (self.children if isinstance(link, HasMany) else self.through)(kind, relation, owners)
            frame = frame.orderBy(*[quoted(f.column) for f in to.keys()])
        n = 0
        for n, record in enumerate(self.records(to, frame), 1):
            visit(record)
        return n

    @staticmethod
    def _by_key(where: Any, record: Record) -> Any:
        for f in record.keys():
            where = where.where(f.column, "=", record._values.get(f.name))
        return where

    # -- relations ----------------------------------------------------------------------------

    def _frame(self, kind: type[Record], alias: str) -> DataFrame:
        return self.engine.frame(kind.table_name).select(*map(quoted, kind.column_names())).alias(alias)

    @staticmethod
    def _match(left: str, left_columns: Iterable[str], right: str, right_columns: Iterable[str]):
        condition = None
        for a, b in zip(left_columns, right_columns, strict=True):
            one = F.col(quoted(f"{left}.{a}")) == F.col(quoted(f"{right}.{b}"))
            condition = one if condition is None else condition & one
        return condition

    def parents(self, kind: type[Record], relation: str, owners: DataFrame | None = None) -> DataFrame:
        """``owner`` and ``parent`` structs: each record with what its (composite) key names, or null."""
        link = kind.relations[relation]
        to = record_named(link.to)
        if len(link.columns) != len(to.keys()):
            raise ValueError(f"{relation} doesn't cover the key of {link.to}")
        owner = (self._frame(kind, "o") if owners is None else owners.alias("o"))
        parent = self._frame(to, "p").select(F.struct("p.*").alias("parent"), *[F.col(f"p.{f.column}").alias(f"_k{i}") for i, f in enumerate(to.keys())]).alias("p")
        condition = self._match("o", link.columns, "p", [f"_k{i}" for i in range(len(link.columns))])
        return owner.join(parent, condition, "left").select(F.struct("o.*").alias("owner"), "parent")

    def _children(self, kind: type[Record], relation: str, owners: DataFrame | None) -> DataFrame:
        link = kind.relations[relation]
        child = record_named(link.of)
        key, fk = kind.keys()[0].column, child.belongs(kind, link.fk).columns[0]
        owner = (self._frame(kind, "o") if owners is None else owners.alias("o")).select(F.col(quoted(key)).alias("owner_key"))
        return owner.join(self._frame(child, "c"), F.col("owner_key") == F.col(quoted(f"c.{fk}"))).select("owner_key", "c.*")

    def children(self, kind: type[Record], relation: str, owners: DataFrame | None = None) -> DataFrame:
        """``owner_key`` and the child's columns for all owners at once, by owner and child key."""
        keys = record_named(kind.relations[relation].of).keys()
        return self._children(kind, relation, owners).orderBy("owner_key", *[quoted(f.column) for f in keys])

    def children_lists(self, kind: type[Record], relation: str, owners: DataFrame | None = None) -> DataFrame:
        """``owner_key`` and its children as one sorted array: for owners with few children."""
        child = record_named(kind.relations[relation].of)
        order = [f.column for f in child.keys()]
        members = F.struct(*map(quoted, order), *[quoted(c) for c in child.column_names() if c not in order])
        return self._children(kind, relation, owners).groupBy("owner_key").agg(F.array_sort(F.collect_list(members)).alias("children"))

    def children_counts(self, kind: type[Record], relation: str, owners: DataFrame | None = None) -> DataFrame:
        """``owner_key`` and ``count`` for every owner, 0 without children; children are counted before the join."""
        link = kind.relations[relation]
        child = record_named(link.of)
        key, fk = kind.keys()[0].column, child.belongs(kind, link.fk).columns[0]
        counts = self.engine.frame(child.table_name).groupBy(F.col(quoted(fk)).alias("_fk")).agg(F.count(F.lit(1)).alias("n"))
        owner = (self._frame(kind, "o") if owners is None else owners).select(F.col(quoted(key)).alias("owner_key"))
        return owner.join(counts, F.col("owner_key") == F.col("_fk"), "left").select("owner_key", F.coalesce("n", F.lit(0)).alias("count"))

    def _hops(self, kind: type[Record], link: Through) -> tuple[type[Record], DataFrame]:
        other, between = record_named(link.of), record_named(link.by)
        own_fk = between.belongs(kind, link.own_fk).columns[0]
        try:
            other_fk = between.belongs(other, link.other_fk).columns[0]
            pairs = self.engine.frame(between.table_name).select(F.col(quoted(own_fk)).alias("owner_key"), F.col(quoted(other_fk)).alias("_other"))
            other_key = other.keys()[0].column
        except ValueError:  # the far record names the junction
            pairs = self.engine.frame(between.table_name).select(F.col(quoted(own_fk)).alias("owner_key"), F.col(quoted(between.keys()[0].column)).alias("_other"))
            other_key = other.belongs(between, link.other_fk).columns[0]
        joined = pairs.alias("j").join(self._frame(other, "x"), F.col("j._other") == F.col(quoted(f"x.{other_key}"))).select("j.owner_key", "x.*")
        return other, joined.where("owner_key is not null")

    def through(self, kind: type[Record], relation: str, owners: DataFrame | None = None) -> DataFrame:
        """``owner_key`` and the far record's columns; of a relation to one, the first by key."""
        link = kind.relations[relation]
        other, found = self._hops(kind, link)
        if owners is not None:
            found = found.join(owners.select(F.col(quoted(kind.keys()[0].column)).alias("owner_key")).distinct(), "owner_key", "left_semi")
        if link.one:
            first = Window.partitionBy("owner_key").orderBy(*[quoted(f.column) for f in other.keys()])
            found = found.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at")
        return found

    def through_counts(self, kind: type[Record], relation: str) -> DataFrame:
        """``owner_key`` and ``count`` for every owner."""
        _, found = self._hops(kind, kind.relations[relation])
        counts = found.groupBy(F.col("owner_key").alias("_of")).agg(F.count(F.lit(1)).alias("n"))
        owner = self._frame(kind, "o").select(F.col(quoted(kind.keys()[0].column)).alias("owner_key"))
        return owner.join(counts, F.col("owner_key") == F.col("_of"), "left").select("owner_key", F.coalesce("n", F.lit(0)).alias("count"))

    def load_relations(self, kind: type[Record], owners: DataFrame | None = None) -> dict[str, DataFrame]:
        """One lazy frame for each relation of all owners, in place of a lookup for each."""
        load = {BelongsTo: self.parents, HasMany: self.children, Through: self.through}
        return {name: load[type(link)](kind, name, owners) for name, link in kind.relations.items()}
