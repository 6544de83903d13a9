"""The query builder: immutable, reusable, and lazy until a finisher's frame is used."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.aggregates import Aggregate
from tidewater.functions.types import quoted
from tidewater.operators.predicate import Ref, Where, compared


@dataclass(frozen=True)
class Expr:
    """SQL text in the projection: any expression, aggregate or window that Spark knows."""

    text: str
    aggregate: bool = False


@dataclass(frozen=True)
class On:
    """The ON clause of a join: equalities and other comparisons joined by AND, OR; AND binds tighter."""

    terms: tuple[tuple[str, Callable[[], Column], Callable[[], str]], ...] = ()

    def _with(self, junctor: str, condition: tuple[Callable[[], Column], Callable[[], str]]) -> "On":
        return replace(self, terms=(*self.terms, (junctor, *condition)))

    def on(self, left: str, right: str) -> "On":
        return self._with("AND", compared(left, "=", Ref(right)))

    def or_on(self, left: str, right: str) -> "On":
        return self._with("OR", compared(left, "=", Ref(right)))

    def operator(self, left: str, op: str, right: Any, junctor: str = "AND") -> "On":
        """Any comparison that a condition may name, with a column (``Ref``) or a value on the right."""
        if junctor not in ("AND", "OR"):
            raise ValueError("terms are joined by AND or OR")
        return self._with(junctor, compared(left, op, right))

    def column(self) -> Column | None:
        chain = Where()
        for junctor, column, text in self.terms:
            chain = chain._add(column, text, junctor=junctor)
        return chain.column()


@dataclass(frozen=True)
class Output:
    """A projected item: a name, an aggregate, an expression or a column, and its alias."""

    item: str | Aggregate | Expr | Column
    alias: str | None = None

    @property
    def star(self) -> bool:
        return isinstance(self.item, str) and (self.item == "*" or self.item.endswith(".*"))

    @property
    def aggregate(self) -> bool:
        return isinstance(self.item, Aggregate) or isinstance(self.item, Expr) and self.item.aggregate

    def label(self) -> str:
        if self.alias:
            return self.alias
        if isinstance(self.item, Aggregate):
            return self.item.label()
        if isinstance(self.item, Expr):
            return self.item.text
        return self.item.rpartition(".")[2] if isinstance(self.item, str) else "column"

    def column(self) -> Column:
        if isinstance(self.item, Aggregate):
            made = self.item.to_column()
        elif isinstance(self.item, Expr):
            made = F.expr(self.item.text)
        elif isinstance(self.item, Column):
            return self.item.alias(self.alias) if self.alias else self.item
        elif self.star:
            made = F.col(self.item if self.item == "*" else f"{quoted(self.item[:-2])}.*")
            return made
        else:
            made = F.col(quoted(self.item))
        return made.alias(self.label())


@dataclass(frozen=True)
class Query(Where):
    """A SELECT in the making.  Every method returns a new query; finishers return frames."""

    load: Callable[[str], DataFrame] = field(default=None, compare=False)
    table: str = ""
    name: str = ""  # what columns of the table are qualified by
    joins: tuple[tuple[str, str, str, Column | None], ...] = ()
    outputs: tuple[Output, ...] = ()
    order: tuple[tuple[str, bool, str | None], ...] = ()
    groups: tuple[str, ...] = ()
    is_distinct: bool = False

    # -- projection ---------------------------------------------------------------------------

    def field(self, item: str | Aggregate | Expr | Column) -> "Query":
        return replace(self, outputs=(*self.outputs, Output(item)))

    def as_(self, alias: str) -> "Query":
        """Names the last field; a wildcard or a named field has no further name."""
        if not self.outputs or self.outputs[-1].star or self.outputs[-1].alias:
            raise ValueError("as_() names one field that has no name yet")
        return replace(self, outputs=(*self.outputs[:-1], replace(self.outputs[-1], alias=alias)))

    def field_as(self, item: str, alias: str) -> "Query":
        return self.field(item).as_(alias)

    def fields(self, *names: Any, of: str | None = None) -> "Query":
        """Several columns, or lists of them, or of one table."""
        flat = [n for x in names for n in (x if isinstance(x, (list, tuple)) else [x])]
        return replace(self, outputs=(*self.outputs, *[Output(f"{of}.{n}" if of else n) for n in flat]))

    def fields_of(self, *records: Any) -> "Query":
        """All stored columns of a record; of several records, qualified by their tables."""
        names = [(r.table_name, c) for r in records for c in r.column_names()]
        return self.fields([f"{t}.{c}" if len(records) > 1 else c for t, c in names])

    def build(self, change: Callable[["Query"], "Query"]) -> "Query":
        return change(self)

    def distinct(self) -> "Query":
        return replace(self, is_distinct=True)

    # -- joins --------------------------------------------------------------------------------

    def _join(self, how: str, table: str | tuple[str, str], on: Any, right: str | None) -> "Query":
        table, alias = table if isinstance(table, tuple) else (table, table.rpartition(".")[2])
        if callable(on) and not isinstance(on, str):
            condition = on(On()).column()
            if condition is None:  # no condition, no join
                return self
        else:
            right = right if "." in right else f"{self.name}.{right}"
            condition = F.col(quoted(f"{alias}.{on}")) == F.col(quoted(right))
        return replace(self, joins=(*self.joins, (how, table, alias, condition)))

    def inner_join(self, table: Any, on: Any, right: str | None = None) -> "Query":
        """``inner_join(table, column, other)``: ``other`` is qualified, or a column of the main table.

        ``table`` may be ``(name, alias)``; ``on`` may be a callable that builds an ``On``.
        """
        return self._join("inner", table, on, right)

    def left_join(self, table: Any, on: Any, right: str | None = None) -> "Query":
        return self._join("left", table, on, right)

    def right_join(self, table: Any, on: Any, right: str | None = None) -> "Query":
        return self._join("right", table, on, right)

    def full_join(self, table: Any, on: Any, right: str | None = None) -> "Query":
        return self._join("full", table, on, right)

    def join_records(self, left: tuple[Any, str], right: tuple[Any, str], how: str = "inner") -> "Query":
        """Join the right record's table on two record members: ``(Record, member)`` each."""
        return self._join(how, right[0].table_name, right[1], f"{left[0].table_name}.{left[1]}")

    # -- grouping and order -------------------------------------------------------------------

    def group_by(self, *names: str) -> "Query":
        return replace(self, groups=(*self.groups, *names))

    def order_by(self, name: str, direction: str = "asc", nulls: str | None = None) -> "Query":
        """Sort by a column or an alias.  Nulls come first ascending and last descending, unless ``nulls`` says."""
        if direction not in ("asc", "desc") or nulls not in (None, "first", "last"):
            raise ValueError("directions are asc and desc; nulls come first or last")
        return replace(self, order=(*self.order, (name, direction == "asc", nulls)))

    # -- finishers ----------------------------------------------------------------------------

    def base(self) -> DataFrame:
        """Joins and conditions, before grouping and projection."""
        frame = self.load(self.table).alias(self.name)
        for how, table, alias, condition in self.joins:
            frame = frame.join(self.load(table).alias(alias), condition, how)
        condition = self.column()
        return frame if condition is None else frame.where(condition)

    def _sorted(self, frame: DataFrame, column: Callable[[str], Column]) -> DataFrame:
        keys = []
        for name, up, nulls in self.order:
            nulls = nulls or ("first" if up else "last")
            keys.append(getattr(column(name), f"{'asc' if up else 'desc'}_nulls_{nulls}")())
        return frame.orderBy(*keys) if keys else frame

    def _frame(self) -> DataFrame:
        if not self.outputs:
            raise ValueError("nothing is projected: name fields, or use count()")
        labels = {o.label() for o in self.outputs}
        frame = self.base()
        if self.groups or any(o.aggregate for o in self.outputs):
            frame = self._grouped(frame)
        elif self.is_distinct:
            stars = any(o.star for o in self.outputs)
            if any(n.rpartition(".")[2] not in labels for n, _, _ in self.order) and not stars:
                raise ValueError("a distinct query sorts by what it projects")
            frame = self._sorted(frame.select(*[o.column() for o in self.outputs]).distinct(), lambda n: F.col(quoted(n.rpartition(".")[2])))
        else:
            named = {o.alias: o for o in self.outputs if o.alias}
            frame = self._sorted(frame, lambda n: named[n].column() if n in named else F.col(quoted(n)))
            frame = frame.select(*[o.column() for o in self.outputs])
        return frame

    def _grouped(self, frame: DataFrame) -> DataFrame:
        keys = {name: f"_key{k}" for k, name in enumerate(self.groups)}
        short = {name.rpartition(".")[2]: key for name, key in keys.items()}
        place: dict[str, str] = {}
        aggregates, columns = [], []
        for k, o in enumerate(self.outputs):
            if o.aggregate:
                aggregates.append(o.column().alias(f"_agg{k}"))
                place[o.label()] = f"_agg{k}"
                columns.append(F.col(f"_agg{k}").alias(o.label()))
            else:
                key = keys.get(o.item) or short.get(str(o.item).rpartition(".")[2]) if isinstance(o.item, str) else None
                if key is None:
                    raise ValueError(f"{o.label()} is neither grouped nor aggregated")
                place[o.label()] = key
                columns.append(F.col(key).alias(o.label()))
        grouped = frame.groupBy(*[F.col(quoted(n)).alias(key) for n, key in keys.items()])
        frame = grouped.agg(*(aggregates or [F.count(F.lit(1)).alias("_rows")]))
        found = lambda n: F.col(place.get(n) or keys.get(n) or short[n.rpartition(".")[2]])
        if self.is_distinct:
            frame = frame.select(*columns).distinct()
            return self._sorted(frame, lambda n: F.col(quoted(n.rpartition(".")[2])))
        return self._sorted(frame, found).select(*columns)

    def all(self) -> DataFrame:
        return self._frame()

    def first(self, n: int = 1) -> DataFrame:
        return self._frame().limit(n)

    def range(self, offset: int, limit: int) -> DataFrame:
        """``limit`` rows from ``offset`` on; pages need an order."""
        if not self.order:
            raise ValueError("range() pages through an order: use order_by()")
        return self._frame().offset(offset).limit(limit)

    def count(self) -> DataFrame:
        """COUNT(*) as column ``count``: one row, or one for each group, without the group's key.

        Of a distinct query the counts are distinct, not what they count.
        """
        frame = self.base()
        if self.groups:
            frame = frame.groupBy(*[F.col(quoted(n)).alias(f"_key{k}") for k, n in enumerate(self.groups)]).agg(F.count(F.lit(1)).alias("count")).select("count")
        else:
            frame = frame.agg(F.count(F.lit(1)).alias("count"))
        return frame.distinct() if self.is_distinct else frame

    def count_rows(self) -> int:
        """The number of rows; a grouped query has no single count."""
        if self.groups:
            raise ValueError("a grouped query has a count for each group: use count()")
        return self.count().first()["count"]

    def exists(self) -> bool:
        return not self.base().limit(1).isEmpty()

    def tuples(self, *names: str) -> DataFrame:
        """Joined rows as one struct for each named table."""
        frame = self.base()
        inside = {n: self.load(t).columns for t, n in [(self.table, self.name), *[(t, a) for _, t, a, _ in self.joins]]}
        frame = self._sorted(frame, lambda n: F.col(quoted(n)))
        return frame.select(*[F.struct(*[F.col(quoted(f"{n}.{c}")).alias(c) for c in inside[n]]).alias(n) for n in names])
