"""Chains of conditions with the precedence of SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.types import literal, quoted, sql_text

_MISSING = object()


@dataclass(frozen=True)
class Ref:
    """A column on the right of a condition, by its (qualified) name."""

    name: str


@dataclass(frozen=True)
class Term:
    """One condition: how it joins what stands before, whether it is negated, and its two forms."""

    junctor: str
    negated: bool
    column: Callable[[], Column]
    text: Callable[[], str]
    raw: bool = False

    def as_column(self) -> Column:
        return ~self.column() if self.negated else self.column()

    def as_text(self) -> str:
        return f"NOT {self.text()}" if self.negated else self.text()


# The comparisons that a condition may name.
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<=>": lambda a, b: a.eqNullSafe(b),
    "LIKE": lambda a, b: F.like(a, b),
    "NOT LIKE": lambda a, b: ~F.like(a, b),
    "ILIKE": lambda a, b: F.ilike(a, b),
    "RLIKE": lambda a, b: a.rlike(b),
}


def compared(name: str, op: str, value: Any) -> tuple[Callable[[], Column], Callable[[], str]]:
    """A comparison of a column with a value, a column or a one-row query, as a column and as text."""
    op, left = " ".join(op.upper().split()), F.col(quoted(name)) if not isinstance(name, Column) else name
    if op in ("IS", "IS NOT"):
        if value is None:
            test = left.isNull() if op == "IS" else left.isNotNull()
        elif isinstance(value, bool):
            test = left.eqNullSafe(F.lit(value)) if op == "IS" else ~left.eqNullSafe(F.lit(value))
        else:
            raise ValueError(f"{op} takes null or a truth value")
        return lambda: test, lambda: f"{quoted(name)} {op} {sql_text(value)}"
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}; use where_raw() for other conditions")
    if isinstance(value, Ref):
        return lambda: _COMPARE[op](left, F.col(quoted(value.name))), lambda: f"{quoted(name)} {op} {quoted(value.name)}"
    if isinstance(value, DataFrame) or hasattr(value, "all"):
        frame = value if isinstance(value, DataFrame) else value.all()
        return lambda: _COMPARE[op](left, frame.scalar()), _no_text
    return lambda: _COMPARE[op](left, value if isinstance(value, Column) else literal(value)), lambda: f"{quoted(name)} {op} {sql_text(value)}"


def _member(name: str, frame: DataFrame) -> Column:
    """Membership of a column in a one-column frame, null where SQL doesn't know it.

    Spark's own NOT IN sends the whole frame to the driver and to every executor, since it looks for
    nulls in it.  Here the frame is joined by shuffle, and one row tells if it is empty or holds a null.
    """
    # The outer column must not be found inside: the inner name differs, and the alias hides what the frame was made of.
    inner = f"{name.replace('.', '_')}_"
    values, value, outer = frame.toDF(inner).alias(inner), F.col(quoted(inner)), F.col(quoted(name)).outer()
    found = values.where(value == outer).exists()
    with_null = values.select(F.max(value.isNull())).scalar()  # null of no values
    return found | ~(with_null.isNull() | F.col(quoted(name)).isNotNull() & ~with_null | F.lit(None).cast("boolean"))


def _no_text() -> str:
    raise ValueError("a chain with a raw condition can't hold a subquery; put the subquery in the raw text")


@dataclass(frozen=True)
class Where:
    """An immutable chain of conditions.  AND binds tighter than OR; NOT binds to the next condition."""

    terms: tuple[Term, ...] = ()
    next_junctor: str = "AND"
    next_negated: bool = False

    def _add(self, column: Callable[[], Column], text: Callable[[], str], raw: bool = False, junctor: str | None = None):
        term = Term(junctor or self.next_junctor, self.next_negated, column, text, raw)
        return replace(self, terms=(*self.terms, term), next_junctor="AND", next_negated=False)

    def and_(self):
        return replace(self, next_junctor="AND")

    def or_(self):
        return replace(self, next_junctor="OR")

    def not_(self):
        return replace(self, next_negated=not self.next_negated)

    def where(self, first: Any, second: Any = _MISSING, third: Any = _MISSING):
        """``where(column, value)``, ``where(column, comparison, value)``, or ``where(callable)`` for a group.

        Without a comparison a null value tests for null, as its negation tests for a value; with
        one the comparison stands as it is, and is never true of null.
        """
        if second is _MISSING:
            return self._group(first)
        if third is _MISSING:
            if second is None:
                return self._add(*compared(first, "IS", None))
            return self._add(*compared(first, "=", second))
        return self._add(*compared(first, second, third))

    def or_where(self, *condition: Any):
        return self.or_().where(*condition)

    def _group(self, build: Callable[["Where"], "Where"]):
        inner = build(Where())
        if not inner.terms:  # nothing to add: the chain goes on as before
            return self
        return self._add(inner.column, lambda: f"({inner.text()})", inner.raw)

    def where_in(self, name: str, values: Iterable[Any] | DataFrame):
        """Membership in values or in a one-column query; no values match nothing."""
        if isinstance(values, DataFrame) or hasattr(values, "all"):
            frame = values if isinstance(values, DataFrame) else values.all()
            return self._add(lambda: _member(name, frame), _no_text)
        values = list(values)
        if not values:
            return self._add(lambda: F.lit(False), lambda: "FALSE")
        return self._add(
            lambda: F.col(quoted(name)).isin([literal(v) for v in values]),
            lambda: f"{quoted(name)} IN ({', '.join(map(sql_text, values))})",
        )

    def where_null(self, name: str):
        return self._add(*compared(name, "IS", None))

    def where_not_null(self, name: str):
        return self._add(*compared(name, "IS NOT", None))

    def where_not_equal(self, name: str, value: Any):
        return self._add(*(compared(name, "IS NOT", None) if value is None else compared(name, "!=", value)))

    def where_true(self, name: str):
        return self._add(*compared(name, "=", True))

    def where_false(self, name: str):
        return self._add(*compared(name, "=", False))

    def where_raw(self, text: str):
        """A condition in SQL text, which joins the chain as text does: its own ORs are not bracketed."""
        return self._add(lambda: F.expr(text), lambda: text, raw=True)

    def if_(self, value: Any):
        """``if_(value).then_where(column[, comparison])`` adds a condition only if there is a value."""
        return Maybe(self, value)

    @property
    def raw(self) -> bool:
        return any(t.raw for t in self.terms)

    def text(self) -> str:
        return "".join((f" {t.junctor} " if k else "") + t.as_text() for k, t in enumerate(self.terms))

    def column(self) -> Column | None:
        """The chain as one column, None without conditions."""
        if not self.terms:
            return None
        if self.raw:
            return F.expr(self.text())
        runs: list[list[Column]] = [[]]
        for k, term in enumerate(self.terms):
            if k and term.junctor == "OR":
                runs.append([])
            runs[-1].append(term.as_column())
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, run) for run in runs])


@dataclass(frozen=True)
class Maybe:
    chain: Any
    value: Any

    def then_where(self, name: str, op: str = "="):
        return self.chain if self.value is None else self.chain.where(name, op, self.value)
