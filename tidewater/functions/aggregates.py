"""Aggregates of the query builder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.types import quoted


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of one column; the column's name may be qualified."""

    name: str
    column: str

    def to_column(self) -> Column:
        if self.name == "count" and (self.column == "*" or self.column.endswith(".*")):
            return F.count(F.lit(1))  # rows: of "t.*" Spark would count rows without any null
        made = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.name]
        return made(F.col(quoted(self.column)))

    def label(self) -> str:
        return f"{self.name}({self.column})"


def count(column: str = "*") -> Aggregate:
    return Aggregate("count", column)


def total(column: str) -> Aggregate:
    return Aggregate("sum", column)


def average(column: str) -> Aggregate:
    return Aggregate("avg", column)


def least(column: str) -> Aggregate:
    return Aggregate("min", column)


def greatest(column: str) -> Aggregate:
    return Aggregate("max", column)
