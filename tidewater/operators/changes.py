"""Inserts, updates and deletes as frames from frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.types import CONVERTERS, literal
from tidewater.operators.predicate import Where

PART = 1_000_000  # rows that one task numbers, about


def _condition(where: Callable[[Where], Where] | Where | Column | None) -> Column:
    if where is None:
        return F.lit(True)
    if isinstance(where, Column):
        return where
    if getattr(where, "joins", ()):
        raise ValueError("a change of one table takes no joins")
    chain = where if isinstance(where, Where) else where(Where())
    column = chain.column()
    return F.lit(True) if column is None else column


def insert(table: DataFrame, rows: Iterable[Mapping[str, Any]] | DataFrame) -> DataFrame:
    """The table with more rows; columns that a row doesn't name are null."""
    if not isinstance(rows, DataFrame):
        rows = list(rows)
        if unknown := {k for r in rows for k in r} - set(table.columns):
            raise ValueError(f"no column {', '.join(sorted(unknown))}")
        rows = table.sparkSession.createDataFrame([[CONVERTERS.to_spark(r.get(c)) for c in table.columns] for r in rows], table.schema)
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def update(table: DataFrame, values: Mapping[str, Any], where: Any = None) -> DataFrame:
    """The table with columns set where the condition is true; of null it isn't.

    Values are constants, or columns that may use the row's old values.
    """
    if unknown := set(values) - set(table.columns):
        raise ValueError(f"no column {', '.join(sorted(unknown))}")
    hit = F.coalesce(_condition(where), F.lit(False))
    new = {c: (v if isinstance(v, Column) else literal(v)).cast(table.schema[c].dataType) for c, v in values.items()}
    return table.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Any = None) -> DataFrame:
    """The table without the rows of which the condition is true; those of which it is null stay."""
    return table.where(~F.coalesce(_condition(where), F.lit(False)))


def update_rows(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All columns but the keys replaced from ``rows``.

    Of several rows of one key the greatest counts, by all columns in order, so the table never
    gets more rows and a rerun gives the same.  Rows of keys that the table lacks are left out.
    """
    others = [c for c in table.columns if c not in keys]
    fresh = rows.select(*table.columns)
    if others:
        fresh = fresh.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row")).select(*keys, "_row.*").select(*table.columns)
    return table.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.join(table.select(*keys).distinct(), keys, "left_semi")).select(*table.columns)


def delete_rows(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").select(*table.columns)


def with_new_keys(rows: DataFrame, key: str, table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows with dense keys that follow the table's largest.

    Equal rows count together first, so that any number of them is one class.  Classes fall into
    parts by their hash, as many as keep about ``PART`` classes each; numbers inside a part are
    added to what the parts before it hold, so no task sorts all rows.
    """
    by = by or [c for c in rows.columns if c != key]
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    others = [c for c in rows.columns if c != key]
    classes = rows.groupBy(*others).agg(F.count(F.lit(1)).alias("_times"))
    parts = max(1, -(-rows.count() // PART))
    ranged = classes.withColumn("_part", F.pmod(F.xxhash64(*others), F.lit(parts)))
    before = Window.partitionBy("_part").orderBy(*by, *[c for c in others if c not in by]).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_at", F.coalesce(F.sum("_times").over(before), F.lit(0)))
    inside = inside.withColumn("_at", F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + F.col("_times"))))
    sizes = ranged.groupBy("_part").agg(F.sum("_times").alias("count"))
    offsets = sizes.select("_part", (F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    if parts <= 100_000:
        offsets = F.broadcast(offsets)  # a row for each part
    numbered = inside.join(offsets, "_part").crossJoin(F.broadcast(last))  # one row
    return numbered.withColumn(key, (F.col("_last") + F.col("_before") + F.col("_at")).cast(table.schema[key].dataType)).select(*table.columns)


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Members that differ between rows of equal key: the keys, ``member``, ``left`` and ``right`` as text."""
    others = [c for c in left.columns if c not in keys]
    joined = left.alias("a").join(right.alias("b"), keys)
    members = F.array(*[F.struct(F.lit(c).alias("member"), F.col(f"a.{c}").cast("string").alias("left"), F.col(f"b.{c}").cast("string").alias("right"), (~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias("differs")) for c in others])
    return joined.select(*keys, F.explode(members).alias("m")).where("m.differs").select(*keys, "m.member", "m.left", "m.right")
