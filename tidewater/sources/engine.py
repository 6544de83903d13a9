"""The session and the tables that queries start from."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

from tidewater.functions.types import CONVERTERS, quoted, sql_text
from tidewater.operators.query import Query
from tidewater.operators.raw import run_sql

PROPERTY = "tidewater.facts"  # of a catalog table: its keys, indexes and declared types


def session(app: str = "tidewater", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings, with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


class Engine:
    """Tables by name: Parquet files of a folder, frames under names, JDBC tables, and the catalog's own."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}
        #: tables that this engine has changed: their rows are in the catalog from then on
        self._moved: set[str] = set()
        #: constraints and declared types by table: Spark keeps neither keys nor indexes
        self.constraints: dict[str, dict[str, Any]] = {}
        self.hooks: list[Any] = []

    # -- tables -------------------------------------------------------------------------------

    def register(self, name: str, frame: DataFrame) -> "Engine":
        self._frames[name] = frame
        self._moved.discard(name)
        return self

    def hook(self, hook: Any) -> "Engine":
        """Call ``hook(event, name, seconds)`` around the engine's actions: ``begin``, ``end`` or ``error``."""
        self.hooks.append(hook)
        return self

    @contextmanager
    def told(self, name: str) -> Iterator[None]:
        """Tell the hooks of an action; without hooks it costs nothing."""
        began = time.perf_counter()
        for hook in self.hooks:
            hook("begin", name, 0.0)
        try:
            yield
        except Exception:
            for hook in self.hooks:
                hook("error", name, time.perf_counter() - began)
            raise
        for hook in self.hooks:
            hook("end", name, time.perf_counter() - began)

    def read_file(self, name: str, path: str, kind: str = "parquet", **options: Any) -> "Engine":
        """Register a file or folder of any format that Spark reads."""
        return self.register(name, self.spark.read.format(kind).options(**options).load(path))

    def read_jdbc(self, name: str, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: Any) -> "Engine":
        """Register a server's table; ``partition`` is (key, lowest, highest, number) of parallel key ranges."""
        reader = self.spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        if partition:
            key, low, high, n = partition
            reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=n)
        return self.register(name, reader.load())

    def frame(self, name: str) -> DataFrame:
        if name in self._frames:
            return self._frames[name]
        if self.folder is not None and "." not in name and name not in self._moved:
            try:
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
                return self._frames[name]
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return self.spark.table(quoted(name))

    def names(self) -> list[str]:
        return sorted({*self._frames, *[r["tableName"] for r in self.spark.sql("SHOW TABLES").collect()]})  # names only

    # -- queries ------------------------------------------------------------------------------

    def table(self, name: str, alias: str | None = None) -> Query:
        """A query that starts from a table, under another name if there is an alias."""
        return Query(load=self.frame, table=name, name=alias or name.rpartition(".")[2])

    def schema_table(self, schema: str, name: str) -> Query:
        """A table of a schema; an empty schema is none."""
        return self.table(f"{schema}.{name}" if schema else name)

    def sql(self, text: str, *args: Any) -> DataFrame:
        """SQL with a ``?`` for each argument; every table of the engine is visible to it by name."""
        seen = [name for name in self._frames if "." not in name]
        for name in seen:
            self._frames[name].createOrReplaceTempView(quoted(name))
        try:
            return run_sql(self.spark, text, *args)  # resolves the names, so the views may go
        finally:
            for name in seen:
                self.spark.catalog.dropTempView(name)

    def view(self, *names: str) -> "Engine":
        """Make tables visible to ``sql`` before they are used otherwise."""
        for name in names:
            self.frame(name)
        return self

    # -- writing ------------------------------------------------------------------------------

    def own(self, name: str) -> None:
        """Make a table the catalog's, so that it can be changed.

        Frames under names and files of the folder are never written: the first change copies them
        into the catalog, where the engine reads them from then on.
        """
        frame = self.frame(name)
        if name in self._frames:
            self.replace(name, frame)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table, by column name."""
        self.own(name)
        here = self.spark.table(quoted(name))
        with self.told(f"append {name}"):
            rows.select(*[quoted(c) for c in here.columns]).write.mode("append").insertInto(quoted(name))

    def append_rows(self, name: str, rows: Iterable[dict[str, Any]]) -> None:
        self.own(name)
        here = self.spark.table(quoted(name)).schema
        data = [[CONVERTERS.to_spark(r.get(f.name)) for f in here] for r in rows]
        self.append(name, self.spark.createDataFrame(data, here))

    def append_columns(self, name: str, columns: dict[str, Iterable[Any]]) -> None:
        """Add rows given as columns; columns of different lengths are an error."""
        lists = {c: list(v) for c, v in columns.items()}
        if len({len(v) for v in lists.values()}) > 1:
            raise ValueError("columns differ in length: " + ", ".join(f"{c} {len(v)}" for c, v in lists.items()))
        self.append_rows(name, [dict(zip(lists, row)) for row in zip(*lists.values())])

    def replace(self, name: str, frame: DataFrame) -> None:
        """Put a frame in a table's place, in the catalog.

        The frame is written aside, the old table is renamed, the new one takes its name, and only
        then the old one goes: whatever fails in between, one of the two is still there.  A frame
        registered over another catalog table of that name is an error: the table isn't the engine's.
        """
        tag = uuid.uuid4().hex[:8]
        aside, old = f"{name}__{tag}", f"{name}__{tag}_old"
        exists = self.spark.catalog.tableExists(quoted(name))
        if exists and name in self._frames and name not in self._moved:
            raise ValueError(f"{name} hides a table of the catalog: register it under another name to change it")
        with self.told(f"replace {name}"):
            kept = self.property(name) if exists else None
            frame.write.saveAsTable(quoted(aside), format="parquet")
            if kept:
                self.set_property(aside, kept)
            if exists:
                self.spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(old)}")
            try:
                self.spark.sql(f"ALTER TABLE {quoted(aside)} RENAME TO {quoted(name)}")
            except Exception:
                if exists:
                    self.spark.sql(f"ALTER TABLE {quoted(old)} RENAME TO {quoted(name)}")
                raise
            if exists:
                self.spark.sql(f"DROP TABLE {quoted(old)}")
            self._frames.pop(name, None)
            self._moved.add(name)
            self.spark.catalog.refreshTable(quoted(name))

    def moved(self, name: str, to: str) -> None:
        """A catalog table of the engine has a new name."""
        if name in self._moved:
            self._moved.discard(name)
            self._moved.add(to)

    # -- facts that outlive the process -------------------------------------------------------

    def property(self, name: str) -> str | None:
        """What the engine has noted beside a catalog table."""
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()  # a row for each property
        return next((r["value"] for r in rows if r["key"] == PROPERTY), None)

    def set_property(self, name: str, text: str) -> None:
        self.spark.sql(f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES ({sql_text(PROPERTY)} = {sql_text(text)})")

    def in_catalog(self, name: str) -> bool:
        """Whether the engine reads a table from the catalog."""
        if name in self._frames:
            return False
        try:
            return not self.spark.catalog.getTable(quoted(name)).isTemporary
        except AnalysisException:
            return False


def row_stream(frame: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time, the next one fetched ahead."""
    return frame.toLocalIterator(prefetchPartitions=True)


def row_blocks(frame: DataFrame, rows: int = 1000) -> Iterator[list[Row]]:
    """Rows in blocks of at most ``rows``."""
    block: list[Row] = []
    for row in row_stream(frame):
        block.append(row)
        if len(block) == rows:
            yield block
            block = []
    if block:
        yield block
