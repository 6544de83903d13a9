"""The column types of records and schemas, and what Spark stores them as."""

from __future__ import annotations

import datetime as dt
import decimal
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnType:
    """A declared type: its name, its size or precision, and a scale for decimals."""

    name: str
    size: int | None = None
    scale: int | None = None

    def spark(self) -> T.DataType:
        """The Spark type; a size that Spark can't hold in a query stays in the field's metadata."""
        if self.name == "decimal":
            return T.DecimalType(self.size or 10, self.scale or 0)
        if self.name == "real":
            return T.DoubleType() if self.size is None or self.size > 24 else T.FloatType()
        return _SPARK[self.name]()

    def ddl(self) -> str:
        """The type as CREATE TABLE spells it."""
        if self.name in ("char", "nchar"):
            return f"CHAR({self.size or 1})"
        if self.name in ("varchar", "nvarchar") and self.size:
            return f"VARCHAR({self.size})"
        return self.spark().simpleString().upper()

    def metadata(self) -> dict[str, Any]:
        return {"declared": self.name} | ({"size": self.size} if self.size is not None else {}) | ({"scale": self.scale} if self.scale is not None else {})


# Without a zone in the model, date-times are timestamps without one; times have microseconds.
_SPARK: dict[str, Callable[[], T.DataType]] = {
    "bigint": T.LongType, "binary": T.BinaryType, "bool": T.BooleanType, "char": T.StringType, "date": T.DateType,
    "datetime": T.TimestampNTZType, "guid": T.StringType, "integer": T.IntegerType, "nchar": T.StringType,
    "nvarchar": T.StringType, "smallint": T.ShortType, "text": T.StringType, "time": T.TimeType,
    "timestamp": T.TimestampNTZType, "tinyint": T.ByteType, "varbinary": T.BinaryType, "varchar": T.StringType,
}

Bigint, Bool, Date, DateTime, Guid, Integer = (ColumnType(n) for n in ("bigint", "bool", "date", "datetime", "guid", "integer"))
Smallint, Time, Timestamp, Tinyint = (ColumnType(n) for n in ("smallint", "time", "timestamp", "tinyint"))


def Binary(size: int = 255) -> ColumnType:
    return ColumnType("binary", size)


def Char(size: int = 1) -> ColumnType:
    return ColumnType("char", size)


def Decimal(precision: int, scale: int) -> ColumnType:
    if not 1 <= precision <= 38 or not 0 <= scale <= precision:
        raise ValueError(f"decimal({precision}, {scale}) can't be stored")
    return ColumnType("decimal", precision, scale)


def NChar(size: int = 1) -> ColumnType:
    return ColumnType("nchar", size)


def NVarchar(size: int = 255) -> ColumnType:
    return ColumnType("nvarchar", size)


def Real(precision: int = 53) -> ColumnType:
    return ColumnType("real", precision)


def Text(size: int | None = None) -> ColumnType:
    return ColumnType("text", size)


def VarBinary(size: int = 255) -> ColumnType:
    return ColumnType("varbinary", size)


def Varchar(size: int = 255) -> ColumnType:
    return ColumnType("varchar", size)


def declared(field: T.StructField) -> ColumnType:
    """The declared type of a stored field: from its metadata, else the nearest for its Spark type."""
    kept = field.metadata or {}
    if "declared" in kept:
        return ColumnType(kept["declared"], kept.get("size"), kept.get("scale"))
    kind = field.dataType
    if isinstance(kind, T.DecimalType):
        return Decimal(kind.precision, kind.scale)
    if isinstance(kind, (T.CharType, T.VarcharType)):
        return (Char if isinstance(kind, T.CharType) else Varchar)(kind.length)
    near = {
        T.LongType: Bigint, T.IntegerType: Integer, T.ShortType: Smallint, T.ByteType: Tinyint, T.BooleanType: Bool, T.DateType: Date,
        T.TimestampNTZType: DateTime, T.TimestampType: DateTime, T.StringType: Text(), T.BinaryType: VarBinary(0), T.DoubleType: Real(53),
        T.FloatType: Real(24), T.TimeType: Time,
    }
    for spark_type, ours in near.items():
        if isinstance(kind, spark_type):
            return ours
    raise ValueError(f"{field.name}: {kind.simpleString()} is no column type")


class Converters:
    """How host values that Spark doesn't know go into columns and come back; users may add their own."""

    def __init__(self) -> None:
        self._to: dict[type, Callable[[Any], Any]] = {uuid.UUID: str}
        self._from: dict[type, Callable[[Any], Any]] = {uuid.UUID: uuid.UUID}

    def register(self, kind: type, to_spark: Callable[[Any], Any], from_spark: Callable[[Any], Any]) -> None:
        self._to[kind], self._from[kind] = to_spark, from_spark

    def to_spark(self, value: Any) -> Any:
        for kind in type(value).__mro__:
            if kind in self._to:
                return self._to[kind](value)
        return value

    def from_spark(self, kind: type, value: Any) -> Any:
        return value if value is None or kind not in self._from else self._from[kind](value)


CONVERTERS = Converters()


def literal(value: Any) -> Column:
    """A value as a column; values never become part of SQL text here."""
    value = CONVERTERS.to_spark(value)
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        return F.lit(decimal.Decimal(value))
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(" ")).cast("timestamp_ntz")
    return F.lit(value)


def sql_text(value: Any) -> str:
    """A value as SQL text, escaped; for chains that hold a raw condition and so are parsed as one text."""
    value = CONVERTERS.to_spark(value)
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, decimal.Decimal):
        return f"{value:f}BD"
    if isinstance(value, int):
        return f"{value}L" if -(2**63) <= value < 2**63 else f"{value}BD"
    if isinstance(value, float):
        return f"{value!r}D" if value == value and abs(value) != float("inf") else f"double('{value}')"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP_NTZ'{value.isoformat(' ')}'"
    if isinstance(value, dt.date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, dt.time):
        return f"TIME'{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + re.sub(r"([\\'])", r"\\\1", value) + "'"
    raise TypeError(f"{type(value).__name__} has no SQL text")


def quoted(name: str) -> str:
    """An identifier in backticks; dots part qualifiers."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))
