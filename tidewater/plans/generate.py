"""Record classes written from a schema that was read."""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterable

from tidewater.functions.types import ColumnType
from tidewater.sources.introspect import TableInfo

_PLAIN = {"bigint": "Bigint", "bool": "Bool", "date": "Date", "datetime": "DateTime", "guid": "Guid", "integer": "Integer", "smallint": "Smallint", "time": "Time", "timestamp": "Timestamp", "tinyint": "Tinyint"}
_SIZED = {"binary": "Binary", "char": "Char", "nchar": "NChar", "nvarchar": "NVarchar", "real": "Real", "text": "Text", "varbinary": "VarBinary", "varchar": "Varchar"}


def class_name(table: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"\W|_", table) if p) or "Table"


def member_name(column: str) -> str:
    name = re.sub(r"\W", "_", column)
    return f"{name}_" if keyword.iskeyword(name) or name[:1].isdigit() else name


def _type_text(kind: ColumnType) -> str:
    if kind.name == "decimal":
        return f"types.Decimal({kind.size}, {kind.scale})"
    if kind.name in _PLAIN:
        return f"types.{_PLAIN[kind.name]}"
    return f"types.{_SIZED[kind.name]}({kind.size if kind.size is not None else ''})"


def record_source(tables: Iterable[TableInfo]) -> str:
    """Python text with a record for each table: its fields, what it belongs to, what it has, and through what."""
    tables = list(tables)
    out = ['"""Records of a schema."""', "", "from tidewater.functions import types", "from tidewater.operators.records import AUTO_KEY, KEY, BelongsTo, Field, HasMany, Record, Through", ""]
    for t in tables:
        out += ["", f"class {class_name(t.name)}(Record, table={t.name!r}):"]
        for c in t.columns:
            marks = [_type_text(c.type)] + ["key=KEY"] * (c.name in t.primary_key) + [f"column={c.name!r}"] * (member_name(c.name) != c.name) + ["nullable=False"] * (not c.nullable)
            out.append(f"    {member_name(c.name)} = Field({', '.join(marks)})")
        for k in t.foreign_keys:
            out.append(f"    {member_name('_'.join(k.columns))}_{member_name(k.to_table)} = BelongsTo({class_name(k.to_table)!r}, {k.columns!r})")
        for other in tables:
            for k in other.foreign_keys:
                if k.to_table == t.name and len(k.columns) == 1:
                    out.append(f"    {member_name(other.name)}_by_{member_name(k.columns[0])} = HasMany({class_name(other.name)!r}, {k.columns[0]!r})")
            mine = [k for k in other.foreign_keys if k.to_table == t.name and len(k.columns) == 1]
            for k in mine:
                for far in (f for f in other.foreign_keys if f is not k and len(f.columns) == 1):
                    out.append(f"    {member_name(far.to_table)}_by_{member_name(k.columns[0])}_{member_name(far.columns[0])} = Through({class_name(far.to_table)!r}, {class_name(other.name)!r}, {k.columns[0]!r}, {far.columns[0]!r})")
        out.append("")
    return "\n".join(out)
