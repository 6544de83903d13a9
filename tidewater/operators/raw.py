"""SQL text with positional parameters."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewater.functions.types import CONVERTERS

# what may hold a question mark that is no parameter
_SKIPPED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)


def parameters_in(text: str) -> int:
    """How many ``?`` of a text are parameters."""
    return _SKIPPED.sub("", text).count("?")


def run_sql(spark: SparkSession, text: str, *args: Any) -> DataFrame:
    """Run SQL with one argument for each ``?``; too few and too many are errors."""
    if (n := parameters_in(text)) != len(args):
        raise ValueError(f"{n} parameters, {len(args)} arguments")
    return spark.sql(text, args=[CONVERTERS.to_spark(a) for a in args]) if args else spark.sql(text)


def scalar(spark: SparkSession, text: str, *args: Any) -> Any:
    """The first column of the first row, None without rows."""
    row = run_sql(spark, text, *args).first()
    return None if row is None else row[0]


def shaped(frame: DataFrame, *names: str) -> DataFrame:
    """A result whose columns are renamed by place."""
    if len(names) != len(frame.columns):
        raise ValueError(f"{len(frame.columns)} columns, {len(names)} names")
    return frame.toDF(*names)
