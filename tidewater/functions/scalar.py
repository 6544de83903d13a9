"""Scalar functions: dates, strings, binary, keys, digests and glob patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def today() -> Column:
    return F.current_date()


def now() -> Column:
    """The present moment without a zone, as the session's zone shows it."""
    return F.localtimestamp()


def now_utc() -> Column:
    return F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def date_parts(moment: Column) -> dict[str, Column]:
    """Year to microsecond of a moment, and its date and time."""
    seconds = F.extract(F.lit("SECOND"), moment)
    return {
        "year": F.year(moment), "month": F.month(moment), "day": F.dayofmonth(moment), "hour": F.hour(moment), "minute": F.minute(moment),
        "second": F.second(moment), "microsecond": F.pmod((seconds * 1_000_000).cast("long"), F.lit(1_000_000)), "date": F.to_date(moment),
    }


def shifted(moment: Column, days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0) -> Column:
    """A moment plus a duration; negative parts go back."""
    return moment + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))


def trimmed(text: Column) -> Column:
    """Text of a fixed width without the blanks that fill it on the right."""
    return F.rtrim(text)


def shortened(text: Column, limit: int, unit: str = "characters") -> Column:
    """At most ``limit`` characters, or as many whole characters as ``limit`` bytes of UTF-8 hold."""
    if unit == "characters":
        return F.substring(text, 1, limit)
    # cut the bytes; a character that the cut halves is dropped from the end
    cut = F.substring(text.cast("binary"), 1, limit)
    whole = F.when(F.octet_length(text) <= limit, text)
    back = F.lit(None).cast("string")
    for less in range(3, -1, -1):
        shorter = F.substring(text.cast("binary"), 1, max(0, limit - less))
        back = F.when(F.is_valid_utf8(shorter.cast("string")), shorter.cast("string")).otherwise(back)
    return F.coalesce(whole, back) if limit > 0 else F.when(text.isNotNull(), F.substring(cut.cast("string"), 1, 0))


def binary(hex_digits: str) -> Column:
    """A binary constant from its hex digits."""
    return F.lit(bytes.fromhex(hex_digits))


def digest(*columns: Column | str) -> Column:
    """SHA-256 of the columns' values as JSON with nulls, so that null and empty differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def sha256(column: Column | str) -> Column:
    return F.sha2(column, 256)


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob of ``*`` and ``?``."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def glob_match(text: Column, glob: str) -> Column:
    return text.rlike(glob_pattern(glob))


def new_guid() -> Column:
    return F.uuid()
