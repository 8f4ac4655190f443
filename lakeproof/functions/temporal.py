"""Date and time functions with the semantics of the source dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format letters of the source dialect and their Spark pattern letters.
FORMAT_LETTERS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%j": "DDD",
    "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h", "%i": "mm", "%s": "ss", "%S": "ss",
    "%f": "SSSSSS", "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE",
    "%T": "HH:mm:ss", "%r": "hh:mm:ss a",
}


def spark_pattern(fmt: str) -> str:
    """Translate a %-format; other letters are quoted, as Spark would read them as fields."""


    def translate(found: re.Match) -> str:
        token = found.group()
        if token == "%%":
            return "%"
        if token.startswith("%"):
            if token not in FORMAT_LETTERS:
                raise ValueError(f"format letter {token!r} is not supported")
            return FORMAT_LETTERS[token]
        return "''" if token == "'" else f"'{token}'"

    return re.sub(r"%.|[A-Za-z]+|'", translate, fmt)


def date_trunc(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def date_trunc_date(unit: str, d: Column) -> Column:
    return F.date_trunc(unit, d).cast("date")


def date_add(unit: str, n: int | Column, ts: Column) -> Column:
    return F.timestamp_add(unit.upper(), F.lit(n) if isinstance(n, int) else n, ts)


def date_sub(n: int | Column, d: Column) -> Column:
    return F.date_sub(d, n)


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Whole elapsed units from start to end, not crossed boundaries."""
    return F.timestamp_diff(unit.upper(), start, end)


def date_format(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, spark_pattern(fmt))


def date_parse(text: Column, fmt: str) -> Column:
    """NULL where the text does not fit the format."""
    return F.try_to_timestamp(text, F.lit(spark_pattern(fmt))).cast("timestamp_ntz")


def from_unixtime(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_unixtime(ts: Column) -> Column:
    """Seconds with their fraction, as DOUBLE."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def now() -> Column:
    return F.current_timestamp()


def current_timestamp() -> Column:
    return F.current_timestamp()


def at_timezone(ts: Column, zone: str) -> Column:
    """Wall time in the zone of an instant given in UTC."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def plus_interval(ts: Column, n: int, unit: str) -> Column:
    return ts + F.expr(f"INTERVAL '{int(n)}' {unit}")


def year(ts: Column) -> Column:
    return F.year(ts)


def month(ts: Column) -> Column:
    return F.month(ts)


def day(ts: Column) -> Column:
    return F.dayofmonth(ts)


def hour(ts: Column) -> Column:
    return F.hour(ts)


def minute(ts: Column) -> Column:
    return F.minute(ts)


def second(ts: Column) -> Column:
    return F.second(ts)


def day_of_week(ts: Column) -> Column:
    """Monday is 1."""
    return F.weekday(ts) + 1


def day_of_year(ts: Column) -> Column:
    return F.dayofyear(ts)


def week(ts: Column) -> Column:
    """ISO week."""
    return F.weekofyear(ts)
