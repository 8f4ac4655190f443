"""String, pattern, URL and encoding functions with the semantics of the source dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal_pattern(delimiter: str) -> str:
    """Spark splits on a pattern; quote the delimiter so that it is taken as text."""
    return "".join(f"\\{c}" if re.match(r"[^\w\s]", c, re.ASCII) else c for c in delimiter)


def regexp_like(s: Column, pattern: str) -> Column:
    return F.regexp_like(s, F.lit(pattern))


def regexp_extract(s: Column, pattern: str, group: int = 0) -> Column:
    """NULL without a match (Spark's own returns an empty text)."""
    if group == 0:
        return F.regexp_substr(s, F.lit(pattern))
    return F.when(F.regexp_like(s, F.lit(pattern)), F.regexp_extract(s, pattern, group))


def regexp_extract_all(s: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), group)


def regexp_replace(s: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(s, pattern, replacement)


def regexp_count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def codepoint(s: Column) -> Column:
    return F.ascii(s)


def chr(n: Column) -> Column:
    """Any code point; Spark's own is modulo 256. NULL for numbers that are none: negative, surrogates, or beyond U+10FFFF."""
    valid = n.between(0, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def split(s: Column, delimiter: str, limit: int = -1) -> Column:
    """With a limit the last part keeps the rest."""
    return F.split(s, _literal_pattern(delimiter), limit)


def strpos(s: Column, part: str | Column) -> Column:
    return F.instr(s, part)


def position(part: str | Column, s: Column) -> Column:
    return F.position(F.lit(part) if isinstance(part, str) else part, s)


def replace(s: Column, old: str, new: str = "") -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def reverse(s: Column) -> Column:
    return F.reverse(s)


def lpad(s: Column, size: int, fill: str) -> Column:
    return F.lpad(s, size, fill)


def rpad(s: Column, size: int, fill: str) -> Column:
    return F.rpad(s, size, fill)


def concat_pipes(*parts: Column) -> Column:
    return F.concat(*parts)


def from_hex(s: Column) -> Column:
    return F.unhex(s)


def to_hex(b: Column) -> Column:
    return F.hex(b)


def uuid() -> Column:
    return F.uuid()


def url_extract_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def url_extract_path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def url_extract_parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
