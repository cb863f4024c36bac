"""String, array and path functions with the semantics of the library's scalar surface (0-based, end-exclusive)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# strings


def is_empty(s: Column) -> Column:
    return F.length(s) == 0


def char_at(s: Column, i: int) -> Column:
    """Null outside the string."""
    return F.when(F.lit(i) >= 0, F.nullif(F.substring(s, i + 1, 1), F.lit("")))


def index_of(s: Column, part: str) -> Column:
    """-1 if absent."""
    return (F.locate(part, s) - 1).cast("long")


def substring(s: Column, start: int, end: int) -> Column:
    """Bounds are clamped to the string."""
    a = F.least(F.greatest(F.lit(start), F.lit(0)), F.length(s))
    b = F.least(F.greatest(F.lit(end), a), F.length(s))
    return F.substr(s, a + 1, b - a)


def split(s: Column, delimiter: str) -> Column:
    """Literal delimiter; the empty one gives characters."""
    if delimiter == "":
        return F.filter(F.split(s, ""), lambda c: c != "")
    return F.split(s, r"\Q" + delimiter + r"\E")


def pad_left(s: Column, n: int, c: str) -> Column:
    """Never cuts."""
    return F.lpad(s, F.greatest(F.lit(n), F.length(s)), F.lit(c))


def pad_right(s: Column, n: int, c: str) -> Column:
    return F.rpad(s, F.greatest(F.lit(n), F.length(s)), F.lit(c))


def is_digit(c: Column) -> Column:
    return c.rlike(r"^[0-9]\z")


def is_alpha(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z]\z")


def is_alphanumeric(c: Column) -> Column:
    return is_digit(c) | is_alpha(c)


def is_whitespace(c: Column) -> Column:
    return c.isin(" ", "\t", "\n", "\r")


def parse_int(s: Column) -> Column:
    return s.try_cast("long")


def parse_float(s: Column) -> Column:
    return s.try_cast("double")


def int_to_char(cp: Column) -> Column:
    """The character of a code point (Spark's ``chr`` stops at 255)."""
    low, high = F.lpad(F.hex(cp), 4, "0"), cp - 0x10000
    pair = F.concat(F.hex(F.lit(0xD800) + F.shiftright(high, 10)), F.hex(F.lit(0xDC00) + F.pmod(high, F.lit(0x400))))
    return F.decode(F.unhex(F.when(cp < 0x10000, low).otherwise(pair)), "UTF-16BE")


# arrays


def fold(a: Column, zero: Column, f: Callable) -> Column:
    return F.aggregate(a, zero, f)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1).cast("long"), lambda x, y: x * y)


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(v, low), high)


def span(start: Column, end: Column) -> Column:
    """start, ..., end - 1; empty if there are none."""
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))


# paths


def is_safe(p: Column) -> Column:
    return ~F.startswith(p, F.lit("/")) & ~F.contains(p, F.lit(".."))


def validate_path(p: Column) -> Column:
    """The path, or null if it is not safe."""
    return F.when(is_safe(p), p)


def safe_join(parts: Column) -> Column:
    return F.when(F.forall(parts, is_safe), F.array_join(parts, "/"))


def sanitize_filename(f: Column) -> Column:
    return F.regexp_replace(f, r'[/\\\x00:*?"<>|]', "_")


def is_within(p: Column, base: Column) -> Column:
    return F.startswith(p, base)


def parent(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.+)/[^/]*\z", 1)


def filename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def has_extension(p: Column, ext: str) -> Column:
    return F.endswith(p, F.lit(ext))


def is_excluded(p: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(p, x))
