"""Column functions on text: white space, metrics, line endings, escapes and hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript has it; Java's \\s is ASCII only.
WIDE_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NARROW_SPACE = r"[ \t\n\r]"
ENDINGS = {"lf": "\n", "crlf": "\r\n", "cr": "\r"}
#: Characters that the plain removal takes out, joiners included.
INVISIBLE = "\u0000\u00a0\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def chars(s: Column) -> Column:
    """Array of the string's characters; empty for the empty string."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def code_point(c: Column) -> Column:
    return F.ascii(c).cast("long")


def hex4(cp: Column) -> Column:
    h = F.hex(cp)
    return F.lpad(h, F.greatest(F.lit(4), F.length(h)), F.lit("0"))


def utf8_hex(c: Column) -> Column:
    """``C2 A0``."""
    return F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)(?!$)", "$1 ")


def wide_trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{WIDE_SPACE}+|{WIDE_SPACE}+\z", "")


def wide_words(s: Column) -> Column:
    t = wide_trim(s)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, f"{WIDE_SPACE}+"))).cast("long")


def narrow_words(s: Column) -> Column:
    return F.size(F.filter(F.split(s, f"{NARROW_SPACE}+"), lambda w: w != "")).cast("long")


def line_count(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))) + 1).cast("long")


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def page_metrics(s: Column) -> Column:
    """Struct of characters (UTF-16), those but white space, words, lines, paragraphs between blank lines."""
    filled = F.size(F.filter(F.split(s, rf"\n{WIDE_SPACE}*\n"), lambda p: wide_trim(p) != ""))
    paragraphs = F.when(filled > 0, filled).when(wide_trim(s) != "", 1).otherwise(0)
    return F.struct(
        utf16_length(s).alias("chars"), utf16_length(F.regexp_replace(s, WIDE_SPACE, "")).alias("chars_no_space"),
        wide_words(s).alias("words"), line_count(s).alias("lines"), paragraphs.cast("long").alias("paragraphs"),
    )


def text_metrics(s: Column) -> Column:
    """Struct of characters, those but ASCII white space, words, lines, paragraphs as runs of filled lines."""
    blank = F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(x, f"^{NARROW_SPACE}+|{NARROW_SPACE}+\\z", "") == "")
    starts = F.size(F.filter(F.transform(blank, lambda b, i: ~b & F.when(i == 0, True).otherwise(F.get(blank, i - 1))), lambda x: x))
    return F.struct(
        F.length(s).cast("long").alias("chars"), F.length(F.translate(s, " \t\n\r", "")).cast("long").alias("chars_no_space"),
        narrow_words(s).alias("words"), line_count(s).alias("lines"), starts.cast("long").alias("paragraphs"),
    )


def metrics_line(m: Column) -> Column:
    return F.format_string("chars:%d words:%d lines:%d paragraphs:%d", m["chars"], m["words"], m["lines"], m["paragraphs"])


# line endings and spaces


def with_endings(s: Column, target: str = "lf") -> Column:
    lf = F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return lf if target == "lf" else F.replace(lf, F.lit("\n"), F.lit(ENDINGS[target]))


def dominant_ending(s: Column) -> Column:
    return F.when(F.regexp_count(s, F.lit("\r\n")) > F.regexp_count(s, F.lit(r"(?<!\r)\n")), "\r\n").otherwise("\n")


def remove_invisibles(s: Column) -> Column:
    return F.translate(s, INVISIBLE, "")


def is_invisible(c: Column) -> Column:
    return c.isin(*INVISIBLE)


def detect_invisibles(s: Column) -> Column:
    return F.transform(F.filter(chars(s), lambda c: c.isin(*INVISIBLE)), lambda c: code_point(c))


def collapse_spaces(s: Column) -> Column:
    return F.regexp_replace(s, " +", " ")


def collapse_blank_lines(s: Column, most: int) -> Column:
    return F.regexp_replace(with_endings(s), f"\n{{{most + 2},}}", "\n" * (most + 1))


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, f"^{NARROW_SPACE}+", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, rf"{NARROW_SPACE}+\z", "")


def ensure_final_newline(s: Column) -> Column:
    """The empty text becomes a newline too."""
    return F.when(F.endswith(s, F.lit("\n")), s).otherwise(F.concat(s, F.lit("\n")))


# escapes


def _replaced(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_html(s: Column) -> Column:
    return _replaced(s, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def escape_js(s: Column) -> Column:
    return _replaced(s, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])


def escape_markdown(s: Column) -> Column:
    marked = F.regexp_replace(s, r"([|\\`*_\[\]<>])", r"\\$1")
    return wide_trim(F.regexp_replace(marked, f"{WIDE_SPACE}+", " "))


def escape_workflow(s: Column) -> Column:
    return _replaced(s, [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")])


# hexadecimal


def encode_byte(v: Column) -> Column:
    return F.lower(F.lpad(F.hex(v), 2, "0"))


def encode_bytes(b: Column) -> Column:
    return F.lower(F.hex(b))


def decode_hex(h: Column) -> Column:
    """Bytes; null for an odd number of digits or another character."""
    return F.when((F.length(h) % 2 == 0) & h.rlike(r"^[0-9A-Fa-f]*\z"), F.unhex(h))


def encode_string(s: Column) -> Column:
    """Low byte of each character, in lower-case hexadecimal."""
    return F.array_join(F.transform(chars(s), lambda c: encode_byte(F.pmod(code_point(c), F.lit(256)))), "")


def decode_string(h: Column) -> Column:
    return F.decode(decode_hex(h), "ISO-8859-1")
