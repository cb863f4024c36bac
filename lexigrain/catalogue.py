"""The catalogue of characters that look like nothing: 603 code points with names, severities and repair classes."""

from __future__ import annotations

import unicodedata
from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Entry(NamedTuple):
    code_point: int
    name: str
    unicode_name: str
    category: str
    severity: str
    severity_rank: int
    safety: str
    fix: str  # remove, replace, keep or review
    fix_with: str | None
    description: str


SCHEMA = "code_point long, name string, unicode_name string, category string, severity string, severity_rank int, safety string, fix string, fix_with string, description string"
SEVERITIES = {"info": 1, "warning": 2, "error": 3, "critical": 4}

# Fixed values: (code point, name, severity, safety, fix).
EXACT = [
    (0x0000, "NULL", "critical", "mechanical", "remove"),
    (0x00A0, "NBSP", "error", "mechanical", "space"),
    (0x00AD, "SHY", "info", "ambiguous", "review"),
    (0x034F, "CGJ", "warning", "semantic", "keep"),
    (0x0600, "ARABIC NUMBER SIGN", "info", "semantic", "keep"),
    (0x0601, "ARABIC SIGN SANAH", "info", "semantic", "keep"),
    (0x0602, "ARABIC FOOTNOTE MARKER", "info", "semantic", "keep"),
    (0x0603, "ARABIC SIGN SAFHA", "info", "semantic", "keep"),
    (0x0604, "ARABIC SIGN SAMVAT", "info", "semantic", "keep"),
    (0x0605, "ARABIC NUMBER MARK ABOVE", "info", "semantic", "keep"),
    (0x061C, "ALM", "info", "semantic", "keep"),
    (0x06DD, "ARABIC END OF AYAH", "info", "semantic", "keep"),
    (0x070F, "SAM", "warning", "semantic", "keep"),
    (0x0890, "ARABIC POUND MARK ABOVE", "info", "semantic", "keep"),
    (0x0891, "ARABIC PIASTRE MARK ABOVE", "info", "semantic", "keep"),
    (0x08E2, "ARABIC DISPUTED END OF AYAH", "info", "semantic", "keep"),
    (0x115F, "HANGUL CHOSEONG FILLER", "info", "ambiguous", "review"),
    (0x1160, "HANGUL JUNGSEONG FILLER", "info", "ambiguous", "review"),
    (0x1680, "OGHAM SPACE", "info", "ambiguous", "space"),
    (0x180E, "MVS", "warning", "semantic", "keep"),
    (0x2000, "EN QUAD", "info", "ambiguous", "space"),
    (0x2001, "EM QUAD", "info", "ambiguous", "space"),
    (0x2002, "EN SPACE", "info", "ambiguous", "space"),
    (0x2003, "EM SPACE", "info", "ambiguous", "space"),
    (0x2004, "THREE-PER-EM SPACE", "info", "ambiguous", "space"),
    (0x2005, "FOUR-PER-EM SPACE", "info", "ambiguous", "space"),
    (0x2006, "SIX-PER-EM SPACE", "info", "ambiguous", "space"),
    (0x2007, "FIGURE SPACE", "info", "ambiguous", "space"),
    (0x2008, "PUNCTUATION SPACE", "info", "ambiguous", "space"),
    (0x2009, "THIN SPACE", "info", "ambiguous", "space"),
    (0x200A, "HAIR SPACE", "info", "ambiguous", "space"),
    (0x200B, "ZWSP", "error", "mechanical", "remove"),
    (0x200C, "ZWNJ", "warning", "semantic", "keep"),
    (0x200D, "ZWJ", "warning", "semantic", "keep"),
    (0x200E, "LRM", "info", "ambiguous", "review"),
    (0x200F, "RLM", "info", "ambiguous", "review"),
    (0x2028, "LS", "warning", "mechanical", "newline"),
    (0x2029, "PS", "warning", "mechanical", "newline"),
    (0x202A, "LRE", "error", "ambiguous", "review"),
    (0x202B, "RLE", "error", "ambiguous", "review"),
    (0x202C, "PDF", "error", "ambiguous", "review"),
    (0x202D, "LRO", "critical", "ambiguous", "review"),
    (0x202E, "RLO", "critical", "ambiguous", "review"),
    (0x202F, "NNBSP", "info", "ambiguous", "space"),
    (0x205F, "MMSP", "info", "ambiguous", "space"),
    (0x2060, "WJ", "info", "ambiguous", "review"),
    (0x2061, "FUNCTION APPLICATION", "warning", "semantic", "keep"),
    (0x2062, "INVISIBLE TIMES", "warning", "semantic", "keep"),
    (0x2063, "INVISIBLE SEPARATOR", "warning", "semantic", "keep"),
    (0x2064, "INVISIBLE PLUS", "warning", "semantic", "keep"),
    (0x2066, "LRI", "error", "ambiguous", "review"),
    (0x2067, "RLI", "error", "ambiguous", "review"),
    (0x2068, "FSI", "error", "ambiguous", "review"),
    (0x2069, "PDI", "error", "ambiguous", "review"),
    (0x206A, "ISS", "warning", "mechanical", "remove"),
    (0x206B, "ASS", "warning", "mechanical", "remove"),
    (0x206C, "IAFS", "warning", "mechanical", "remove"),
    (0x206D, "AAFS", "warning", "mechanical", "remove"),
    (0x206E, "NADS", "warning", "mechanical", "remove"),
    (0x206F, "NODS", "warning", "mechanical", "remove"),
    (0x2800, "BRAILLE BLANK", "info", "ambiguous", "review"),
    (0x3000, "IDEOGRAPHIC SPACE", "info", "ambiguous", "space"),
    (0x3164, "HANGUL FILLER", "warning", "ambiguous", "review"),
    (0xFEFF, "BOM", "warning", "mechanical", "remove"),
    (0xFFA0, "HALFWIDTH HANGUL FILLER", "warning", "ambiguous", "review"),
    (0xFFF9, "IAA", "warning", "semantic", "keep"),
    (0xFFFA, "IAS", "warning", "semantic", "keep"),
    (0xFFFB, "IAT", "warning", "semantic", "keep"),
    (0xFFFC, "ORC", "warning", "ambiguous", "review"),
    (0xFFFD, "REPLACEMENT CHAR", "error", "ambiguous", "review"),
    (0xFFFE, "REVERSED BOM", "critical", "mechanical", "remove"),
]
# Abbreviations of the control characters 0x00-0x1F and 0x80-0x9F.
C0 = "NUL SOH STX ETX EOT ENQ ACK BEL BS HT LF VT FF CR SO SI DLE DC1 DC2 DC3 DC4 NAK SYN ETB CAN EM SUB ESC FS GS RS US".split()
C1 = "PAD HOP BPH NBH IND NEL SSA ESA HTS HTJ VTS PLD PLU RI SS2 SS3 DCS PU1 PU2 STS CCH MW SPA EPA SOS SGCI SCI CSI ST OSC PM APC".split()
DIGITS = "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE".split()
# Unicode names and categories where Python's database has none or another.
UNICODE_NAMES = {0x0000: "NULL", 0xFEFF: "ZERO WIDTH NO-BREAK SPACE", 0xFFFE: "<noncharacter-FFFE>"}
REPLACEMENTS = {"space": " ", "newline": "\n"}
WHY = {
    "remove": "carries no meaning in text and can go",
    "replace": "stands for ordinary white space",
    "keep": "means something in its script or notation",
    "review": "needs a person to decide",
}


def hex4(cp: int) -> str:
    """Upper-case hexadecimal of at least four digits."""
    return f"{cp:04X}"


def _entry(cp: int, name: str, unicode_name: str, category: str, severity: str, safety: str, fix: str) -> Entry:
    kind = "replace" if fix in REPLACEMENTS else fix
    return Entry(cp, name, unicode_name, category, severity, SEVERITIES[severity], safety, kind, REPLACEMENTS.get(fix), f"{unicode_name}: {WHY[kind]}")


def _tag_name(cp: int) -> str:
    c = cp - 0xE0000
    if 0x30 <= c <= 0x39:
        return f"DIGIT {DIGITS[c - 0x30]}"
    if 0x41 <= c <= 0x5A:
        return f"LATIN CAPITAL LETTER {chr(c)}"
    if 0x61 <= c <= 0x7A:
        return f"LATIN SMALL LETTER {chr(c).upper()}"
    return f"U+{hex4(cp)}"


def _ranges() -> list[Entry]:
    """The rows that rules make, in their order."""
    out = [_entry(c, "C0_CONTROL", f"<control-{C0[c]}>", "Cc", "critical", "mechanical", "review") for c in range(1, 32) if c not in (9, 10, 13)]
    out.append(_entry(0x7F, "DELETE", "<control-DELETE>", "Cc", "critical", "mechanical", "review"))
    out += [_entry(0x80 + i, f"C1_{n}", f"<control-{n}>", "Cc", "warning" if n == "NEL" else "error", "mechanical", "review") for i, n in enumerate(C1)]
    out.append(_entry(0xE0001, "LANGUAGE TAG", "LANGUAGE TAG", "Cf", "warning", "ambiguous", "review"))
    out.append(_entry(0xE007F, "CANCEL TAG", "CANCEL TAG", "Cf", "error", "ambiguous", "review"))
    out += [_entry(c, "TAG CHARACTER", f"TAG {_tag_name(c)}", "Cf", "error", "ambiguous", "review") for c in range(0xE0002, 0xE007F)]
    selectors = [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
    out += [_entry(c, f"VS{i}", f"VARIATION SELECTOR-{i}", "Mn", "warning", "semantic", "keep") for i, c in enumerate(selectors, 1)]
    for name, label, cps in (
        ("SHORTHAND FORMAT", "SHORTHAND FORMAT LETTER CONTROL", range(0x1BCA0, 0x1BCA4)),
        ("MUSICAL FORMAT", "MUSICAL SYMBOL CONTROL", range(0x1D173, 0x1D17B)),
        ("EGYPTIAN FORMAT", "EGYPTIAN HIEROGLYPH FORMAT CONTROL", range(0x13430, 0x13439)),
    ):
        out += [_entry(c, name, f"{label} U+{hex4(c)}", "Cn", "info", "semantic", "keep") for c in cps]
    out += [_entry(c, "KAITHI NUMBER SIGN", n, "Cn", "warning", "ambiguous", "review") for c, n in ((0x110BD, "KAITHI NUMBER SIGN"), (0x110CD, "KAITHI NUMBER SIGN ABOVE"))]
    reserved = [*range(0xFDD0, 0xFDF0), *(p << 16 | low for p in range(17) for low in (0xFFFE, 0xFFFF))]
    out += [_entry(c, "NONCHARACTER", f"<noncharacter-{hex4(c)}>", "Cf" if c >= 0xF0000 else "Cn", "error", "ambiguous", "review") for c in reserved if c != 0xFFFE]
    return out


@cache
def entries() -> tuple[Entry, ...]:
    exact = [_entry(cp, name, UNICODE_NAMES.get(cp) or unicodedata.name(chr(cp)), unicodedata.category(chr(cp)), severity, safety, fix) for cp, name, severity, safety, fix in EXACT]
    return tuple(sorted(exact + _ranges()))


def catalogue(spark: SparkSession) -> DataFrame:
    """All entries as a table: 603 rows, always small enough to broadcast."""
    return spark.createDataFrame([tuple(e) for e in entries()], SCHEMA)


def character_class(exclude: frozenset[int] = frozenset()) -> str:
    """A Java regular-expression class of the catalogue's characters, ranges merged.

    Java tries range after range, so those beyond the Latin letters stand behind one range around them, in groups that do so
    again: most characters of a text are then told by a few comparisons.
    """
    cps = [e.code_point for e in entries() if e.code_point not in exclude]
    runs: list[list[int]] = []
    for c in cps:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    members = lambda g: "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in g)
    around = lambda g, inner: rf"[\x{{{g[0][0]:X}}}-\x{{{g[-1][1]:X}}}&&[{inner}]]" if g else ""
    low, high = ([r for r in runs if (r[1] < 0x300) == side] for side in (True, False))
    return f"[{members(low)}{around(high, ''.join(around(g, members(g)) for g in (high[k : k + 8] for k in range(0, len(high), 8))))}]"


def duckdb_values() -> str:
    """The table as SQL VALUES, for oracles."""

    def lit(x: object) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else "chr(10)" if x == "\n" else "'" + str(x).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(lit, e)) + ")" for e in entries())
