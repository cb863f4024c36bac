"""White-space profiles: ordered steps on lines, with an account of what changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions import text as T


@dataclass(frozen=True)
class Profile:
    normalize_line_endings: bool = True
    target_line_ending: str = "lf"
    trim_lines: bool = True
    collapse_spaces: bool = True
    max_blank_lines: int | None = 2
    trim_document: bool = True
    ensure_final_newline: bool = True


PROFILES = {
    "default": Profile(),
    "strict": Profile(max_blank_lines=1),
    "minimal": Profile(trim_lines=False, collapse_spaces=False, max_blank_lines=100, trim_document=False),
}


def profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"no profile named {name!r}; there are {', '.join(PROFILES)}")
    return PROFILES[name]


def _blank(line: Column) -> Column:
    return T.wide_trim(line) == ""


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _cap(lines: Column, most: int) -> Column:
    """At most so many blank lines in a row: the blank lines whose ``most`` predecessors are all blank go."""

    def with_blank(blank: Column) -> Column:
        over = lambda i: F.get(blank, i) & (i >= most) & F.forall(F.slice(blank, F.greatest(i - most, F.lit(0)) + 1, F.lit(most)), lambda b: b)
        return F.filter(lines, lambda _, i: ~over(i))

    return _let(F.transform(lines, _blank), with_blank)


def _inner(lines: Column) -> Column:
    """Without blank lines at either end."""

    def with_filled(filled: Column) -> Column:
        first = F.array_position(filled, F.lit(True)).cast("int")
        last = (F.size(lines) + 1 - F.array_position(F.reverse(filled), F.lit(True))).cast("int")
        return F.when(first > 0, F.slice(lines, first, last - first + 1)).otherwise(F.array().cast("array<string>"))

    return _let(F.transform(lines, lambda x: ~_blank(x)), with_filled)


def _change(kind: str, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))


def _step(kind: str, new: Callable, count: Callable) -> Callable[[Column], Column]:
    """One step on a state of (lines, changes)."""

    def run(s: Column) -> Column:
        def counted(ls: Column) -> Column:
            n = count(s["lines"], ls)
            return F.struct(ls.alias("lines"), F.concat(s["changes"], F.array(_change(kind, F.when(n > 0, n.cast("string"))))).alias("changes"))

        return _let(new(s["lines"]), counted)

    return run


def applied(text: Column, p: Profile) -> Column:
    """Struct of ``text`` and ``changes``: array of (kind, detail) for the steps that changed something."""
    differ = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))
    fewer = lambda a, b: F.size(a) - F.size(b)
    tidy = lambda x: F.concat(F.regexp_extract(x, "^[ \t]*", 0), F.regexp_replace(F.regexp_replace(x, "^[ \t]*", ""), " {2,}", " "))
    steps: list[tuple[str, Callable, Callable]] = []
    if p.trim_lines:
        steps.append(("trim_lines", lambda ls: F.transform(ls, lambda x: F.regexp_replace(x, r"[ \t]+\z", "")), differ))
    if p.collapse_spaces:
        steps.append(("collapse_spaces", lambda ls: F.transform(ls, tidy), differ))
    if p.max_blank_lines is not None:
        steps.append(("max_blank_lines", lambda ls: _cap(ls, p.max_blank_lines), fewer))
    if p.trim_document:
        steps.append(("trim_document", _inner, fewer))

    def of_lines(start: Column, eol: Column) -> Column:
        first = F.when(start != text, p.target_line_ending) if p.normalize_line_endings else F.lit(None).cast("string")
        split = F.when(eol == "\r\n", F.split(start, "\r\n")).when(eol == "\r", F.split(start, "\r")).otherwise(F.split(start, "\n"))
        state = F.struct(split.alias("lines"), F.array(_change("normalize_line_endings", first)).alias("changes"))
        for step in steps:
            state = _let(state, _step(*step))

        def joined(s: Column) -> Column:
            def finished(out: Column) -> Column:
                missing = (F.length(out) > 0) & ~F.endswith(out, eol) if p.ensure_final_newline else F.lit(False)
                changes = F.concat(s["changes"], F.array(_change("ensure_final_newline", F.when(missing, "true"))))
                return F.struct(F.when(missing, F.concat(out, eol)).otherwise(out).alias("text"), F.filter(changes, lambda c: c["detail"].isNotNull()).alias("changes"))

            together = F.when(eol == "\r\n", F.array_join(s["lines"], "\r\n")).when(eol == "\r", F.array_join(s["lines"], "\r")).otherwise(F.array_join(s["lines"], "\n"))
            return _let(together, finished)

        return _let(state, joined)

    if p.normalize_line_endings:
        return _let(T.with_endings(text, p.target_line_ending), lambda start: of_lines(start, F.lit(T.ENDINGS[p.target_line_ending])))
    return _let(T.dominant_ending(text), lambda eol: of_lines(text, eol))


@dataclass(frozen=True)
class LegacyOptions:
    remove_invisibles: bool = True
    collapse_spaces: bool = False
    max_blank_lines: int | None = 2
    trim_lines: bool = True
    trim_document: bool = True
    ensure_final_newline: bool = True


def legacy(text: Column, o: LegacyOptions = LegacyOptions()) -> Column:
    """The older chain: invisibles, spaces, blank lines, lines on both sides, document, final newline."""
    s = T.remove_invisibles(text) if o.remove_invisibles else text
    s = T.collapse_spaces(s) if o.collapse_spaces else s
    s = T.collapse_blank_lines(s, o.max_blank_lines) if o.max_blank_lines is not None else s
    both = lambda x: T.trim_end(T.trim_start(x))
    s = F.array_join(F.transform(F.split(s, "\n"), both), "\n") if o.trim_lines else s
    s = both(s) if o.trim_document else s
    s = T.with_endings(s)
    return T.ensure_final_newline(s) if o.ensure_final_newline else s


def constraint_violations(text: Column, workspace: Column, max_chars: Column, max_words: Column, max_lines: Column) -> Column:
    """Array of policy findings for the limits that are not null."""
    actual = {"chars": (F.length(text).cast("long"), max_chars), "words": (T.wide_words(text), max_words), "lines": (T.line_count(text), max_lines)}
    rows = [
        F.struct(
            F.lit(f"CONSTRAINT_{k.upper()}").alias("name"), F.lit("warning").alias("severity"), F.lit("semantic").alias("safety"), F.lit("keep").alias("fix"),
            n.alias("actual"), most.cast("long").alias("maximum"), F.concat(workspace, F.lit(f": {k} "), n.cast("string"), F.lit(" exceeds maximum "), most.cast("string")).alias("description"),
        )
        for k, (n, most) in actual.items()
    ]
    return F.filter(F.array(*rows), lambda r: r["actual"] > r["maximum"])


def legacy_violations(metrics: Column, max_chars: int | None = None, max_words: int | None = None, max_lines: int | None = None, max_bytes: int | None = None) -> Column:
    """Messages of the older check; its byte limit compares characters."""
    rows = []
    for label, field, most in (("characters", "chars", max_chars), ("words", "words", max_words), ("lines", "lines", max_lines), ("bytes", "chars", max_bytes)):
        if most is not None:
            rows.append(F.when(metrics[field] > most, F.concat(F.lit(f"Too many {label}: "), metrics[field].cast("string"), F.lit(f" > {most}"))))
    return F.array_compact(F.array(*rows)) if rows else F.array().cast("array<string>")
