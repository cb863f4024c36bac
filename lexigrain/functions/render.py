"""Visible rendering of text: markers for catalogued characters."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.catalogue import character_class, entries
from lexigrain.functions.text import chars, hex4

OPEN, CLOSE = "⟦", "⟧"
SELF_RENDERING = r"^[\x20-\x7e\p{L}\p{N}\p{P}\p{S}\p{Mc}]\z"


@cache
def _names() -> dict[str, list]:
    return {"points": [e.code_point for e in entries()], "names": [e.name for e in entries()]}


def name_of(cp: Column) -> Column:
    """The catalogue's name of a code point, or null: a literal map of 603 entries."""
    n = _names()
    return F.try_element_at(F.map_from_arrays(F.lit(n["points"]).cast("array<bigint>"), F.lit(n["names"])), cp)


def is_self_rendering(c: Column) -> Column:
    return c.rlike(SELF_RENDERING)


def escape_scalar(c: Column, plain: bool = False) -> Column:
    cp = F.ascii(c).cast("long")
    marked = F.concat(F.lit(OPEN + "U+"), hex4(cp), F.lit(" "), name_of(cp), F.lit(CLOSE))
    other = F.concat(F.lit("\\u"), hex4(cp)) if plain else F.concat(F.lit(OPEN + "U+"), hex4(cp), F.lit(CLOSE))
    return F.when(c.rlike(character_class()), marked).when(is_self_rendering(c) & ~c.isin(OPEN, CLOSE), c).otherwise(other)


def context(text: Column, index: Column, radius: int = 12) -> Column:
    """Up to ``radius`` characters on either side, escaped; an ellipsis where text was cut."""
    start = F.greatest(F.lit(0), index.cast("int") - radius)
    window = F.substr(text, start + 1, index.cast("int") + radius + 1 - start)
    shown = F.transform(chars(window), lambda c: F.when(c == "\n", "⏎").when(c == "\t", "⇥").otherwise(escape_scalar(c)))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.array_join(shown, ""), F.when(F.length(text) > index + radius + 1, "…").otherwise(""))


#: Characters that ``visible`` does not show as they are (line feeds, tabs and blanks apart).
UNSEEN = rf"{character_class()}|[^\x20-\x7e\p{{L}}\p{{N}}\p{{P}}\p{{S}}\p{{Mc}}\n\t]|[{OPEN}{CLOSE}]"


def visible(text: Column, show_spaces: bool = True) -> Column:
    """The whole text with white space and hidden characters made visible: it is split at these, the rest stays in one piece."""

    def plain(p: Column) -> Column:
        out = F.replace(F.replace(p, F.lit("\n"), F.lit("⏎\n")), F.lit("\t"), F.lit("→"))
        return F.replace(out, F.lit(" "), F.lit("·")) if show_spaces else out

    shown = F.transform(F.regexp_extract_all(text, F.lit(UNSEEN), F.lit(0)), lambda c: escape_scalar(c))
    between = F.transform(F.split(text, UNSEEN, -1), plain)
    return F.array_join(F.zip_with(between, F.concat(shown, F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
