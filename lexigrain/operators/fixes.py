"""Aggressive fixes for form fields and editors: joiners and direction marks go too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.catalogue import EXACT
from lexigrain.operators.scan import find_characters

SPACES = "\u00a0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
GONE = "\u0000\u200b\u200c\u200d\u2060\ufeff\u00ad"
BREAKS = "\u2028\u2029"
#: Exact entries of the basic plane, for the scan in UTF-16 units.
BASIC = frozenset(cp for cp, *_ in EXACT)
LEVELS = {"critical": "Error", "error": "Warning", "warning": "Information", "info": "Hint"}


def field_fixed(text: Column) -> Column:
    return F.translate(text, SPACES + BREAKS + GONE, " " * len(SPACES) + "\n" * len(BREAKS))


def field_fix_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SPACES + BREAKS + GONE, ""))).cast("long")


def replacement(cp: Column) -> Column:
    """What an editor puts in a character's place: a blank, a line feed or nothing."""
    blank = (cp == 0xA0) | cp.between(0x2000, 0x200A) | cp.isin(0x202F, 0x205F, 0x3000)
    return F.when(blank, " ").when(cp.isin(0x2028, 0x2029), "\n").otherwise("")


def editor_diagnostics(df: DataFrame, text: str = "text") -> DataFrame:
    """Exact entries only, positions from 0 in UTF-16 units, with editor levels and replacement."""
    rows = find_characters(df, text).filter(F.col("code_point").isin(*sorted(BASIC)))
    before = F.substring_index(F.substr(F.col(text), F.lit(1), F.col("scalar_index").cast("int")), "\n", -1)
    wide = F.regexp_count(before, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    level = F.lit(None).cast("string")
    for severity, name in LEVELS.items():
        level = F.when(F.col("severity") == severity, name).otherwise(level)
    return rows.withColumns({"line": F.col("line") - 1, "column": F.col("column") - 1 + wide, "level": level, "replacement": replacement(F.col("code_point"))})


def field_status(over_limit: Column, n_artifacts: Column) -> Column:
    return F.when(over_limit, "error").when(n_artifacts > 0, "warning").otherwise("ok")


def checked_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """Fields (with ``max_chars``, null for no limit) with ``n_artifacts`` and ``status``: too long, else with hidden characters, else ok."""
    t = F.coalesce(F.col(text), F.lit(""))
    over = F.coalesce(F.length(t) > F.col("max_chars"), F.lit(False))
    return df.withColumn("n_artifacts", field_fix_count(t)).withColumn("status", field_status(over, F.col("n_artifacts")))


def all_fields_fixed(df: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(fields with ``text`` fixed and ``n_fixed``, (key, n_fields, n_changed, n_fixed) with one more row, of null key, for all)."""
    fixed = df.withColumn("n_fixed", field_fix_count(F.coalesce(F.col(text), F.lit("")))).withColumn(text, field_fixed(F.col(text)))
    sums = fixed.rollup(key).agg(F.count("*").alias("n_fields"), F.count_if(F.col("n_fixed") > 0).alias("n_changed"), F.sum("n_fixed").alias("n_fixed"))
    return fixed, sums


def workspace_of(url: Column) -> Column:
    """Which site a page belongs to, by substrings of its host; the first that fits."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    has = lambda *xs: F.lit(False) if not xs else host.rlike("|".join(x.replace(".", r"\.") for x in xs))
    return (
        F.when(has("twitter.com", "x.com"), "twitter").when(has("linkedin.com"), "linkedin").when(has("github.com"), "github")
        .when(has("jira", "atlassian"), "jira").when(has("mail", "outlook", "gmail"), "email")
    )


def limits(df: DataFrame, workspaces: DataFrame, max_length: Column) -> DataFrame:
    """``workspaces`` (workspace, max_chars) joined on ``workspace``; a field's own maximum wins."""
    return df.join(workspaces, "workspace", "left").withColumn("max_chars", F.coalesce(max_length.cast("long"), "max_chars"))
