"""Findings: where each catalogued character or stack of combining marks stands in a text.

Positions: ``line`` from 1 (line feeds only), ``column`` from 1 and ``scalar_index`` from 0 in
characters, ``byte_offset`` from 0 in UTF-8. The plan has no shuffle: a text is split at its
matches once, and running sums over the pieces give all positions, in blocks of blocks so that
work follows the number of matches. ``find_characters_dense`` gives the same rows by window
sums over a key; there even one document's pieces are rows that may spill.

Columns that findings add replace those of the input: ``hit``, ``POSITIONS`` and, after the
catalogue's join, ``code_point``, ``utf8_hex``, ``name``, ``unicode_name``, ``category``,
``severity``, ``severity_rank``, ``safety``, ``fix``, ``fix_with`` and ``description``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.catalogue import catalogue, character_class
from lexigrain.functions.text import hex4, utf8_hex

MARK = r"[\p{Mn}\p{Me}]"
#: Pieces whose sums are formed together.
BLOCK = 32
BIDI = ["LRE", "RLE", "PDF", "LRO", "RLO", "LRI", "RLI", "FSI", "PDI", "ALM"]
TAGS = ["LANGUAGE TAG", "CANCEL TAG", "TAG CHARACTER"]
POSITIONS = ["scalar_index", "byte_offset", "line", "column"]


def positions(text: Column, index: Column) -> dict[str, Column]:
    """Position columns of the character at a 0-based index."""
    before = F.substr(text, F.lit(1), index.cast("int"))
    breaks = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return {
        "scalar_index": index.cast("long"),
        "byte_offset": F.octet_length(before).cast("long"),
        "line": (breaks + 1).cast("long"),
        "column": (F.length(F.substring_index(before, "\n", -1)) + 1).cast("long"),
    }


# Expressions as SQL text: there are many small ones, and the parser builds them at once.


def _ahead(a: str, b: str) -> str:
    """How far one piece after another gets: characters, bytes, line feeds, characters since the last of these."""
    sums = ", ".join(f"'{c}', {a}.{c} + {b}.{c}" for c in ("chars", "bytes", "lines"))
    return f"named_struct({sums}, 'tail', if({b}.lines > 0, {b}.tail, {a}.tail + {b}.tail))"


def _extent(s: str) -> str:
    return (
        f"named_struct('chars', bigint(length({s})), 'bytes', bigint(octet_length({s})), 'lines', bigint(length({s}) - length(replace({s}, chr(10), ''))), "
        f"'tail', bigint(length(substring_index({s}, chr(10), -1))))"
    )


def _sum(a: str) -> str:
    return f"aggregate({a}, named_struct('chars', 0L, 'bytes', 0L, 'lines', 0L, 'tail', 0L), (p, q) -> {_ahead('p', 'q')})"


def _numbers(n: str) -> str:
    """0 to n - 1."""
    return f"if({n} > 0, sequence(0, int({n}) - 1), cast(array() as array<int>))"


def _running(df: DataFrame, name: str, depth: int = 2) -> DataFrame:
    """Turns the array of extents ``name`` into the running sums up to and with each.

    Sums within a block of ``BLOCK``, and before each block by the same means ``depth`` times.
    """
    if not depth:
        return df.withColumn(name, F.expr(f"transform({_numbers(f'size({name})')}, j -> {_sum(f'slice({name}, 1, j + 1)')})"))
    blocks, each = f"{name}b", _numbers(f"ceil(size({name}) / {BLOCK})")
    df = df.withColumn(blocks, F.expr(f"transform({each}, k -> {_sum(f'slice({name}, k * {BLOCK} + 1, {BLOCK})')})"))
    df = _running(df, blocks, depth - 1)
    count = _numbers(f"least({BLOCK}, size({name}) - k * {BLOCK})")
    within = f"transform({count}, j -> {_sum(f'slice({name}, k * {BLOCK} + 1, j + 1)')})"
    sums = f"transform({each}, k -> if(k = 0, {within}, transform({within}, x -> {_ahead(f'get({blocks}, k - 1)', 'x')})))"
    return df.withColumn(name, F.expr(f"flatten({sums})")).drop(blocks)


#: A piece: the match before it and the text up to the next one.
PIECES = f"zip_with(concat(array(''), _hits), _parts, (h, p) -> {_extent('concat(h, p)')})"


def matches(df: DataFrame, pattern: str | Column, text: str = "text") -> DataFrame:
    """A row per match with ``hit``, ``hit_no`` and position columns; texts without one are skipped early. A pattern may be a column."""
    t, pattern = F.col(text), F.lit(pattern)
    df = df.drop("hit", "hit_no", *POSITIONS)
    found = df.filter(F.rlike(t, pattern)).withColumns({"_hits": F.regexp_extract_all(t, pattern, F.lit(0)), "_parts": F.split(t, pattern, -1)})
    found = _running(found.withColumn("_at", F.expr(PIECES)).drop("_parts"), "_at")
    rows = found.select(*df.columns, F.posexplode(F.expr("zip_with(_hits, slice(_at, 1, size(_hits)), (h, x) -> named_struct('hit', h, 'x', x))")).alias("hit_no", "m"))
    return rows.select(*df.columns, "hit_no", "m.hit", *(F.expr(x) for x in ("m.x.chars as scalar_index", "m.x.bytes as byte_offset", "m.x.lines + 1 as line", "m.x.tail + 1 as column")))


def any_of(df: DataFrame, patterns: list[tuple], text: str = "text") -> DataFrame:
    """The rows of ``matches`` for several patterns in one pass, each with ``rule``: the number of its pattern, the first member of the tuples in ``patterns``."""
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(p[0]).alias("pattern")) for k, p in enumerate(patterns)])
    one = df.withColumn("_rule", F.explode(F.filter(rules, lambda r: F.rlike(F.col(text), r["pattern"]))))
    return matches(one.withColumns({"rule": F.col("_rule.rule"), "_rule": F.col("_rule.pattern")}), F.col("_rule"), text).drop("_rule", "hit_no")


def matches_dense(df: DataFrame, pattern: str, key: list[str], text: str = "text") -> DataFrame:
    """(key, hit, positions) by running sums per key: rows are short, no text is shuffled."""
    t = F.col(text)
    found = df.filter(t.rlike(pattern)).select(*key, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("_hits"), F.split(t, pattern, -1).alias("_parts"))
    pieces = f"zip_with(concat(array(''), _hits), _parts, (h, p) -> named_struct('before', h, 'e', {_extent('concat(h, p)')}))"
    rows = found.select(*key, F.posexplode(F.expr(pieces)).alias("i", "p")).select(*key, "i", "p.before", "p.e.*")
    w = Window.partitionBy(*key).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "hit": F.lead("before").over(w), "scalar_index": F.sum("chars").over(upto), "byte_offset": F.sum("bytes").over(upto), "line": F.sum("lines").over(upto) + 1,
    })
    # index of the first character after the last line feed so far
    start = F.max(F.when(F.col("lines") > 0, F.col("scalar_index") - F.col("tail"))).over(upto)
    return rows.withColumn("column", F.col("scalar_index") - F.coalesce(start, F.lit(0)) + 1).filter("hit is not null").select(*key, "hit", *POSITIONS)


def with_entries(hits: DataFrame) -> DataFrame:
    """Joins the catalogue (603 rows) to ``hit``."""
    table = catalogue(hits.sparkSession)
    hits = hits.drop(*table.columns, "utf8_hex")
    return hits.withColumn("code_point", F.ascii("hit").cast("long")).withColumn("utf8_hex", utf8_hex(F.col("hit"))).join(F.broadcast(table), "code_point")


def find_characters(df: DataFrame, text: str = "text", exclude: frozenset[int] = frozenset()) -> DataFrame:
    """Catalogue findings; the other columns of ``df`` stay."""
    return with_entries(matches(df, character_class(exclude), text)).drop("hit_no")


def find_characters_dense(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return with_entries(matches_dense(df, character_class(), key, text))


def find_characters_auto(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The findings with no more columns than ``key``; one plan serves texts of few matches and of many."""
    return find_characters(df.select(*key, text), text).drop(text)


def describe_base(base: Column) -> Column:
    return F.when(base == "", "no base character").when(base.rlike(r"^[\x20-\x7e]\z"), F.concat(F.lit('"'), base, F.lit('"'))).otherwise(F.concat(F.lit("U+"), hex4(F.ascii(base).cast("long"))))


def find_stacked_marks(df: DataFrame, text: str = "text", least: int = 4) -> DataFrame:
    """Maximal runs of at least ``least`` combining marks, at their first mark."""
    rows = matches(df, f"{MARK}{{{least},}}", text).drop("hit_no")
    base = F.when(F.col("scalar_index") == 0, "").otherwise(F.substr(F.col(text), F.col("scalar_index").cast("int"), F.lit(1)))
    n = F.length("hit").cast("long")
    first = F.left("hit", F.lit(1))
    lit = F.lit
    return rows.withColumns({
        "code_point": F.ascii("hit").cast("long"), "utf8_hex": utf8_hex(first), "name": lit("ZALGO_RUN"), "unicode_name": lit("SUSPICIOUS COMBINING MARK SEQUENCE"),
        "category": lit("Mn"), "severity": lit("error"), "severity_rank": lit(3), "safety": lit("ambiguous"), "fix": lit("review"), "fix_with": lit(None).cast("string"),
        "description": F.concat(n.cast("string"), lit(" combining marks on one base: "), describe_base(base)),
        "combining_marks": n, "cluster_scalars": n + (base != "").cast("long"),
    })


def find_all(df: DataFrame, text: str = "text", least: int = 4) -> DataFrame:
    """Characters and stacks: two passes, as a mark can be both."""
    return find_characters(df, text).unionByName(find_stacked_marks(df, text, least), allowMissingColumns=True)


def toggled(findings: DataFrame, bidi: bool = True, tags: bool = True, variation_selectors: bool = True) -> DataFrame:
    """Leaves out detector families that are switched off."""
    off = [c for on, c in ((bidi, F.col("name").isin(*BIDI)), (tags, F.col("name").isin(*TAGS)), (variation_selectors, F.col("name").rlike(r"^VS[0-9]+\z"))) if not on]
    return findings.filter(~reduce(lambda a, b: a | b, off)) if off else findings


def overridden(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Applies (code_point, name, severity, fix_action) rows, each code point at most once; ``keep`` makes a finding semantic."""
    o = overrides.select("code_point", F.col("name").alias("_name"), F.col("severity").alias("_severity"), F.col("fix_action").alias("_action"))
    a = F.col("_action")
    ranks = F.when(F.col("_severity") == "critical", 4).when(F.col("_severity") == "error", 3).when(F.col("_severity") == "warning", 2).otherwise(1)
    kind = F.when(a.isin("remove", "keep"), a).when(F.startswith(a, F.lit("replace:")), "replace").otherwise("review")
    given = F.decode(F.unhex(F.lpad(F.substr(a, F.lit(9)), 4, "0")), "UTF-16BE")
    hit = a.isNotNull()
    from_catalogue = findings.join(F.broadcast(catalogue(findings.sparkSession).select("code_point", F.col("safety").alias("_safety"))), "code_point", "left")
    joined = from_catalogue.join(o, "code_point", "left")
    return joined.withColumns({
        "name": F.coalesce("_name", "name"),
        "severity": F.coalesce("_severity", "severity"),
        "severity_rank": F.when(hit, ranks).otherwise(F.col("severity_rank")),
        "safety": F.when(hit & (kind == "keep"), "semantic").when(hit, F.coalesce("_safety", F.lit("ambiguous"))).otherwise(F.col("safety")),
        "fix": F.when(hit, kind).otherwise(F.col("fix")),
        "fix_with": F.when(hit & (kind == "replace"), given).when(hit, F.lit(None)).otherwise(F.col("fix_with")),
        "description": F.when(hit, F.concat("description", F.lit(" (set to "), "_severity", F.lit(", "), a, F.lit(")"))).otherwise(F.col("description")),
    }).drop("_name", "_severity", "_action", "_safety")
