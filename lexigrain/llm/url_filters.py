"""URL filters by host-suffix / path-prefix expressions and hash prefixes.

Each URL is expanded into the expressions a rule could have been written as (every
host suffix on a label boundary, with every path prefix of a length that some rule
has). Expressions meet the rules in an equi-join on a short prefix of their SHA-256
digest; the full digests then confirm, and precedence picks one rule.

Defined results: a null URL, an empty one and one without ``://`` have an empty host
and path and match nothing. Repeated rows and ties in ``page_id`` are each judged on
their own. The same rule given twice with both verdicts blocks. Extra columns of the
pages stay; ``host``, ``path``, ``rule`` and ``verdict`` of the input are replaced.
An empty rule table gives every page the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many rows are broadcast (about 20 MB); beyond it the join shuffles.
MAX_BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``; an empty host gives none."""
    labels = F.split(host, r"\.")
    return F.filter(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), ".")), lambda x: x != "")


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.transform(fits, lambda n: F.substring(path, F.lit(1), n))


def match_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``rule_host``, ``rule_path`` (empty or starting with ``/``) and
    ``action`` (allow or block). The longest matching rule wins, counted in characters
    of host and path together.
    """
    keyed = rules.select(F.coalesce("rule_host", F.lit("")).alias("h"), F.coalesce("rule_path", F.lit("")).alias("p"), "action").filter("h <> ''")
    keyed = keyed.groupBy(F.concat("h", "p").alias("rule"), F.length("p").alias("p_len")).agg(F.max("action").alias("action"))  # block > allow
    keyed = keyed.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, prefix_hex))
    # lengths of rule paths: bounded by the longest path a rule may have, not by the rules
    lengths = sorted(r[0] for r in keyed.select("p_len").distinct().collect())
    small = keyed.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES
    side = keyed.select("short", "digest", "rule", "action")
    side = F.broadcast(side) if small else side

    split = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if not lengths:
        return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    expressions = (
        split.select("host", "path").distinct()
        .withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
        .withColumn("prefix", F.explode(path_prefixes(F.col("path"), lengths)))
        .withColumn("own_digest", F.sha2(F.concat("suffix", "prefix"), 256))
        .withColumn("short", F.substring("own_digest", 1, prefix_hex))
        .select("host", "path", "own_digest", "short")
    )
    best = (
        expressions.join(side, "short").filter("own_digest = digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    )
    return split.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
