"""Registered queries outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.catalogue import catalogue, duckdb_values
from lexigrain.functions import render, strings
from lexigrain.functions import text as T
from lexigrain.llm.shared import written
from lexigrain.operators import fixes, legacy, office, regions, repair, report, scan, styles, transform
from lexigrain.plans.applying import RepairStore
from lexigrain.plans.audit import audit
from lexigrain.plans.files import scan_files
from lexigrain.plans.planting import DEEP_SQL, PLANTED_SQL, SPACED_SQL, STYLED_SQL, deep, packed, planted, planted_text, spaced, styled
from lexigrain.plans.settings import Settings
from lexigrain.plans.validation import validated
from lexigrain.sources.log import BatchLog, shared_folder
from lexigrain.sources.walk import path_order
from lexigrain.streaming import diagnostics, quiet

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Oracle pieces: every character with its position, the catalogue, catalogue findings, runs of marks.
CH = """ch AS (
  SELECT doc_id, i, t[i] AS c FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM planted)
), pos AS (
  SELECT doc_id, c, i - 1 AS scalar_index, (sum(strlen(c)) OVER w - strlen(c))::BIGINT AS byte_offset,
    1 + (count(*) FILTER (c = chr(10)) OVER b) AS line, i - coalesce(max(CASE WHEN c = chr(10) THEN i END) OVER b, 0) AS "column"
  FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
CAT = f"cat(code_point, name, unicode_name, category, severity, severity_rank, safety, fix, fix_with, description) AS (VALUES {duckdb_values()})"
FOUND = "f AS (SELECT pos.*, cat.* FROM pos JOIN cat ON unicode(c) = code_point)"
MARKS = r"""m AS (
  SELECT *, scalar_index - row_number() OVER (PARTITION BY doc_id ORDER BY scalar_index) AS run FROM pos WHERE regexp_full_match(c, '[\p{Mn}\p{Me}]')
), z AS (
  SELECT doc_id, min(scalar_index) AS scalar_index, arg_min(byte_offset, scalar_index) AS byte_offset, arg_min(line, scalar_index) AS line, arg_min("column", scalar_index) AS "column",
    unicode(arg_min(c, scalar_index))::BIGINT AS code_point, count(*) AS combining_marks
  FROM m GROUP BY doc_id, run HAVING count(*) >= 4
)"""
SCAN = f"WITH {PLANTED_SQL}, {CH}, {CAT}, {FOUND}"
ALL = f"{SCAN}, {MARKS}, a AS (SELECT doc_id, name, severity, severity_rank, safety FROM f UNION ALL SELECT doc_id, 'ZALGO_RUN', 'error', 3, 'ambiguous' FROM z)"
PLACES = 'doc_id, code_point::BIGINT AS code_point, scalar_index, byte_offset, line, "column"'
COLUMNS = ["doc_id", "code_point", "scalar_index", "byte_offset", "line", "column"]


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.find_characters(planted(documents(spark, sf_dir)))


def found_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.find_all(planted(documents(spark, sf_dir)))


# scanning


@query(f"{SCAN} SELECT name, severity, count(*) AS n FROM f GROUP BY ALL")
def findings_by_name(spark, sf_dir):
    return report.by_name(found(spark, sf_dir))


@query(f"{SCAN} SELECT {PLACES}, name, unicode_name, category, severity, severity_rank, safety, fix, fix_with, rtrim(regexp_replace(hex(encode(c)), '(..)', '\\1 ', 'g')) AS utf8_hex FROM f")
def findings_sparse(spark, sf_dir):
    return found(spark, sf_dir).select(*COLUMNS, "name", "unicode_name", "category", "severity", "severity_rank", "safety", "fix", "fix_with", "utf8_hex")


@query(f"{SCAN} SELECT {PLACES} FROM f")
def findings_dense(spark, sf_dir):
    return scan.find_characters_dense(planted(documents(spark, sf_dir)), ["doc_id"]).select(*COLUMNS)


@query(f"{SCAN} SELECT {PLACES} FROM f")
def findings_auto(spark, sf_dir):
    return scan.find_characters_auto(planted(documents(spark, sf_dir)), ["doc_id"]).select(*COLUMNS)


DEEP_PLACES = 'count(*) AS n, sum(code_point)::BIGINT AS code_points, sum(scalar_index)::BIGINT AS scalars, sum(byte_offset)::BIGINT AS bytes, max(line)::BIGINT AS last_line, sum("column")::BIGINT AS columns'


def _places(found_):
    sums = [F.sum(c).cast("long").alias(name) for c, name in (("code_point", "code_points"), ("scalar_index", "scalars"), ("byte_offset", "bytes"), ("column", "columns"))]
    return found_.groupBy("doc_id").agg(F.count("*").alias("n"), *sums, F.max("line").cast("long").alias("last_line"))


@query(f'WITH {DEEP_SQL}, {CH}, {CAT}, {FOUND}, {MARKS} SELECT doc_id, {DEEP_PLACES} FROM (SELECT {PLACES} FROM f UNION ALL SELECT {PLACES} FROM z) GROUP BY doc_id')
def findings_deep(spark, sf_dir):
    """Places of findings all through long texts and at their ends."""
    return _places(scan.find_all(deep(documents(spark, sf_dir))))


@query(f"WITH {DEEP_SQL}, {CH}, {CAT}, {FOUND} SELECT doc_id, {DEEP_PLACES} FROM f GROUP BY doc_id")
def findings_dense_deep(spark, sf_dir):
    """The same for characters by the dense plan, where one document in seven is dense."""
    return _places(scan.find_characters_dense(deep(documents(spark, sf_dir)), ["doc_id"]))


@query(f"{SCAN}, {MARKS} SELECT {PLACES}, combining_marks, combining_marks + (scalar_index > 0)::BIGINT AS cluster_scalars FROM z")
def stacked_marks(spark, sf_dir):
    return scan.find_stacked_marks(planted(documents(spark, sf_dir))).select(*COLUMNS, "combining_marks", "cluster_scalars")


@query(f"{ALL} SELECT name, count(*) AS n FROM a WHERE name NOT IN ('LRE', 'RLE', 'PDF', 'LRO', 'RLO', 'LRI', 'RLI', 'FSI', 'PDI', 'ALM', 'LANGUAGE TAG', 'CANCEL TAG', 'TAG CHARACTER') AND NOT regexp_full_match(name, 'VS[0-9]+') GROUP BY name")
def toggles_off(spark, sf_dir):
    return scan.toggled(found_all(spark, sf_dir), bidi=False, tags=False, variation_selectors=False).groupBy("name").agg(F.count("*").alias("n"))


@query(f"""{SCAN} SELECT n.name, n.severity, n.safety, n.fix, n.fix_with, count(*) AS n FROM (
  SELECT CASE code_point WHEN 173 THEN 'SOFT' WHEN 8205 THEN 'JOINER' WHEN 160 THEN 'HARD' ELSE name END AS name,
    CASE code_point WHEN 173 THEN 'warning' WHEN 8205 THEN 'info' WHEN 160 THEN 'critical' ELSE severity END AS severity,
    safety, CASE code_point WHEN 173 THEN 'remove' WHEN 8205 THEN 'keep' WHEN 160 THEN 'replace' ELSE fix END AS fix,
    CASE code_point WHEN 173 THEN NULL WHEN 8205 THEN NULL WHEN 160 THEN '_' ELSE fix_with END AS fix_with FROM f) n GROUP BY ALL""")
def overrides(spark, sf_dir):
    rows = [(0xAD, "SOFT", "warning", "remove"), (0x200D, "JOINER", "info", "keep"), (0xA0, "HARD", "critical", "replace:5F")]
    table_ = spark.createDataFrame(rows, "code_point long, name string, severity string, fix_action string")
    return scan.overridden(found(spark, sf_dir), table_).groupBy("name", "severity", "safety", "fix", "fix_with").agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(coalesce(text, ''))::BIGINT AS scanned_scalars, sha256(coalesce(text, '')) AS sha256 FROM documents")
def scanned_scalars(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return documents(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("scanned_scalars"), repair.sha256_of(t).alias("sha256"))


# reports


@query(f"{ALL} SELECT severity, count(*) AS n FROM a WHERE severity_rank >= 3 GROUP BY severity")
def at_or_above_error(spark, sf_dir):
    return report.at_or_above(found_all(spark, sf_dir), "error").groupBy("severity").agg(F.count("*").alias("n"))


@query(f"{ALL} SELECT severity, count(*) AS n FROM a GROUP BY ROLLUP (severity)")
def by_severity(spark, sf_dir):
    return report.by_severity(found_all(spark, sf_dir))


@query(f"{ALL} SELECT doc_id, count(*) AS n FROM a GROUP BY ROLLUP (doc_id)")
def by_document(spark, sf_dir):
    return report.by_document(found_all(spark, sf_dir), "doc_id")


@query(f"""{ALL} SELECT (SELECT count(*) FROM planted) AS n_documents, (SELECT count(*) FROM a) AS n_findings, (SELECT count(*) FROM a WHERE severity_rank >= 4) AS n_blocking,
  (SELECT count(DISTINCT doc_id) FROM a) AS n_with_findings, 0::BIGINT AS n_errors, (CASE WHEN (SELECT count(*) FROM a WHERE severity_rank >= 4) > 0 THEN 1 ELSE 0 END)::BIGINT AS status""")
def audit_summary(spark, sf_dir):
    return audit(planted(documents(spark, sf_dir)), "doc_id").summary


HEX = "CASE WHEN length(hex(code_point)) < 4 THEN lpad(hex(code_point), 4, '0') ELSE hex(code_point) END"


@query(f"""{SCAN} SELECT doc_id, scalar_index,
  doc_id || ':' || line || ':' || "column" || ': ' || upper(severity) || ' ' || name || ' U+' || {HEX} || ' [' || rtrim(regexp_replace(hex(encode(c)), '(..)', '\\1 ', 'g')) || '] (' || safety || ')' AS line,
  '0x' || {HEX} || ' [' || name || '] ' || doc_id || ' L:' || line || ' C:' || "column" || ' B:' || byte_offset AS hex_line,
  '::' || CASE WHEN severity_rank >= 4 THEN 'error' ELSE 'warning' END || ' file=' || doc_id || ',line=' || line || ',col=' || "column" || '::' || name || ' U+' || {HEX} || ' (' || severity || ')' AS annotation,
  doc_id || ':' || line || ':' || "column" || ': ' || CASE WHEN severity_rank >= 4 THEN 'error' ELSE 'warning' END || ': ' || name || ' U+' || {HEX} || ' (' || severity || ')' AS plain
  FROM f""")
def finding_lines(spark, sf_dir):
    path, blocking = F.col("doc_id").cast("string"), F.col("severity_rank") >= 4
    return found(spark, sf_dir).select("doc_id", "scalar_index", report.finding_line(path).alias("line"), report.hex_line(path).alias("hex_line"), report.annotation(path, blocking).alias("annotation"), report.plain_annotation(path, blocking).alias("plain"))


@query(f"""{SCAN} SELECT doc_id, string_agg(doc_id || ':' || line || ':' || "column" || ': ' || upper(severity) || ' ' || name || ' U+' || {HEX} || ' [' || rtrim(regexp_replace(hex(encode(c)), '(..)', '\\1 ', 'g')) || '] (' || safety || ')', chr(10) ORDER BY byte_offset) AS report FROM f GROUP BY doc_id""")
def text_reports(spark, sf_dir):
    return report.text_report(found(spark, sf_dir), "doc_id")


@query(f"{SCAN} SELECT doc_id, length(t)::BIGINT AS scanned_scalars, coalesce(n, 0) AS finding_count, coalesce(s, '') AS names FROM planted LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY byte_offset) AS s FROM f GROUP BY doc_id) USING (doc_id)")
def diagnostic_records(spark, sf_dir):
    docs = planted(documents(spark, sf_dir))
    r = report.records(docs, scan.find_characters(docs), "doc_id")
    return r.select("doc_id", "scanned_scalars", "finding_count", F.array_join(F.transform("findings", lambda x: x["name"]), ",").alias("names"))


@query(f"{SCAN} SELECT doc_id, name, byte_offset FROM f WHERE severity_rank >= 3 AND contains(lower(name), 'sp') ORDER BY doc_id, byte_offset LIMIT 30 OFFSET 10")
def findings_page(spark, sf_dir):
    """A screen of findings: the limit is the feature."""
    return report.page(found(spark, sf_dir), "doc_id", "error", "SP", offset=10, rows=30).select("doc_id", "name", "byte_offset")


@query()
def markdown_reports(spark, sf_dir):
    docs = planted(documents(spark, sf_dir))
    return report.markdown(report.records(docs, scan.find_characters(docs), "doc_id"), "doc_id")


# rendering

SHOWN = rf"""CASE WHEN name IS NOT NULL THEN '⟦U+' || CASE WHEN length(hex(code_point)) < 4 THEN lpad(hex(code_point), 4, '0') ELSE hex(code_point) END || ' ' || name || '⟧'
  WHEN regexp_full_match(c, '[\x20-\x7e\p{{L}}\p{{N}}\p{{P}}\p{{S}}\p{{Mc}}]') AND c NOT IN ('⟦', '⟧') THEN c
  ELSE '⟦U+' || CASE WHEN length(hex(unicode(c))) < 4 THEN lpad(hex(unicode(c)), 4, '0') ELSE hex(unicode(c)) END || '⟧' END"""


@query(f"""{SCAN} SELECT doc_id, sha256(coalesce(string_agg(CASE c WHEN chr(10) THEN '⏎' || chr(10) WHEN chr(9) THEN '→' WHEN ' ' THEN '·' ELSE {SHOWN} END, '' ORDER BY scalar_index), '')) AS shown
  FROM pos LEFT JOIN cat ON unicode(c) = code_point GROUP BY doc_id""")
def visible(spark, sf_dir):
    return planted(documents(spark, sf_dir)).select("doc_id", repair.sha256_of(render.visible(F.col("text"))).alias("shown"))


@query(f"""{SCAN}, s AS (SELECT doc_id, scalar_index, CASE c WHEN chr(10) THEN '⏎' WHEN chr(9) THEN '⇥' ELSE {SHOWN} END AS x, name FROM pos LEFT JOIN cat ON unicode(c) = code_point),
  w AS (SELECT doc_id, scalar_index, name, string_agg(x, '' ) OVER (PARTITION BY doc_id ORDER BY scalar_index ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS x, max(scalar_index) OVER (PARTITION BY doc_id) AS last FROM s)
  SELECT doc_id, scalar_index, CASE WHEN scalar_index > 4 THEN '…' ELSE '' END || x || CASE WHEN last > scalar_index + 4 THEN '…' ELSE '' END AS context FROM w WHERE name IS NOT NULL""")
def contexts(spark, sf_dir):
    return found(spark, sf_dir).select("doc_id", "scalar_index", render.context(F.col("text"), F.col("scalar_index"), 4).alias("context"))


# metrics and policy


@query(r"""SELECT doc_id, length(t)::BIGINT AS chars, length(regexp_replace(t, '[ \t\n\r]', '', 'g'))::BIGINT AS chars_no_space,
  len(list_filter(regexp_split_to_array(t, '[ \t\n\r]+'), lambda x: x <> ''))::BIGINT AS words, (length(t) - length(replace(t, chr(10), '')) + 1)::BIGINT AS lines,
  len(list_filter(regexp_split_to_array(t, '\n[ \t\r]*\n'), lambda x: regexp_matches(x, '[^ \t\n\r]')))::BIGINT AS paragraphs
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def metrics(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.text_metrics(F.coalesce("text", F.lit(""))).alias("m")).select("doc_id", "m.*")


@query(rf"""WITH {PLANTED_SQL} SELECT doc_id, (length(t) + len(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]')))::BIGINT AS chars,
  len(list_filter(regexp_split_to_array(t, '[\s\x{{A0}}\x{{3000}}\x{{FEFF}}\x{{2028}}]+'), lambda x: x <> ''))::BIGINT AS words, (length(t) - length(replace(t, chr(10), '')) + 1)::BIGINT AS lines FROM planted""")
def page_metrics(spark, sf_dir):
    return planted(documents(spark, sf_dir)).select("doc_id", T.page_metrics(F.col("text")).alias("m")).select("doc_id", "m.chars", "m.words", "m.lines")


@query(r"""SELECT doc_id, name, actual, maximum, 'forum: ' || lower(substr(name, 12)) || ' ' || actual || ' exceeds maximum ' || maximum AS description FROM (
  SELECT doc_id, unnest([{'name': 'CONSTRAINT_CHARS', 'actual': length(t)::BIGINT, 'maximum': 3000::BIGINT}, {'name': 'CONSTRAINT_WORDS', 'actual': len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> ''))::BIGINT, 'maximum': 300::BIGINT},
    {'name': 'CONSTRAINT_LINES', 'actual': (length(t) - length(replace(t, chr(10), '')) + 1)::BIGINT, 'maximum': 12::BIGINT}], recursive := true)
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) WHERE actual > maximum""")
def constraints(spark, sf_dir):
    v = transform.constraint_violations(F.coalesce("text", F.lit("")), F.lit("forum"), F.lit(3000), F.lit(300), F.lit(12))
    return documents(spark, sf_dir).select("doc_id", F.explode(v).alias("v")).select("doc_id", "v.name", "v.actual", "v.maximum", "v.description")


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(f"""SELECT page_id, CASE WHEN contains(h, 'twitter.com') OR contains(h, 'x.com') THEN 'twitter' WHEN contains(h, 'linkedin.com') THEN 'linkedin' WHEN contains(h, 'github.com') THEN 'github'
  WHEN contains(h, 'jira') OR contains(h, 'atlassian') THEN 'jira' WHEN contains(h, 'mail') OR contains(h, 'outlook') THEN 'email' END AS workspace FROM (SELECT page_id, {HOST} AS h FROM pages)""")
def workspaces(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fixes.workspace_of(F.col("url")).alias("workspace"))


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN 280::BIGINT WHEN 'assistant' THEN coalesce(CASE WHEN turn % 2 = 1 THEN 500::BIGINT END, 1000) END AS max_chars,
  CASE WHEN length(coalesce(text, '')) > CASE role WHEN 'user' THEN 280 WHEN 'assistant' THEN coalesce(CASE WHEN turn % 2 = 1 THEN 500 END, 1000) END THEN 'error' ELSE 'ok' END AS status FROM conversations""")
def field_limits(spark, sf_dir):
    limits = spark.createDataFrame([("user", 280), ("assistant", 1000)], "workspace string, max_chars long")
    c = table(spark, sf_dir, "conversations").withColumn("workspace", F.col("role"))
    joined = fixes.limits(c, limits, F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), 500))
    over = F.coalesce(F.length(F.coalesce("text", F.lit(""))) > F.col("max_chars"), F.lit(False))
    return joined.select("conv_id", "turn", "max_chars", fixes.field_status(over, F.lit(0)).alias("status"))


# transforms

BLANK = r"regexp_full_match(x, '[\s\x{A0}]*')"


@query(rf"""WITH {SPACED_SQL}, n AS (SELECT doc_id, string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM spaced),
  u AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM n),
  v AS (SELECT doc_id, i, regexp_replace(x, '[ \t]+$', '') AS y FROM u),
  q AS (SELECT doc_id, i, regexp_extract(y, '^[ \t]*') || regexp_replace(substr(y, length(regexp_extract(y, '^[ \t]*')) + 1), ' {{2,}}', ' ', 'g') AS x FROM v),
  b AS (SELECT *, {BLANK} AS blank, lag({BLANK}, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM q),
  k AS (SELECT * FROM b WHERE NOT (blank AND before)),
  e AS (SELECT *, min(CASE WHEN NOT blank THEN i END) OVER (PARTITION BY doc_id) AS lo, max(CASE WHEN NOT blank THEN i END) OVER (PARTITION BY doc_id) AS hi FROM k),
  s AS (SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (i BETWEEN lo AND hi), '') AS s FROM e GROUP BY doc_id)
  SELECT doc_id, sha256(CASE WHEN s <> '' AND NOT ends_with(s, chr(10)) THEN s || chr(10) ELSE s END) AS text_sha256 FROM s""")
def strict_profile(spark, sf_dir):
    done = spaced(documents(spark, sf_dir)).select("doc_id", transform.applied(F.col("text"), transform.profile("strict")).alias("r"))
    return done.select("doc_id", repair.sha256_of(F.col("r.text")).alias("text_sha256"))


@query()
def profile_changes(spark, sf_dir):
    done = spaced(documents(spark, sf_dir)).select(F.explode(transform.applied(F.col("text"), transform.profile("default"))["changes"]).alias("c"))
    return done.groupBy("c.kind").agg(F.count("*").alias("n_documents"), F.sum(F.col("c.detail").try_cast("long")).alias("total"))


@query(f"""WITH {SPACED_SQL} SELECT doc_id, CASE WHEN (length(t) - length(replace(t, chr(13) || chr(10), ''))) / 2 > length(replace(t, chr(13) || chr(10), '')) - length(replace(replace(t, chr(13) || chr(10), ''), chr(10), '')) THEN 'crlf' ELSE 'lf' END AS ending,
  md5(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS lf, md5(replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10))) AS crlf FROM spaced""")
def line_endings(spark, sf_dir):
    t = F.col("text")
    return spaced(documents(spark, sf_dir)).select("doc_id", F.when(T.dominant_ending(t) == "\r\n", "crlf").otherwise("lf").alias("ending"), F.md5(T.with_endings(t)).alias("lf"), F.md5(T.with_endings(t, "crlf")).alias("crlf"))


@query(rf"""WITH {SPACED_SQL}, s1 AS (SELECT doc_id, regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{{4,}}', repeat(chr(10), 3), 'g') AS t FROM spaced),
  s2 AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[ \t\n\r]+', ''), '[ \t\n\r]+$', '')), chr(10)) AS t FROM s1),
  s3 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^[ \t\n\r]+', ''), '[ \t\n\r]+$', '') AS t FROM s2)
  SELECT doc_id, md5(CASE WHEN ends_with(t, chr(10)) THEN t ELSE t || chr(10) END) AS text_md5 FROM s3""")
def legacy_chain(spark, sf_dir):
    return spaced(documents(spark, sf_dir)).select("doc_id", F.md5(transform.legacy(F.col("text"))).alias("text_md5"))


# the minimum detector, fixes

TEN = "0, 160, 8203, 65279, 173, 8206, 8207, 8288, 8204, 8205"


@query(f"""WITH {PLANTED_SQL}, {CH}, l AS (SELECT *, coalesce(sum(CASE WHEN unicode(c) > 65535 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id, line ORDER BY scalar_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pos WHERE c <> chr(10))
  SELECT doc_id, line, (before + 1)::BIGINT AS "column", unicode(c)::BIGINT AS byte_value, lower(CASE WHEN length(hex(unicode(c))) % 2 = 1 THEN '0' || hex(unicode(c)) ELSE hex(unicode(c)) END) AS hex_value
  FROM l WHERE unicode(c) IN ({TEN}, 127) OR (unicode(c) < 32 AND unicode(c) NOT IN (9, 13))""")
def minimum_scan(spark, sf_dir):
    return legacy.scan(planted(documents(spark, sf_dir))).select("doc_id", "line", "column", "byte_value", "hex_value")


@query()
def minimum_reports(spark, sf_dir):
    docs = planted(documents(spark, sf_dir))
    f = legacy.scan(docs)
    return legacy.report(docs, f, ["doc_id"]).join(legacy.hex_listing(f, ["doc_id"]), "doc_id", "left")


@query(rf"""WITH {PLANTED_SQL} SELECT doc_id, md5(regexp_replace(replace(t, chr(160), ' '), '[\x{{200B}}\x{{FEFF}}\x{{AD}}\x{{200E}}\x{{200F}}\x{{2060}}]', '', 'g')) AS fixed,
  len(regexp_extract_all(t, '[\x{{200B}}\x{{FEFF}}\x{{AD}}\x{{200E}}\x{{200F}}\x{{2060}}]'))::BIGINT AS removed,
  md5(regexp_replace(regexp_replace(regexp_replace(t, '[\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g'), '[\x{{2028}}\x{{2029}}]', chr(10), 'g'), '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{AD}}]', '', 'g')) AS field_fixed,
  len(regexp_extract_all(t, '[\x{{A0}}\x{{2000}}-\x{{200D}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{2028}}\x{{2029}}\x{{2060}}\x{{FEFF}}\x{{AD}}]'))::BIGINT AS field_fixes FROM planted""")
def fixed_texts(spark, sf_dir):
    t = F.col("text")
    return planted(documents(spark, sf_dir)).select("doc_id", F.md5(legacy.fixed(t)).alias("fixed"), legacy.fix_count(t).alias("removed"), F.md5(fixes.field_fixed(t)).alias("field_fixed"), fixes.field_fix_count(t).alias("field_fixes"))


@query(f"""{SCAN} SELECT CASE severity WHEN 'critical' THEN 'Error' WHEN 'error' THEN 'Warning' WHEN 'warning' THEN 'Information' ELSE 'Hint' END AS level,
  CASE WHEN code_point = 160 OR code_point BETWEEN 8192 AND 8202 OR code_point IN (8239, 8287, 12288) THEN ' ' WHEN code_point IN (8232, 8233) THEN chr(10) ELSE '' END AS replacement, count(*) AS n
  FROM f WHERE code_point IN (160, 173, 847, 8203, 8205, 65279, 8238, 12288, 8232) GROUP BY ALL""")
def editor_levels(spark, sf_dir):
    return fixes.editor_diagnostics(planted(documents(spark, sf_dir))).groupBy("level", "replacement").agg(F.count("*").alias("n"))


# repair


def _plan(spark, sf_dir):
    docs = planted(documents(spark, sf_dir))
    items = repair.proposed(docs, scan.find_all(docs), "doc_id")
    items = repair.approved(items, mechanical=True, ambiguous=("IDEOGRAPHIC SPACE",), rationale="registered query")
    return docs, written(items, "plan")  # its users read it several times: it is scanned for once


DECIDED = "CASE WHEN safety = 'semantic' THEN 'refused' WHEN fix NOT IN ('remove', 'replace') THEN 'kept' WHEN safety = 'mechanical' OR name = 'IDEOGRAPHIC SPACE' THEN 'approved' ELSE 'kept' END"


@query(f"""{SCAN}, {MARKS}, p AS (SELECT name, safety, fix, fix_with FROM f UNION ALL SELECT 'ZALGO_RUN', 'ambiguous', 'review', NULL FROM z)
  SELECT name, CASE WHEN safety = 'semantic' THEN 'keep' WHEN fix = 'remove' THEN 'remove' WHEN fix_with = chr(10) THEN 'replace-newline' WHEN fix_with = ' ' THEN 'replace-space' ELSE 'keep' END AS action, {DECIDED} AS decision, count(*) AS n FROM p GROUP BY ALL""")
def repair_decisions(spark, sf_dir):
    return _plan(spark, sf_dir)[1].groupBy("name", "action", "decision").agg(F.count("*").alias("n"))


@query(f"""{SCAN}, r AS (SELECT pos.doc_id, scalar_index, CASE WHEN name IS NOT NULL AND {DECIDED} = 'approved' THEN coalesce(fix_with, '') ELSE c END AS c, (name IS NOT NULL AND {DECIDED} = 'approved')::INT AS e FROM pos LEFT JOIN cat ON unicode(c) = code_point)
  SELECT doc_id, sha256(string_agg(c, '' ORDER BY scalar_index)) AS output_sha256, sum(e)::BIGINT AS n_edits FROM r GROUP BY doc_id""")
def repaired_copies(spark, sf_dir):
    docs, items = _plan(spark, sf_dir)
    return repair.applied(docs, items, "doc_id")[0].select("doc_id", "output_sha256", "n_edits")


@query(f"""{SCAN} SELECT 'original' AS version, doc_id, name, count(*) AS excess FROM f WHERE {DECIDED} = 'approved' GROUP BY ALL""")
def repair_verification(spark, sf_dir):
    """What a new scan finds beyond the plan's remainder: nothing in the copies, every approved item in the originals."""
    docs, items = _plan(spark, sf_dir)
    copies = repair.unexpected(repair.applied(docs, items, "doc_id")[0], items, "doc_id").withColumn("version", F.lit("copy"))
    return copies.unionByName(repair.unexpected(docs, items, "doc_id").withColumn("version", F.lit("original"))).select("version", "doc_id", "name", "excess")


@query(f"""{SCAN}, {MARKS}, p AS (SELECT doc_id, name, {DECIDED} AS decision FROM f UNION ALL SELECT doc_id, 'ZALGO_RUN', 'kept' FROM z),
  k AS (SELECT doc_id, count(*) FILTER (decision <> 'approved') AS n_kept, count(*) FILTER (decision = 'approved') AS n_applied FROM p GROUP BY doc_id)
  SELECT doc_id, n_kept, n_applied, true AS verified FROM k""")
def repair_records(spark, sf_dir):
    """Stored plans, read back into items, applied, and verified from their provenance."""
    docs, items = _plan(spark, sf_dir)
    again = repair.plan_items(repair.plans(items, "doc_id", {"threshold": "info"}), "doc_id")
    copies = repair.applied(docs, again, "doc_id")[0]
    records = repair.provenance(copies, again, "doc_id")
    counts = records.select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.size("applied").cast("long").alias("n_applied"))
    return counts.join(repair.verified(copies, records, "doc_id").select("doc_id", "verified"), "doc_id")


@query(f"""{SCAN}, {MARKS}, p AS (SELECT doc_id, name, {DECIDED} AS decision FROM f UNION ALL SELECT doc_id, 'ZALGO_RUN', 'kept' FROM z),
  r AS (SELECT pos.doc_id, scalar_index, CASE WHEN name IS NOT NULL AND {DECIDED} = 'approved' THEN coalesce(fix_with, '') ELSE c END AS c FROM pos LEFT JOIN cat ON unicode(c) = code_point),
  o AS (SELECT doc_id, sha256(string_agg(c, '' ORDER BY scalar_index)) AS output_sha256, strlen(string_agg(c, '')) AS output_bytes FROM r GROUP BY doc_id),
  k AS (SELECT doc_id, count(*) FILTER (decision = 'approved') AS applied_edits, coalesce(string_agg(name, ',' ORDER BY name) FILTER (decision <> 'approved'), '') AS kept FROM p GROUP BY doc_id)
  SELECT doc_id, sha256(t) AS input_sha256, output_sha256, output_bytes::BIGINT AS output_bytes, applied_edits, kept, kept AS found, true AS verified FROM planted JOIN o USING (doc_id) JOIN k USING (doc_id)""")
def repair_store(spark, sf_dir):
    """Provenance and rescan records, read back from the store after the apply has been repeated."""
    docs, items = _plan(spark, sf_dir)
    store = RepairStore(spark, shared_folder(spark, "repair-store"))
    for _ in range(2):
        store.apply(docs, items, 0, at="2026-01-01T00:00:00Z")
    names = lambda a: F.array_join(F.array_sort(a), ",")
    rescans = store.rescans.read().select("doc_id", names(F.col("actual_finding_names")).alias("found"))
    records = store.provenance()[0].select("doc_id", F.col("input.sha256").alias("input_sha256"), F.col("output.sha256").alias("output_sha256"), F.col("output.bytes").alias("output_bytes"), "applied_edits", names(F.transform("kept", lambda k: k["name"])).alias("kept"), "verified")
    return records.join(rescans, "doc_id")


@query()
def repair_provenance(spark, sf_dir):
    docs, items = _plan(spark, sf_dir)
    return repair.provenance(repair.applied(docs, items, "doc_id")[0], items, "doc_id").filter("n_edits > 0")


@query()
def repair_diffs(spark, sf_dir):
    docs, items = _plan(spark, sf_dir)
    copies = repair.applied(docs, items, "doc_id")[0].select("doc_id", F.col("text").alias("new"))
    return repair.diffs(docs.join(copies, "doc_id"), "doc_id", "text", "new")


# markup


@query(rf"""WITH {STYLED_SQL}, n AS (SELECT unnest([
  {{'name': 'HIDDEN_STYLE_ZERO_FONT', 'n': len(regexp_extract_all(t, '(?i)font-size\s*:\s*0(?:\.0+)?(?:px|pt|em|rem|%)?[^\w.]'))}}, {{'name': 'HIDDEN_STYLE_TRANSPARENT', 'n': len(regexp_extract_all(t, '(?i)color\s*:\s*transparent'))}},
  {{'name': 'HIDDEN_STYLE_SAME_COLOR', 'n': len(list_filter(regexp_extract_all(t, '(?i)color\s*:\s*(?:#[0-9a-f]{{3,8}})\s*;\s*background(?:-color)?\s*:\s*#[0-9a-f]{{3,8}}'), lambda x: lower(regexp_extract(x, '#[0-9A-Fa-f]+')) = lower(regexp_extract(x, '.*(#[0-9A-Fa-f]+)', 1))))}},
  {{'name': 'HIDDEN_STYLE_OPACITY_ZERO', 'n': len(regexp_extract_all(t, '(?i)opacity\s*:\s*0(?:\.0+)?[^\d.]'))}}, {{'name': 'HIDDEN_STYLE_DISPLAY_NONE', 'n': len(regexp_extract_all(t, '(?i)display\s*:\s*none'))}},
  {{'name': 'HIDDEN_STYLE_VISIBILITY', 'n': len(regexp_extract_all(t, '(?i)visibility\s*:\s*(?:hidden|collapse)'))}}, {{'name': 'HIDDEN_STYLE_OFFSCREEN_INDENT', 'n': len(regexp_extract_all(t, '(?i)text-indent\s*:\s*-\d{{3,}}(?:px|em|rem)'))}},
  {{'name': 'HIDDEN_STYLE_HIDDEN_ATTR', 'n': len(regexp_extract_all(t, '(?i)<\w+[^>]*\s(?:hidden|aria-hidden\s*=\s*"true")[\s>]'))}},
  {{'name': 'HIDDEN_STYLE_CLIP', 'n': len(regexp_extract_all(t, '(?i)clip(?:-path)?\s*:\s*(?:rect\(\s*0(?:px)?[,\s]+0(?:px)?[,\s]+0(?:px)?[,\s]+0(?:px)?\s*\)|inset\(\s*50%\s*\))'))}}], recursive := true) FROM styled)
  SELECT name, sum(n)::BIGINT AS n FROM n GROUP BY name HAVING sum(n) > 0""")
def hidden_styles(spark, sf_dir):
    return styles.find_hidden_styles(styled(table(spark, sf_dir, "pages")), F.lit(".html")).groupBy("name").agg(F.count("*").alias("n"))


STYLE_PATTERNS = {
    "HIDDEN_STYLE_ZERO_FONT": r"(?i)font-size\s*:\s*0(?:\.0+)?(?:px|pt|em|rem|%)?[^\w.]", "HIDDEN_STYLE_TRANSPARENT": r"(?i)color\s*:\s*transparent", "HIDDEN_STYLE_OPACITY_ZERO": r"(?i)opacity\s*:\s*0(?:\.0+)?[^\d.]",
    "HIDDEN_STYLE_DISPLAY_NONE": r"(?i)display\s*:\s*none", "HIDDEN_STYLE_VISIBILITY": r"(?i)visibility\s*:\s*(?:hidden|collapse)", "HIDDEN_STYLE_OFFSCREEN_INDENT": r"(?i)text-indent\s*:\s*-\d{3,}(?:px|em|rem)",
    "HIDDEN_STYLE_HIDDEN_ATTR": r'(?i)<\w+[^>]*\s(?:hidden|aria-hidden\s*=\s*"true")[\s>]',
}
STYLE_ROWS = ", ".join(f"('{name}', '{pattern}')" for name, pattern in STYLE_PATTERNS.items())


@query(f"""WITH {STYLED_SQL}, p AS (SELECT page_id, k.name, hits, unnest(range(1, len(hits) + 1)) AS j, parts FROM (
    SELECT page_id, name, {" ".join(f"CASE name WHEN '{n}' THEN regexp_extract_all(t, '{x}') ELSE" for n, x in STYLE_PATTERNS.items())} [] {"END " * len(STYLE_PATTERNS)} AS hits,
      {" ".join(f"CASE name WHEN '{n}' THEN string_split_regex(t, '{x}') ELSE" for n, x in STYLE_PATTERNS.items())} [] {"END " * len(STYLE_PATTERNS)} AS parts
    FROM styled, (VALUES {STYLE_ROWS}) v(name, pattern)) k)
  SELECT page_id, name, (list_sum(list_transform(parts[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:j - 1], lambda x: length(x))), 0))::BIGINT AS scalar_index FROM p""")
def hidden_style_places(spark, sf_dir):
    """Where the idioms of one form stand."""
    found_ = styles.find_hidden_styles(styled(table(spark, sf_dir, "pages")), F.lit(".html"))
    return found_.filter(F.col("name").isin(*STYLE_PATTERNS)).select("page_id", "name", F.col("scalar_index").cast("long").alias("scalar_index"))


@query(rf"""WITH {STYLED_SQL}, {CAT}, e AS (SELECT page_id, unnest(regexp_extract_all(t, '&#(x?[0-9a-fA-F]+);', 1)) AS e FROM styled),
  d AS (SELECT page_id, CASE WHEN starts_with(e, 'x') THEN ('0x' || substr(e, 2))::BIGINT ELSE try_cast(regexp_extract(e, '^[0-9]+') AS BIGINT) END AS code_point FROM e)
  SELECT page_id, code_point, name || '_ENTITY' AS name, severity FROM d JOIN cat USING (code_point)""")
def entity_references(spark, sf_dir):
    return office.find_entities(styled(table(spark, sf_dir, "pages"))).select("page_id", "code_point", "name", "severity")


# packages and files

# what the files of ``planting.packed`` hide: characters of their text node, placed in the member, and marks of their kind
PATH = "doc_id || ['.docx', '.pptx', '.xlsx', '.pdf', '.md'][doc_id % 5 + 1]"
FORMULA = "CASE WHEN q % 2 = 1 THEN substr('SUM(' || repeat('A1,', 30), 1, 80) || '…' ELSE 'SUM(A1)' END"
PACKED = f"""{SCAN}, {MARKS}, k AS (SELECT doc_id, doc_id % 5 AS kind, doc_id // 5 AS q, {PATH} AS path FROM planted WHERE doc_id % 11 <> 10),
  g AS (SELECT doc_id, scalar_index, c, coalesce(sum(CASE c WHEN '&' THEN 4 WHEN '<' THEN 3 WHEN '>' THEN 3 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY scalar_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS more FROM pos),
  texts AS (SELECT path, name, (scalar_index + more + CASE kind WHEN 0 THEN 10 WHEN 1 THEN CASE WHEN q % 2 = 1 THEN 23 ELSE 12 END ELSE 3 END)::BIGINT AS scalar_index, NULL AS detail FROM g JOIN k USING (doc_id) JOIN cat ON unicode(c) = code_point WHERE kind < 3),
  marks AS (SELECT path, unnest(CASE kind
      WHEN 0 THEN [['OOXML_HIDDEN_RUN'], ['OOXML_WEB_HIDDEN_RUN'], ['OOXML_SUSPICIOUS_FONT_SIZE'], [], ['OOXML_HIDDEN_RUN', 'OOXML_WEB_HIDDEN_RUN', 'OOXML_SUSPICIOUS_FONT_SIZE']][q % 5 + 1]
      WHEN 1 THEN CASE WHEN q % 2 = 1 THEN ['OOXML_HIDDEN_SHAPE'] ELSE [] END WHEN 2 THEN CASE WHEN q % 3 < 2 THEN ['EMPTY_FORMULA_CELL'] ELSE [] END
      WHEN 3 THEN [['PDF_INVISIBLE_TEXT'], ['PDF_ZERO_FONT'], ['PDF_ZERO_WIDTH'], [], ['PDF_ZERO_FONT', 'PDF_ZERO_WIDTH']][q % 5 + 1] END) AS name, kind, q FROM k WHERE kind < 4),
  detailed AS (SELECT path, name, CASE WHEN kind = 2 THEN 'S' || q || '!B' || (q % 7 + 1) || ': ' || {FORMULA} || ', cached value ' || CASE q % 3 WHEN 0 THEN 'absent' ELSE 'empty' END
    WHEN name = 'OOXML_SUSPICIOUS_FONT_SIZE' THEN CASE q % 5 WHEN 2 THEN '2' ELSE '1' END || ' half-points' END AS detail FROM marks)"""


@query(f"{PACKED} SELECT path, name, scalar_index, detail FROM texts UNION ALL SELECT path, name, NULL, detail FROM detailed")
def package_findings(spark, sf_dir):
    """Findings in packages and PDF files; the places of run, shape, cell and operator marks are left out."""
    found_ = office.find_in_containers(packed(documents(spark, sf_dir)))[0]
    return found_.select("path", "name", F.when(F.col("code_point").isNotNull(), F.col("scalar_index")).alias("scalar_index"), "detail")


@query(f"""{PACKED}, n AS (SELECT path, count(*) AS n FROM (SELECT path FROM texts UNION ALL SELECT path FROM detailed UNION ALL
    SELECT path FROM k JOIN (SELECT doc_id, c FROM pos JOIN cat ON unicode(c) = code_point) USING (doc_id) WHERE kind = 4 AND c NOT IN ('&', '<', '>') UNION ALL SELECT path FROM k JOIN z USING (doc_id) WHERE kind = 4) GROUP BY path)
  SELECT {PATH} AS path, coalesce(n, 0)::BIGINT AS n_findings, doc_id % 11 = 10 AS failed FROM planted LEFT JOIN n ON n.path = {PATH}""")
def scanned_files(spark, sf_dir):
    """Every file, texts too, with its number of findings, and whether it could not be read."""
    return scan_files(packed(documents(spark, sf_dir)))[1].select("path", "n_findings", F.col("error").isNotNull().alias("failed"))


#: A schema for the records of ``record_problems``.
RECORD = {
    "type": "object", "required": ["id", "text"], "additionalProperties": False,
    "properties": {"id": {"type": "integer", "minimum": 10, "maximum": 800}, "text": {"type": "string", "pattern": "[a-z]"}, "lang": {"enum": ["en", "de", None]}, "at": {"type": "string", "format": "date-time"}, "tags": {"type": "array", "minItems": 1, "items": {"type": ["string", "null"]}}, "kind": {"const": "doc"}, "other": {"anyOf": [{"type": "null"}, {"type": "boolean"}]}},
}


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL THEN '$: missing required key "text"' END, CASE WHEN doc_id % 5 = 0 THEN '$: unexpected key "n"' END,
  CASE WHEN doc_id < 10 THEN '$.id: ' || doc_id || ' < minimum 10' WHEN doc_id > 800 THEN '$.id: ' || doc_id || ' > maximum 800' END, CASE WHEN NOT regexp_matches(text, '[a-z]') THEN '$.text: does not match pattern [a-z]' END,
  CASE WHEN lang NOT IN ('en', 'de') THEN '$.lang: must be one of "en", "de", null' END, CASE WHEN doc_id % 7 = 0 THEN '$.at: not an ISO-8601 date-time' END, CASE WHEN doc_id % 6 = 0 THEN '$.tags: needs at least 1 item(s)' WHEN doc_id % 6 = 1 THEN '$.tags[0]: expected type string,null, got number' END], lambda x: x IS NOT NULL), chr(10)) AS problems FROM documents WHERE doc_id IS NOT NULL""")
def record_problems(spark, sf_dir):
    """Documents as JSON records with planted faults, against a schema."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null")
    at = F.when(F.col("doc_id") % 7 == 0, "2026-13-01T00:00:00Z").otherwise("2026-01-01T10:00:00.5+02:00")
    tags = F.when(F.col("doc_id") % 6 == 0, "[]").when(F.col("doc_id") % 6 == 1, "[1.5]").otherwise('["a",null]')
    body = F.to_json(F.struct(F.col("doc_id").alias("id"), "text", "lang", at.alias("at"), F.when(F.col("doc_id") % 5 == 0, 1).alias("n"), F.lit("doc").alias("kind"), F.lit(True).alias("other")))
    record = F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(',"tags":'), tags, F.lit("}"))
    return validated(d.select("doc_id", record.alias("record")), RECORD).select("doc_id", F.array_join("problems", "\n").alias("problems"))


# scalar functions over the tables


@query(r"""SELECT doc_id, t = '' AS is_empty, nullif(substr(t, 4, 1), '') AS char_at, (position('the' IN t) - 1)::BIGINT AS index_of, t[3:8] AS sub, len(string_split(t, 'e'))::BIGINT AS n_parts,
  md5(reverse(t)) AS reversed, md5(CASE WHEN length(t) < 3000 THEN lpad(t, 3000, '*') ELSE t END) AS padded, starts_with(t, 'Th') AS starts, ends_with(t, '.') AS ends, contains(t, 'and') AS has,
  md5(lower(t)) AS low, md5(replace(t, 'e', '3')) AS replaced, md5(repeat(t, 3)) AS repeated, try_cast(nullif(regexp_extract(t, '[0-9]+'), '') AS BIGINT) AS parsed, unicode(nullif(t[1:1], ''))::BIGINT AS code FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def string_functions(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return documents(spark, sf_dir).select(
        "doc_id", strings.is_empty(t).alias("is_empty"), strings.char_at(t, 3).alias("char_at"), strings.index_of(t, "the").alias("index_of"), strings.substring(t, 2, 8).alias("sub"), F.size(strings.split(t, "e")).cast("long").alias("n_parts"),
        F.md5(F.reverse(t)).alias("reversed"), F.md5(strings.pad_left(t, 3000, "*")).alias("padded"), F.startswith(t, F.lit("Th")).alias("starts"), F.endswith(t, F.lit(".")).alias("ends"), F.contains(t, F.lit("and")).alias("has"),
        F.md5(F.lower(t)).alias("low"), F.md5(F.replace(t, F.lit("e"), F.lit("3"))).alias("replaced"), F.md5(F.repeat(t, 3)).alias("repeated"), strings.parse_int(F.nullif(F.regexp_extract(t, "[0-9]+", 0), F.lit(""))).alias("parsed"),
        F.when(t != "", F.ascii(t).cast("long")).alias("code"),
    )


@query("""SELECT vec_id, list_sum(list_transform(a, lambda x: x * 2))::BIGINT AS doubled, len(list_filter(a, lambda x: x > 0))::BIGINT AS positive, list_contains(a, 3) AS has_three, list_max(a) AS most, list_min(a) AS least,
  greatest(least(list_sum(a), 5), -5)::BIGINT AS clamped, len(list_filter(a, lambda x: x > -9)) = len(a) AS all_over, len(list_filter(a, lambda x: x > 8)) > 0 AS any_over, len(range(0, abs(label)))::BIGINT AS n_range
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: round(x * 10)::BIGINT) AS a FROM embeddings)""")
def array_functions(spark, sf_dir):
    a = F.col("a")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.rint(x * 10).cast("long")).alias("a"))
    zero = F.lit(0).cast("long")
    return e.select(
        "vec_id", strings.total(F.transform(a, lambda x: x * 2)).alias("doubled"), F.size(F.filter(a, lambda x: x > 0)).cast("long").alias("positive"), F.array_contains(a, 3).alias("has_three"), F.array_max(a).alias("most"), F.array_min(a).alias("least"),
        strings.clamp(strings.fold(a, zero, lambda x, y: x + y), F.lit(-5), F.lit(5)).cast("long").alias("clamped"), F.forall(a, lambda x: x > -9).alias("all_over"), F.exists(a, lambda x: x > 8).alias("any_over"),
        F.size(strings.span(zero, F.abs(F.col("label")).cast("long"))).cast("long").alias("n_range"),
    )


@query(r"""SELECT page_id, NOT starts_with(p, '/') AND NOT contains(p, '..') AS safe, regexp_replace(p, '[/\\:*?"<>|]', '_', 'g') AS clean, regexp_extract(p, '^(.+)/[^/]*$', 1) AS parent,
  string_split(p, '/')[-1] AS filename, ends_with(p, '.html') AS html, contains(p, '/en/') OR contains(p, 'spam') AS excluded, starts_with(p, 'http://') AS within, 'base/' || regexp_replace(p, '[/\\:*?"<>|]', '_', 'g') AS joined FROM (SELECT page_id, coalesce(url, '') AS p FROM pages)""")
def path_functions(spark, sf_dir):
    p = F.coalesce("url", F.lit(""))
    clean = strings.sanitize_filename(p)
    return table(spark, sf_dir, "pages").select(
        "page_id", strings.is_safe(p).alias("safe"), clean.alias("clean"), strings.parent(p).alias("parent"), strings.filename(p).alias("filename"), strings.has_extension(p, ".html").alias("html"),
        strings.is_excluded(p, ["/en/", "spam"]).alias("excluded"), strings.is_within(p, F.lit("http://")).alias("within"), strings.safe_join(F.array(F.lit("base"), clean)).alias("joined"),
    )


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html,
  md5(replace(replace(replace(replace(replace(h, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')) AS js,
  md5(replace(replace(replace(h, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')) AS workflow, md5(lower(hex(encode(h)))) AS hexed FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)""")
def escapes(spark, sf_dir):
    h = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html(h)).alias("html"), F.md5(T.escape_js(h)).alias("js"), F.md5(T.escape_workflow(h)).alias("workflow"), F.md5(T.encode_bytes(F.encode(h, "UTF-8"))).alias("hexed"))


@query("""SELECT doc_id, md5(t) AS back, chr(unicode(t[1:1])) AS first FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x{1}-\\x{FF}]', '', 'g') AS t FROM documents) WHERE t <> ''""")
def hex_round_trip(spark, sf_dir):
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x{1}-\x{FF}]", "")
    rows = documents(spark, sf_dir).select("doc_id", t.alias("t")).filter("t <> ''")
    return rows.select("doc_id", F.md5(T.decode_string(T.encode_string(F.col("t")))).alias("back"), strings.int_to_char(F.ascii("t").cast("long")).alias("first"))


@query(f"{ALL} SELECT name, count(*) AS n FROM a WHERE severity_rank >= 2 GROUP BY name")
def audited_names(spark, sf_dir):
    """An audit with settings: warnings and above."""
    found_ = audit(planted(documents(spark, sf_dir)), "doc_id", Settings(threshold="warning")).findings
    return report.at_or_above(found_, "warning").groupBy("name").agg(F.count("*").alias("n"))


# streams and stored state

#: Events as edits of a text per user, with hidden characters; the period of rest, in milliseconds.
EDITS_SQL = PLANTED_SQL.replace("FROM documents WHERE", "FROM (SELECT event_id AS doc_id, event_type || ' ' || props AS text FROM events) WHERE")
EDIT_SCAN = f"WITH {EDITS_SQL}, {CH}, {CAT}, {FOUND}"
REST_MS = 3_600_000


@query(f"""{EDIT_SCAN}, {MARKS}, e AS (
  SELECT user_id, event_id, epoch_ms(ts) AS since, lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS later, max(epoch_ms(ts)) OVER () AS now FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
) SELECT user_id, event_id, x.name, x.scalar_index FROM (SELECT doc_id, name, scalar_index FROM f UNION ALL SELECT doc_id, 'ZALGO_RUN', scalar_index FROM z) x JOIN e ON e.event_id = x.doc_id
  WHERE since + {REST_MS} <= now AND (later IS NULL OR later - since >= {REST_MS})""")
def quiet_scans(spark, sf_dir):
    """A stream of edits, scanned once a user's text has been still for an hour: what stands by the end of the feed."""
    path = f"{sf_dir}/events.parquet"
    edits = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as a stream takes no single file
    edits = edits.select("user_id", "ts", F.col("event_id").alias("version"), planted_text(F.concat_ws(" ", "event_type", "props"), F.col("event_id")).alias("text"))
    folder = shared_folder(spark, "quiet-scans")
    log = BatchLog(spark, f"{folder}/found", "user_id long, version long, name string, scalar_index long")
    quiet.scan_quiet(edits, "user_id", "ts", log.commit, f"{folder}/state", quiet_ms=REST_MS).awaitTermination()
    return log.read().withColumnRenamed("version", "event_id")


#: Turns as versions of a text per conversation, two to a batch up to the fourth batch, which has the rest.
TURNS_SQL = PLANTED_SQL.replace("FROM documents WHERE", "FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations) WHERE")


@query(f"""WITH {TURNS_SQL}, {CH}, {CAT}, {FOUND}, {MARKS}, x AS (SELECT doc_id, name, severity, scalar_index FROM f UNION ALL SELECT doc_id, 'ZALGO_RUN', 'error', scalar_index FROM z),
  v AS (SELECT DISTINCT conv_id, turn, least(turn // 2, 3) AS batch FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  last AS (SELECT conv_id, batch, max(turn) AS turn FROM v GROUP BY ALL),
  step AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY batch) AS before FROM last),
  change AS (
    SELECT conv_id, s.turn AS version, name, severity, scalar_index, 1 AS change FROM step s JOIN x ON x.doc_id = conv_id * 1000 + s.turn
    UNION ALL SELECT conv_id, s.turn, name, severity, scalar_index, -1 FROM step s JOIN x ON x.doc_id = conv_id * 1000 + s.before
  ) SELECT conv_id, version, name, severity, scalar_index, sum(change)::BIGINT AS change FROM change GROUP BY ALL HAVING sum(change) <> 0""")
def diagnostic_changes(spark, sf_dir):
    """What each new version of a text adds to its findings and takes back; the second batch comes twice, as after a crash."""
    turns = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    versions = turns.select("conv_id", F.col("turn").alias("version"), planted_text(F.col("text"), F.col("conv_id") * 1000 + F.col("turn")).alias("text"))
    log = diagnostics.diagnostics_log(spark, shared_folder(spark, "diagnostics"), "conv_id")
    for batch in (0, 1, 1, 2, 3):
        diagnostics.record_changes(log, versions.filter(F.least(F.floor(F.col("version") / 2), F.lit(3)) == batch), batch, "conv_id")
    return log.read().groupBy("conv_id", "version", "name", "severity", "scalar_index").agg(F.sum("change").alias("change")).filter("change <> 0")


# fields of forms

FIELDS_SQL = TURNS_SQL
HIDDEN = r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2028}\x{2029}\x{0}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}]"


def _fields(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    return c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, 400).cast("long").alias("max_chars"), planted_text(F.col("text"), F.col("conv_id") * 1000 + F.col("turn")).alias("text"))


@query(rf"""WITH {FIELDS_SQL}, n AS (SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, len(regexp_extract_all(t, '{HIDDEN}')) AS n_artifacts, length(t) AS n FROM planted)
  SELECT conv_id, turn, n_artifacts::BIGINT AS n_artifacts, CASE WHEN turn % 2 = 0 AND n > 400 THEN 'error' WHEN n_artifacts > 0 THEN 'warning' ELSE 'ok' END AS status FROM n""")
def field_states(spark, sf_dir):
    """Turns as fields of a form, every other one with a limit: too long, with hidden characters, or in order."""
    return fixes.checked_fields(_fields(spark, sf_dir)).select("conv_id", "turn", "n_artifacts", "status")


@query(rf"""WITH {FIELDS_SQL}, n AS (SELECT doc_id // 1000 AS conv_id, len(regexp_extract_all(t, '{HIDDEN}')) AS n FROM planted)
  SELECT conv_id, count(*) AS n_fields, count(*) FILTER (n > 0) AS n_changed, sum(n)::BIGINT AS n_fixed FROM n GROUP BY ROLLUP (conv_id)""")
def fields_fixed(spark, sf_dir):
    """What fixing all fields at once changes, by form and in all."""
    return fixes.all_fields_fixed(_fields(spark, sf_dir), "conv_id")[1]


# what editors and builds show


@query(f"""{SCAN}, {MARKS}, p AS (SELECT doc_id, name, safety, CASE WHEN safety = 'semantic' THEN 'keep' WHEN fix IN ('remove', 'replace') THEN fix ELSE 'keep' END AS action FROM f UNION ALL SELECT doc_id, 'ZALGO_RUN', 'ambiguous', 'keep' FROM z)
  SELECT doc_id, count(*) AS n_items, count(*) FILTER (safety <> 'semantic' AND action <> 'keep') AS n_repairable, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (safety = 'ambiguous'), '') AS ambiguous FROM p GROUP BY doc_id""")
def plan_counts(spark, sf_dir):
    """Plans ready for review: their items, those that can be repaired, and the names that a full grant lists."""
    docs = planted(documents(spark, sf_dir))
    return repair.plan_counts(repair.proposed(docs, scan.find_all(docs), "doc_id"), "doc_id").withColumn("ambiguous", F.array_join("ambiguous", ","))


@query(rf"""{SCAN}, n AS (SELECT doc_id, coalesce(n, 0) AS n, (length(t) + len(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]'))) || ' chars, ' || len(list_filter(regexp_split_to_array(t, '[\s\x{{A0}}\x{{3000}}\x{{FEFF}}\x{{2028}}]+'), lambda x: x <> '')) || ' words' AS m
    FROM planted LEFT JOIN (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id) USING (doc_id))
  SELECT doc_id, n, CASE WHEN n > 0 THEN '$(warning) ' || n || ' invisible' ELSE '$(check) Clean' END || ' | ' || m AS status,
    CASE WHEN n > 1 THEN n || ' invisible characters detected. Click to scan.' WHEN n = 1 THEN '1 invisible character detected. Click to scan.' ELSE 'No invisible characters detected' END AS tooltip FROM n""")
def status_bars(spark, sf_dir):
    docs = planted(documents(spark, sf_dir))
    return report.status_bar(docs, scan.find_characters(docs), "doc_id", with_metrics=True)


@query(f"""{ALL} SELECT threshold, 'scanned ' || (SELECT count(*) FROM planted) || ' file(s); ' || (SELECT count(*) FROM a) || ' finding(s), ' || (SELECT count(*) FROM a WHERE severity_rank >= r) || ' blocking at threshold ' || threshold AS line
  FROM (VALUES ('info', 1), ('warning', 2), ('error', 3), ('critical', 4)) v(threshold, r)
  UNION ALL SELECT 'unreadable', (SELECT count(*) FROM planted WHERE doc_id % 50 = 0) || ' file(s) could not be scanned (scanner errors fail distinctly from findings)'""")
def closing_lines(spark, sf_dir):
    """The closing line of an audit at each threshold, and of one with files that could not be read."""
    docs = planted(documents(spark, sf_dir))
    # counts by severity once, for all thresholds
    by = scan.find_all(docs).groupBy("severity_rank").agg(F.count("*").alias("n"))
    n = docs.agg(F.count("*").alias("n_documents"), F.count_if(F.col("doc_id") % 50 == 0).alias("n_bad"))
    blocking = [F.coalesce(F.sum(F.when(F.col("severity_rank") >= r, F.col("n"))), F.lit(0)).alias(t) for t, r in report.RANKS.items()]
    sums = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"), *blocking).crossJoin(n)  # two frames of one row
    cases = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(t).alias("n_blocking"), F.lit(0).alias("n_errors")) for t in report.RANKS], F.struct(F.lit("unreadable").alias("threshold"), F.lit(0).cast("long").alias("n_blocking"), F.col("n_bad").cast("int").alias("n_errors"))))
    rows = sums.select("n_documents", "n_findings", cases.alias("c")).select("n_documents", "n_findings", "c.*")
    return report.summary_line(rows, F.col("threshold")).select("threshold", "line")


# order and marked regions


@query("""SELECT page_id, row_number() OVER (PARTITION BY h ORDER BY icu_sort_key(url, 'en'), url, page_id)::BIGINT AS place FROM (SELECT *, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages WHERE url IS NOT NULL)""")
def paths_in_order(spark, sf_dir):
    """Each page's place among those of its host, in the order in which people read paths."""
    pages = table(spark, sf_dir, "pages").filter("url is not null").select("page_id", "url", F.regexp_extract("url", r"://([^/?#]*)", 1).alias("h"))
    return pages.select("page_id", F.row_number().over(Window.partitionBy("h").orderBy(*path_order("url"), "page_id")).cast("long").alias("place"))


REGION_ROWS = "SELECT string_agg('{\"code_point\":' || code_point || ',\"name\":\"' || name || '\",\"severity\":\"' || severity || '\"}', chr(10) ORDER BY code_point) AS lines FROM cat WHERE severity = 'critical'"


@query(f"""WITH {CAT}, t AS ({REGION_ROWS}), p AS (SELECT page_id, coalesce(html, '') AS h, '{regions.begin_line("critical")}' AS b, '{regions.END}' AS e, lines FROM pages, t WHERE page_id IS NOT NULL)
  SELECT page_id, page_id % 4 = 1 AS drifted, CASE page_id % 4 WHEN 2 THEN 'missing "' || e || '" after ' || b WHEN 3 THEN 'missing marker "' || b || '"' END AS problem,
    md5(CASE page_id % 4 WHEN 2 THEN h || chr(10) || b || chr(10) || 'old' WHEN 3 THEN h ELSE h || chr(10) || b || chr(10) || lines || chr(10) || e || ' tail' END) AS synced FROM p""")
def region_drift(spark, sf_dir):
    """Pages that end in a generated table: fresh, old, cut short, or none; brought up to date."""
    cat = catalogue(spark).filter("severity = 'critical'").select("code_point", "name", "severity", F.lit(None).cast("string").alias("description"))
    fresh = regions.rendered(cat, "critical").withColumnRenamed("region", "fresh")
    b, n, h = F.lit(regions.begin_line("critical")), F.col("page_id") % 4, F.coalesce("html", F.lit(""))
    pages = table(spark, sf_dir, "pages").filter("page_id is not null").crossJoin(F.broadcast(fresh))  # one row
    text = F.when(n == 3, h).when(n == 2, F.concat_ws("\n", h, b, F.lit("old"))).when(n == 1, F.concat(h, F.lit("\n"), b, F.lit(f"\nold\n{regions.END} tail"))).otherwise(F.concat(h, F.lit("\n"), F.col("fresh"), F.lit(" tail")))
    out = regions.synchronised(pages.select("page_id", text.alias("text")), cat, "critical")
    return out.select("page_id", "drifted", "problem", F.md5("text").alias("synced"))
