"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import bpe, decontam, line_dedup, ngram_join, packing, periodic_runs, pii, prefix_trie, quality, substring_dedup, suffix_dedup, token_counts, url_filters
from lexigrain.llm.shared import new_folder, written
from lexigrain.llm.vocab import vocabulary_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


#: (host, path, action) of the contract.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, action string")
    return url_filters.match_rules(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE["op5_url_filters"] = """
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), s AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), r(h, q, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT s.rid, r.h || r.q AS rule, r.verdict, row_number() OVER (PARTITION BY s.rid ORDER BY length(r.h || r.q) DESC) AS k
  FROM s JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.q)
)
SELECT s.page_id, coalesce(s.host, '') AS host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM s LEFT JOIN m ON s.rid = m.rid AND m.k = 1
"""


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter with estimates, are revised to real counts, are counted by a second tokenizer, and lose those labelled toxic; batches are folded in between, and the last is committed twice."""
    counts = written(token_counts.counted(table(spark, sf_dir, "documents")), "token-counts")
    toxic = counts.join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    ledger = token_counts.TokenLedger(spark, new_folder(spark, "token-ledger"))
    ch = token_counts.changes
    gone = ch(toxic, "delete", "words-1", old="words-1").unionByName(ch(toxic, "delete", "marks-1", old="marks-1"))
    ledger.commit(ch(counts, "insert", "words-1", new="estimate"), 1)
    ledger.commit(ch(counts, "revise", "words-1", old="estimate", new="words-1"), 2)
    ledger.fold()
    ledger.commit(ch(counts, "insert", "marks-1", new="marks-1"), 3)
    ledger.commit(gone, 4)
    ledger.commit(gone, 4)
    return ledger.totals()


ORACLE["op6_token_counts"] = r"""
WITH kept AS (
  SELECT source, lang, coalesce(text, '') AS text FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
), counted AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'marks-1', len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) FROM kept
)
SELECT source, lang, tokenizer_version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens
FROM counted GROUP BY ALL
"""


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Given bands, for tables without labels: wide ones, and narrower ones of four languages, whose lower ends lie below
#: every prose document of these that was looked at.
BANDS = {
    "default": quality.Band((0.9, 8.0), (0.9, 9.0), (0.0, 0.3), (0.3, 1.0)),
    "en": quality.Band((1.2, 8.0), (1.98, 9.0), (0.0, 0.1), (0.3, 1.0)),
    "de": quality.Band((1.2, 8.0), (1.98, 9.0), (0.0, 0.1), (0.3, 1.0)),
    "es": quality.Band((1.2, 8.0), (1.95, 9.0), (0.0, 0.1), (0.3, 1.0)),
    "fr": quality.Band((1.2, 8.0), (1.75, 9.0), (0.0, 0.1), (0.3, 1.0)),
}
PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = written(quality.counts(table(spark, sf_dir, "documents"), vocabulary_path(PIECES), vocabulary_path(RANKS), ["doc_id", "lang"]), "counted")
    fitted = quality.fitted_to(counted, table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judged_by_fit(counted, fitted).select(*columns, "band_failed", "script", "n_tokens", *quality.MEASURES)


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


ORACLE["op7_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)
), hit AS (
  SELECT rid, i FROM win JOIN (SELECT k, min(doc_id) AS least FROM win GROUP BY k) USING (k) WHERE least < doc_id
), gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM hit),
word AS (SELECT rid, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT rid, string_agg(t, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid
), lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN lost USING (rid)
"""


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


ORACLE["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+2], ' ')) AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.c + q.c - k)
), sym AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (
  SELECT x, y FROM sym UNION SELECT r.x, t.y FROM reach r JOIN sym t ON r.y = t.x
), least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, least(coalesce(m, d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.x = d.doc_id
"""


@query
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(documents, key="registered-query")[0]


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.numbered(table(spark, sf_dir, "conversations"))))


#: crc32 of ASCII text in DuckDB: the table of bytes, and the fold over a text.
CRC_TABLE = "SELECT list(c ORDER BY n) AS crc_of FROM (SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(n))"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc_of[1 + (xor(c, b) & 255)])), 4294967295)"

ORACLE["op11_prefix_trie"] = f"""
WITH crc AS ({CRC_TABLE}), own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS v
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (SELECT conv_id, v, conv_id - conv_id % 5 AS base, ({CRC.format("conv_id::VARCHAR")} % 9)::INT AS h FROM own, crc),
seq AS (SELECT h.conv_id, list_concat(coalesce(b.v[1:h.h], []), h.v[h.h + 1:]) AS v FROM h LEFT JOIN own b ON b.conv_id = h.base),
pre AS MATERIALIZED (
  SELECT conv_id, d, len(v) AS n, CASE WHEN d > 0 THEN strlen(v[d].t) ELSE 0 END AS bytes, sha256(list_transform(v[1:d], lambda x: sha256(x.r) || sha256(x.t)) :: VARCHAR) AS k,
    CASE WHEN d > 0 THEN sha256(list_transform(v[1:d - 1], lambda x: sha256(x.r) || sha256(x.t)) :: VARCHAR) END AS up
  FROM (SELECT *, unnest(range(0, len(v) + 1)) AS d FROM seq)
), node AS MATERIALIZED (
  SELECT k, any_value(up) AS up, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM pre GROUP BY k
), kids AS (SELECT up AS k, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
total AS (
  SELECT pre.k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(node.saved) AS saved
  FROM node JOIN pre ON pre.conv_id = node.conv_id AND pre.d <= node.depth LEFT JOIN kids ON kids.k = node.k GROUP BY pre.k
)
SELECT node.conv_id, node.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  total.n_leaves::BIGINT AS n_leaves, total.saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node LEFT JOIN node up ON up.k = node.up LEFT JOIN kids ON kids.k = node.k JOIN total ON total.k = node.k
"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_repeats(table(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * m.length div -m.period").cast("long").alias("exponent_milli")
    return found.select("doc_id", "n_runs", (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"), exponent, "runs_sha256", "collapsed_sha256")


ORACLE["op12_periodic_runs"] = rf"""
WITH crc AS ({CRC_TABLE}), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, coalesce({CRC.format("doc_id::VARCHAR")}, 1) AS h FROM documents, crc
), s AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
m AS MATERIALIZED (
  SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[1 + a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8))])) ELSE w END AS w FROM s
), gram AS MATERIALIZED (
  SELECT rid, i, hash(array_to_string(w[i + 1:i + 6], ' ')) AS k, n FROM (SELECT rid, w, len(w) AS n, unnest(range(0, len(w) - 5)) AS i FROM m WHERE len(w) >= 12)
), pair AS (
  SELECT a.rid, b.i AS j, b.i - a.i AS q FROM gram a JOIN gram b ON a.rid = b.rid AND a.k = b.k AND a.i < b.i AND 2 * (b.i - a.i) <= a.n
), diag AS (
  SELECT rid, q, min(j) - q AS s, count(*) + 5 + q AS len FROM (SELECT *, j - row_number() OVER (PARTITION BY rid, q ORDER BY j) AS island FROM pair) GROUP BY rid, q, island
), long AS MATERIALIZED (SELECT * FROM diag WHERE len - q >= greatest(12 - q, q)),
run AS MATERIALIZED (
  SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.rid = x.rid AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)
), gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS p FROM run),
word AS (SELECT rid, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM m),
kept AS (SELECT rid, string_agg(t, ' ' ORDER BY p) AS c FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY rid ORDER BY len DESC, s, q) = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY rid)
SELECT m.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period, (1000 * len // q)::BIGINT AS exponent_milli,
  sha256(coalesce(t, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM m LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""


@query
def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
