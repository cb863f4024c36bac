"""From raw documents to packed sequences.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written and read again
for the next one. All but the last return the columns of ``documents``:

1. quality_rules: documents that the base rules or the tokeniser bands reject go; bands are
   fitted on all of the labels table, or, where there is none, those given in ``BANDS``.
2. line_dedup: of lines that are near-equal (edit similarity of 0.9) across the corpus one
   stays; documents left without any word go.
3. ngram_jaccard_join: of each group of documents linked by five-word shingles at a
   similarity of 0.8 the one with the smallest doc_id stays.
4. benchmark_decontamination: documents that hold a passage of a benchmark item go.
5. best_fit_packing: what is left becomes sequences of at most 2048 tokens.

A stage first takes away what earlier ones left in the shared folder, but for what its own input reads;
other results of earlier stages must be written by then. Input columns may have any names. Rows with a null doc_id pass stages 2 and 3 as they are. ``ORACLE_SQL`` is None, as SQL
has no tokenizers; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import decontam, line_dedup, ngram_join, packing, quality
from lexigrain.llm.queries import BANDS, PIECES, RANKS
from lexigrain.llm.shared import clear, collected, exists, written
from lexigrain.llm.vocab import vocabulary_path

ORACLE_SQL = None
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Edit similarity of lines in per cent. Higher than the operator's own 80: near copies of whole documents are the
#: next stage's work, and a line of few words that differs in one of them is often a line of its own.
LINE_PERCENT = 90


def mark():
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64("text")


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"{name}_"
    return name


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` less these (doc_id, mark) rows; Spark broadcasts them only if their size allows."""
    doc_id, its_mark = unused(docs, "gone_id"), unused(docs, "gone_mark")
    gone = written(rows.distinct(), "dropped").select(F.col("doc_id").alias(doc_id), F.col("mark").alias(its_mark))
    return docs.join(gone, (F.col("doc_id") == F.col(doc_id)) & (mark() == F.col(its_mark)), "left_anti")


def tidy(stage: Stage) -> Stage:
    """The stage, after what the one before left in the shared folder is taken away."""

    @wraps(stage)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark, docs)
        with collected(spark):
            return stage(spark, docs, sf_dir)

    return run_


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = f"{sf_dir}/labels.parquet"
    good = spark.read.parquet(labels) if exists(spark, labels) else None
    return quality.kept_documents(docs, BANDS, vocabulary_path(PIECES), vocabulary_path(RANKS), good)


@tidy
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    held = {c: f"own_{c}" for c in ("n_lines", "n_removed_lines") if c in columns}  # clashing names stand aside meanwhile
    out = line_dedup.remove_lines(docs.withColumnsRenamed(held), min_words=1, percent=LINE_PERCENT)
    out = out.filter("text is null or n_removed_lines = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    # written here: the next stage does not run beside this one's shuffles
    return written(out.select(*[F.col(held.get(c, c)).alias(c) for c in columns]), "lines-removed")


@tidy
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(docs.select("doc_id", "text", mark().alias("mark")), n=5, percent=80, carry=("mark",))
    found = written(found.filter("doc_id is not null").select("doc_id", "mark", "component"), "components")
    first = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    left = without(docs, found.join(first, "component").filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("mark") != F.col("first.mark"))).select("doc_id", "mark"))
    # rows that are the same in both are copies of one another
    twice = found.groupBy("doc_id", "mark").count().filter("count > 1").select("doc_id", "mark")
    twice = written(twice, "repeated-rows")
    if twice.isEmpty():
        return left
    doc_id, its_mark = unused(docs, "twice_id"), unused(docs, "twice_mark")
    again = twice.select(F.col("doc_id").alias(doc_id), F.col("mark").alias(its_mark))
    repeated = left.join(again, (F.col("doc_id") == F.col(doc_id)) & (mark() == F.col(its_mark)), "left_semi").withColumn(its_mark, mark())
    repeated = repeated.dropDuplicates(["doc_id", its_mark]).drop(its_mark)
    return without(left, twice).unionByName(repeated)


@tidy
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = F.xxhash64("doc_id", "text")
    found = decontam.contaminated(docs.select(row.alias("doc_id"), "text"), benchmark)
    name = unused(docs, "gone")
    gone = written(found.select(F.col("doc_id").alias(name)).distinct(), "dropped")
    return docs.join(gone, row == F.col(name), "left_anti")


@tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
