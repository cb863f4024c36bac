"""Quality rules: base text counts and tokeniser fertility with bands per language and script.

Each word is encoded by itself under two public vocabularies. Per document that gives
characters per token (both vocabularies), the share of byte-fallback tokens and the
entropy of its tokens; the latter is divided by the most that so many tokens can have.
A document is rejected if a measure lies outside the band of its language and script (its
most frequent script, by the leading bytes of its letters).

Bands are fitted on all documents labelled good (``fit_bands``), from the counts that are
judged afterwards, so that each text is counted once: each measure's middle is a line over the logarithm of the number of tokens, its spread f² + s² /
tokens, and the band reaches ``width`` spreads to either side; so short documents have wide
bands. Languages with fewer than ``LEAST_ROWS`` labelled rows take the bands of all rows
together; with none at all, bands reject nothing. Bands can also be given (``Band``);
these widen in proportion for documents under ``FULL_TOKENS`` tokens.

Defined results: a null or empty text has no words, all counts 0, null measures and script, and
fails the base rules; a null or unknown language takes the common band; repeated rows
are each judged; an empty table gives no rows; of extra columns those in ``carry`` stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.arrays import EXACT, SPACE, Sums, chunks, covered, grams, per_doc, repeated, words
from lexigrain.llm.shared import written
from lexigrain.llm.vocab import only, piece_tokens, rank_tokens

COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, n_byte_tokens long, token_entropy double, n_tokens_2 long, script string"
)
#: What ``judged`` adds to them.
VERDICT = ["chars_per_token", "chars_per_token_2", "byte_share", "evenness", "base_failed", "band_failed", "kept"]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5
MEASURES = ["chars_per_token", "chars_per_token_2", "byte_share", "evenness"]
#: Rows from which a language and script has bands of its own.
LEAST_ROWS = 30
#: Spreads to either side, and the least spread of any measure.
WIDTH, LEAST_SPREAD = 5.0, 0.02
FULL_TOKENS = 100
# Scripts by the leading byte of a letter's UTF-8 form.
SCRIPTS = {"Latin": [*range(65, 91), *range(97, 123), *range(0xC3, 0xCB)], "Greek": [0xCE, 0xCF], "Cyrillic": range(0xD0, 0xD4), "Semitic": range(0xD6, 0xDC), "Indic": [0xE0], "Han": range(0xE3, 0xEA), "Hangul": range(0xEA, 0xEE)}
SCRIPT_NAMES = np.array([*SCRIPTS, ""], object)
SCRIPT_OF = np.full(256, len(SCRIPTS), np.int8)
for _k, _lead in enumerate(SCRIPTS.values()):
    SCRIPT_OF[list(_lead)] = _k


@dataclass(frozen=True)
class Band:
    """Least and most allowed, ends included."""

    chars_per_token: tuple[float, float]
    chars_per_token_2: tuple[float, float]
    byte_share: tuple[float, float]
    evenness: tuple[float, float]


def own_columns() -> list[str]:
    return [x.split()[0] for x in COUNTS.split(", ")] + VERDICT


def counts(documents: DataFrame, pieces: str, ranks: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``documents``, and ``COUNTS``; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(piece_tokens, rank_tokens)
        (first, is_byte), second = piece_tokens(pieces), rank_tokens(ranks)
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column("text")):
                start, end, doc = words(buf, offs)
                n_words = np.bincount(doc, minlength=hi - lo)
                inside = ~SPACE[buf]
                chars = per_doc(inside & ((buf & 0xC0) != 0x80), offs)
                symbols = per_doc(SYMBOLS[buf], offs)
                sums = Sums(buf, EXACT)

                # lines: bounded by \n and documents
                cut = np.flatnonzero(buf == 10)
                l_start = np.sort(np.concatenate([offs[:-1], cut + 1]))
                l_end = np.sort(np.concatenate([cut, offs[1:]]))
                has_word = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
                l_start, l_end = l_start[has_word], l_end[has_word]
                l_doc = np.searchsorted(offs, l_start, side="right") - 1
                dup = repeated(l_doc, sums.spans(l_start, l_end))[1]

                # five-word windows inside one document
                ends_of = np.cumsum(n_words)
                g = grams(sums.spans(start, end), WINDOW)
                at = np.flatnonzero(np.arange(len(g)) + WINDOW <= ends_of[doc[: len(g)]]) if len(g) else np.zeros(0, np.int64)
                twice = repeated(doc[at], g[at])[0]
                in_repeat = covered(len(start), at[twice], WINDOW)

                data = buf.tobytes()
                r1, r2 = first.rows_of(data, start, end), second.rows_of(data, start, end)
                ids = first.tokens(r1)
                t_doc = np.repeat(doc, first.length[r1])
                n_tok = np.bincount(t_doc, minlength=hi - lo)
                n_byte = np.bincount(t_doc[is_byte[ids]], minlength=hi - lo)
                n_tok2 = np.bincount(doc, weights=second.length[r2], minlength=hi - lo).astype(np.int64)
                key = np.sort(t_doc.astype(np.int64) << 32 | ids)
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                c = np.diff(np.append(new, len(key)))
                k_doc = key[new] >> 32
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = c / n_tok[k_doc]
                    h = np.bincount(k_doc, weights=-p * np.log2(p), minlength=hi - lo)
                kind = SCRIPT_OF[buf]
                letters = np.flatnonzero(kind < len(SCRIPTS))
                k_of = np.searchsorted(offs, letters, side="right") - 1
                per = np.bincount(k_of * len(SCRIPTS) + kind[letters], minlength=(hi - lo) * len(SCRIPTS)).reshape(hi - lo, -1)
                script = np.where(per.any(axis=1), SCRIPT_NAMES[per.argmax(axis=1)], None)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in carry), *(pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols, np.bincount(l_doc[dup], minlength=hi - lo), np.bincount(doc[in_repeat], minlength=hi - lo), n_tok, n_byte)),
                        pa.array(h.astype(np.float64)), pa.array(n_tok2), pa.array(script, pa.string()),
                    ],
                    names=[*carry, *(x.split()[0] for x in COUNTS.split(", "))],
                )

    documents = documents.withColumn("text", F.col("text").cast("string"))
    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*carry).schema]
    return documents.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, ", ".join([*carried, COUNTS]))


def measured(counted: DataFrame) -> DataFrame:
    """Adds ``MEASURES`` and ``base_failed``."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    most = F.log2(F.least(F.col("n_tokens"), F.lit(32_000)).cast("double"))
    return counted.withColumns({
        "chars_per_token": ratio("word_chars", "n_tokens"),
        "chars_per_token_2": ratio("word_chars", "n_tokens_2"),
        "byte_share": ratio("n_byte_tokens", "n_tokens"),
        "evenness": F.when(F.col("n_tokens") > 1, F.col("token_entropy") / most),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })


def judged(counted: DataFrame, bands: dict[str, Band]) -> DataFrame:
    """Adds the measures, ``base_failed``, ``band_failed`` and ``kept`` by given bands, which have a ``default``."""
    df = measured(counted)
    slack = F.greatest(F.lit(0.0), 1 - F.col("n_tokens") / FULL_TOKENS)

    def outside(b: Band):
        out = F.lit(False)
        for name in MEASURES:
            low, high = getattr(b, name)
            out = out | ~F.coalesce(F.col(name).between(low * (1 - slack), high * (1 + slack)), F.lit(True))
        return out

    failed = outside(bands["default"])
    for lang, b in bands.items():
        if lang != "default":
            failed = F.when(F.col("lang") == lang, outside(b)).otherwise(failed)
    return df.withColumn("band_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed"))


def label_sample(documents: DataFrame, labels: DataFrame, rows: int | None = None) -> DataFrame:
    """The documents labelled good, all of them unless ``rows`` says how many, which are chosen by the hash of their ids."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = good if rows is None else good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return documents.join(chosen, "doc_id", "left_semi")


def fit_bands(counted: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, script, bands) of a table of counts; one row with nulls is that of all together.

    ``bands`` maps a measure to its line (level, slope over ln tokens) and spread (fixed, per_token).
    """
    rows = measured(counted).filter("not base_failed and n_tokens > 1")
    kinds = F.explode(F.array(F.struct("lang", "script"), F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("script"))))
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES]))
    rows = rows.select("n_tokens", values.alias("x"), "lang", "script").select("n_tokens", "x.*", kinds.alias("kind")).select("measure", "v", "kind", F.ln("n_tokens").alias("u"), (1 / F.col("n_tokens")).alias("r"))
    group = ["kind", "measure"]
    line = rows.groupBy(*group).agg(F.regr_slope("v", "u").alias("slope"), F.avg("v").alias("mean_v"), F.avg("u").alias("mean_u"), F.count("*").alias("n"))
    line = line.select(*group, "n", F.coalesce("slope", F.lit(0.0)).alias("slope"), "mean_v", "mean_u").withColumn("level", F.col("mean_v") - F.col("slope") * F.col("mean_u"))
    line = written(line, "lines")  # a row per kind and measure: Spark broadcasts it, and the rows are not dealt out by kind
    rest = rows.join(line, group).withColumn("e", F.pow(F.col("v") - F.col("level") - F.col("slope") * F.col("u"), 2))
    spread = rest.groupBy(*group, "n", "level", "slope").agg(F.regr_slope("e", "r").alias("per_token"), F.regr_intercept("e", "r").alias("fixed"), F.avg("e").alias("mean_e"))
    falls = F.coalesce(F.col("per_token") > 0, F.lit(False))
    least = F.lit(LEAST_SPREAD**2)
    band = F.struct("level", "slope", F.greatest(F.when(falls, F.col("fixed")).otherwise(F.col("mean_e")), least).alias("fixed"), F.when(falls, F.col("per_token")).otherwise(0.0).alias("per_token"))
    fitted = spread.filter((F.col("n") >= least_rows) | (F.col("kind.lang").isNull() & F.col("kind.script").isNull()))
    return fitted.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("measure", band))).alias("bands")).select("kind.lang", "kind.script", "bands")


def judged_by_fit(counted: DataFrame, fitted: DataFrame, width: float = WIDTH) -> DataFrame:
    """As ``judged``, by fitted bands, a row per language and script; Spark broadcasts them where their size allows."""
    fitted = fitted.withColumnsRenamed({"lang": "fit_lang", "script": "fit_script", "bands": "fit_bands"})
    own = fitted.filter("fit_lang is not null and fit_script is not null")
    common = fitted.filter("fit_lang is null and fit_script is null").select("fit_bands").first()
    df = measured(counted).join(own, (F.col("lang") == F.col("fit_lang")) & (F.col("script") == F.col("fit_script")), "left")
    kind = own.schema["fit_bands"].dataType
    whole = F.lit(None).cast(kind) if common is None else F.from_json(F.lit(json.dumps({k: v.asDict() for k, v in common[0].items()})), kind)
    df = df.withColumn("fit_bands", F.coalesce("fit_bands", whole))
    failed = F.lit(False)
    for m in MEASURES:
        b, n = F.try_element_at("fit_bands", F.lit(m)), F.greatest(F.col("n_tokens"), F.lit(1))
        away = F.abs(F.col(m) - b["level"] - b["slope"] * F.ln(n))
        failed = failed | F.coalesce(away > width * F.sqrt(b["fixed"] + b["per_token"] / n), F.lit(False))
    return df.withColumn("band_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed")).drop("fit_lang", "fit_script", "fit_bands")


def fitted_to(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """Bands from all rows of ``counted`` that are labelled good."""
    return written(fit_bands(label_sample(counted, labels)), "bands")


def kept_documents(documents: DataFrame, bands: dict[str, Band] | DataFrame, pieces: str, ranks: str, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``documents`` that pass given or fitted bands, with their columns as they are. With ``labels``, bands are fitted to these."""
    carry = documents.columns
    held = {c: f"own_{k}" for k, c in enumerate(carry) if c in own_columns()}  # clashing names stand aside meanwhile
    counted = counts(documents.withColumnsRenamed(held), pieces, ranks, [held.get(c, c) for c in carry])
    if labels is not None:
        counted = written(counted, "counted")
        bands = fitted_to(counted.select("doc_id", "lang", *(x.split()[0] for x in COUNTS.split(", "))), labels)
    df = judged(counted, bands) if isinstance(bands, dict) else judged_by_fit(counted, bands)
    return df.filter("kept").select(*[F.col(held.get(c, c)).alias(c) for c in carry])
