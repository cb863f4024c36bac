"""BPE encoding and decoding by forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be merged over, so
a cut between the two is certain. A vocabulary gives a table of the pairs that do stand
inside a token; all other pairs of a text are cuts, and the fragments between them are
encoded each by itself, all fragments of a chunk side by side: a round joins, in every
fragment, its pair of lowest rank. The last byte of a word counts as a symbol of its own,
so that the ends of words are forced boundaries like any other. Fragments of one word put
together give its ids; words already seen are kept, within a bound.

Taken are ``tokenizers`` files of a BPE with word ends whose words never cross ASCII white
space (like ``word_bpe_49k.json``); any other is refused with ValueError. The file's own
normaliser and splitting into words are used; the encoding and decoding are done here.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated
rows are rows of their own; an empty table gives no rows; columns other than doc_id and
text are ignored. Spellings of special tokens become their ids. Texts of any length are
taken whole; a word of any length costs rounds for its different merges only.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.arrays import chunks
from lexigrain.llm.packing import token_rows
from lexigrain.llm.vocab import SIMPLE, Encoded, WordTokens, byte_letters

NEVER = np.iinfo(np.int64).max
#: Words normalised in one call.
JOINED = 512


class ForcedBoundaryBpe:
    """A vocabulary as tables: symbols (a byte, or 256 more for one that ends a word), cuts, merges."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"].get("end_of_word_suffix")
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")]
        if model.get("type") != "BPE" or not self.end or any(odd) or spec.get("decoder") or not self.apart(spec):
            raise ValueError(f"{path}: not a BPE vocabulary with word ends and words that never cross white space")
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters, vocab = byte_letters(), model["vocab"]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters] + [vocab[c + self.end] for c in letters], np.int64)
        self.inside = np.zeros((512, 512), bool)
        for t in vocab:
            s = self.symbols(t)
            self.inside[s[:-1], s[1:]] = True
        self.set_merges([m if isinstance(m, list) else m.split(" ") for m in model["merges"]], vocab)
        spelled = sorted({**vocab, **self.special}.items(), key=lambda x: x[1])
        self.spelling = {i: t.encode() for t, i in spelled}

    @staticmethod
    def apart(spec: dict) -> bool:
        """Does white space only part words: is every run of it made a blank, and no word made of it?"""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        blank = any(s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
        drop = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] for s in cuts)
        return blank and drop and any(s["type"] == "ByteLevel" and not s["add_prefix_space"] for s in cuts)

    def symbols(self, token: str) -> np.ndarray:
        ends = token.endswith(self.end) and token != self.end
        s = np.array([self.byte_of[c] for c in (token[: -len(self.end)] if ends else token)], np.int64)
        if ends:
            s[-1] += 256
        return s

    def set_merges(self, merges: list[list[str]], vocab: dict[str, int]) -> None:
        a, b, to = (np.array(x, np.int64) for x in zip(*[(vocab[x], vocab[y], vocab[x + y]) for x, y in merges], strict=True))
        self.n_ids = max(vocab.values()) + 1
        key = a * self.n_ids + b
        o = np.argsort(key, kind="stable")
        self.keys, self.rank, self.to = key[o], np.arange(len(key))[o], to[o]
        # a token made by a later merge than one that takes it could change the order of joins inside a round
        made = np.full(self.n_ids, -1)
        np.maximum.at(made, to, np.arange(len(to)))
        self.in_order = bool((np.maximum(made[a], made[b]) < np.arange(len(a))).all())

    def ranks(self, ids: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place: rank of its pair with the next one in the fragment, and what the pair becomes."""
        rank, to = np.full(len(ids), NEVER), np.zeros(len(ids), np.int64)
        at = np.flatnonzero(fragment[1:] == fragment[:-1])
        key = ids[at] * self.n_ids + ids[at + 1]
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[where] == key
        rank[at[hit]], to[at[hit]] = self.rank[where[hit]], self.to[where[hit]]
        return rank, to

    def joined(self, ids: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All fragments encoded: ids and the fragment of each, in the order given. ``fragment`` ascends."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank, to = self.ranks(ids, fragment)
            new = np.concatenate([[True], fragment[1:] != fragment[:-1]])
            own = np.cumsum(new) - 1
            least = np.minimum.reduceat(rank, np.flatnonzero(new))[own]
            over = least == NEVER
            done.append((ids[over], fragment[over]))
            take = (rank == least) & ~over
            if self.in_order:
                # of overlapping pairs, as in a a a a, every second one from the left
                place = np.arange(len(ids))
                begins = take & ~np.concatenate([[False], take[:-1]])
                take &= (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
            else:
                seen = np.cumsum(take)
                take &= seen - (seen - take)[np.flatnonzero(new)][own] == 1
            ids = np.where(take, to, ids)
            stay = ~over & ~np.concatenate([[False], take[:-1]])
            ids, fragment = ids[stay], fragment[stay]
        if not done:
            return ids, fragment
        ids, fragment = map(np.concatenate, zip(*done, strict=True))
        o = np.argsort(fragment, kind="stable")
        return ids[o], fragment[o]

    def encode_words(self, units: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Units of whole words (as bytes) to (ids, how many each unit has)."""
        flat = list(chain.from_iterable(units))
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        symbols = np.frombuffer(b"".join(flat), np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        symbols[ends - 1] += 256
        cut = np.ones(len(symbols), bool)
        cut[1:] = ~self.inside[symbols[:-1], symbols[1:]]
        fragment = np.cumsum(cut) - 1
        ids, fragment = self.joined(self.first[symbols], fragment)
        # a fragment lies in one word, a word in one unit
        words_of = np.fromiter(map(len, units), np.int64, len(units))
        unit_of_word = np.repeat(np.arange(len(units)), words_of)
        unit = np.repeat(unit_of_word, lengths)[np.flatnonzero(cut)][fragment]
        return ids, np.bincount(unit, minlength=len(units))

    def split(self, text: str) -> list[bytes]:
        """The words of a text without special tokens, as normalised bytes."""
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def encode(self, ws: list[bytes]) -> Encoded:
        """For ``WordTokens``: new words and their ids."""
        texts = [w.decode("utf-8", "replace") for w in ws]
        units: list[list[bytes]] = [[] for _ in ws]
        plain, special = [], []
        for k, t in enumerate(texts):
            if SIMPLE.fullmatch(t):
                plain.append(k)
            elif self.at_special and self.at_special.search(t):
                special.append(k)
            else:
                units[k] = self.split(t)
        for lo in range(0, len(plain), JOINED):
            part = plain[lo : lo + JOINED]
            for k, w in zip(part, self.normalizer.normalize_str(" ".join(texts[k] for k in part)).split(" "), strict=True):
                units[k] = [w.encode()]
        ids, n = self.encode_words(units)
        if special:
            return self.with_special(ws, texts, special, ids, n)
        return ws, ids.astype(np.int32), n

    def with_special(self, ws: list[bytes], texts: list[str], special: list[int], ids: np.ndarray, n: np.ndarray) -> Encoded:
        own = np.split(ids, np.cumsum(n)[:-1])
        for k in special:
            out, at = [], 0
            for m in self.at_special.finditer(texts[k]):
                out += [self.encode_words([self.split(texts[k][at : m.start()])])[0], [self.special[m[0]]]]
                at = m.end()
            out.append(self.encode_words([self.split(texts[k][at:])])[0])
            own[k] = np.concatenate([np.asarray(x, np.int64) for x in out])
        return ws, np.concatenate(own).astype(np.int32), np.array([len(x) for x in own], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """Spellings with blanks between, unknown ids passed over: such a vocabulary names no other way."""
        return b" ".join([t for t in map(self.spelling.get, ids.tolist()) if t is not None])


@cache
def vocabulary(path: str) -> tuple[ForcedBoundaryBpe, WordTokens]:
    """One of each per Python worker."""
    bpe = ForcedBoundaryBpe(path)
    return bpe, WordTokens(bpe.encode)


def coded(documents: DataFrame, path: str, ids: bool, text: bool) -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian unsigned 32-bit integers, decoded): the last two as asked."""
    schema = "doc_id long, n_tokens long" + ", ids binary" * ids + ", decoded string" * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, tokens = vocabulary(path)
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column("text")):
                rows, n_rows = token_rows(tokens, buf, offs)
                flat = tokens.tokens(rows).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(tokens.length[rows])])[np.cumsum(np.append(0, n_rows))]
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                out = [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(ends))]
                if ids:
                    out.append(pa.array([flat[a:b].tobytes() for a, b in spans], pa.binary()))
                if text:
                    out.append(pa.array([bpe.decode(flat[a:b]).decode() for a, b in spans], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens"] + ["ids"] * ids + ["decoded"] * text)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids binary) per row of ``documents``."""
    return coded(documents, path, ids=True, text=False)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids binary, decoded): every text encoded, and its ids decoded, in one pass."""
    return coded(documents, path, ids=True, text=True)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids) rows as ``encoded`` gives them; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = vocabulary(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x.as_buffer(), "<u4")).decode() if x.is_valid else "" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary")).mapInArrow(run, "doc_id long, decoded string")
