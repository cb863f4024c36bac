"""Word-at-a-time use of public vocabularies, with a bounded memory of words already seen."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from lexigrain.llm.arrays import ranges

#: Words kept in a Python worker's memory (about 75 MB), and bytes of words and ids; beyond that, those seldom used go.
MAX_WORDS, MAX_BYTES = 300_000, 40_000_000

#: Words in an order of the encoder's choice, all their ids, and how many ids each has.
Encoded = tuple[list[bytes], np.ndarray, np.ndarray]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def packed(words: list[bytes], ids: list[list[int]]) -> Encoded:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return words, np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n


class WordTokens:
    """Token ids of words, as arrays. ``encode`` maps new words to ``Encoded``."""

    def __init__(self, encode: Callable[[list[bytes]], Encoded], max_words: int = MAX_WORDS):
        self.encode, self.max_words = encode, max_words
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        #: Of each word, the calls that used it, the one that made room last included.
        self.used = np.zeros(0, np.int32)

    def make_room(self) -> None:
        """Keeps the words that more than one call used, at most half of what may be held: the most used ones."""
        known, size, used = list(self.index), self.length * 4 + np.fromiter(map(len, self.index), np.int64, len(self.index)), self.used
        keep = np.flatnonzero(used > 1)
        keep = keep[np.argsort(-used[keep], kind="stable")][: self.max_words // 2]
        keep = np.sort(keep[np.cumsum(size[keep]) <= MAX_BYTES // 2])
        flat, n = self.tokens(keep), self.length[keep]
        self.reset()
        self.index = {known[k]: i for i, k in enumerate(keep.tolist())}
        self.start, self.length, self.flat, self.held = np.cumsum(n) - n, n, flat, int(size[keep].sum())
        self.used = np.ones(len(keep), np.int32)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The row of each word, new words first encoded. Rows hold until the next call."""
        if len(self.index) > self.max_words or self.held > MAX_BYTES:
            self.make_room()
        fresh = list(set(words).difference(self.index))
        if fresh:
            fresh, flat, n = self.encode(fresh)
            self.held += sum(map(len, fresh)) + flat.nbytes
            at = len(self.index)
            self.index.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
            self.length = np.concatenate([self.length, n])
            self.flat = np.concatenate([self.flat, flat])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int32)])
        out = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        now = np.zeros(len(self.used), bool)
        now[out] = True
        self.used += now
        return out

    def rows_of(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """As ``rows``, for the words data[start:end]: equal ones of up to seven bytes are looked up once."""
        n = end - start
        few = np.flatnonzero(n < 8)
        eight = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(8), np.uint8), 8)[start[few]]
        # the bytes, zeros behind them, and their number
        key = np.ascontiguousarray(eight).view("<u8").ravel() & ((np.uint64(1) << (8 * n[few]).astype(np.uint64)) - np.uint64(1)) | n[few].astype(np.uint64) << np.uint64(56)
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        ask = np.concatenate([few[first], np.flatnonzero(n >= 8)])
        got = self.rows([data[a:b] for a, b in zip(start[ask].tolist(), end[ask].tolist(), strict=True)])
        out = np.empty(len(n), np.int64)
        out[few] = got[: len(first)][of]
        out[n >= 8] = got[len(first) :]
        return out

    def tokens(self, rows: np.ndarray) -> np.ndarray:
        """All ids of these rows, one after the other."""
        return self.flat[ranges(self.start[rows], self.length[rows])]


def piece_encoder(path: str) -> tuple[Callable, np.ndarray]:
    """A sentencepiece model: its word encoder, and which ids are byte fallbacks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
    return lambda ws: packed(ws, sp.encode([w.decode("utf-8", "replace") for w in ws], num_threads=1)), is_byte


def rank_encoder(path: str) -> Callable:
    """A tiktoken rank file: its word encoder."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda ws: packed(ws, [enc.encode_ordinary(w.decode("utf-8", "replace")) for w in ws])


#: Letters that normalisation and pre-tokenising leave whole.
SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Such letters, then marks that make no contraction or special token: two pre-tokens, or one.
PARTS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@[-`{-~]*)")


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte: its own if it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def plain_steps(path: str) -> bool:
    """Does a ``tokenizers`` file lower the case, compose, cut letters from marks, write bytes as letters, and nothing else?"""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps, cuts = ((spec.get(a) or {}).get(b, []) for a, b in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"}
        and [s["type"] for s in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        and cuts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        and all("<" in t["content"] for t in spec["added_tokens"])
    )


def word_bpe_encoder(path: str) -> Callable:
    """A ``tokenizers`` BPE file with word ends whose pre-tokens never cross white space.

    Words of plain letters and marks go to its model at once where its other steps are known
    to only lower the case and part the two; all others one by one through all steps. Both give
    the ids that the whole text would give.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    model, letters, plain = tok.model, dict(enumerate(byte_letters())), plain_steps(path)

    def encode(ws: list[bytes]) -> Encoded:
        done, ids, rest = [], [], []
        for w in ws:
            text = w.decode("utf-8", "replace")
            parts = plain and PARTS.fullmatch(text)
            if not parts:
                rest.append((w, text))
                continue
            out = []
            for part in parts.groups():
                if part:
                    part = part.lower()
                    out += [x.id for x in model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(letters))]
            done.append(w)
            ids.append(out)
        if rest:
            ids += [x.ids for x in tok.encode_batch_fast([t for _, t in rest], add_special_tokens=False)]
        return packed(done + [w for w, _ in rest], ids)

    return encode


# One of each per Python worker, kept from task to task: loading a vocabulary costs more than many tasks.


@cache
def word_bpe_tokens(path: str) -> WordTokens:
    return WordTokens(word_bpe_encoder(path))


@cache
def piece_tokens(path: str) -> tuple[WordTokens, np.ndarray]:
    encode, is_byte = piece_encoder(path)
    return WordTokens(encode, MAX_WORDS // 2), is_byte


@cache
def rank_tokens(path: str) -> WordTokens:
    return WordTokens(rank_encoder(path), MAX_WORDS // 2)


LOADERS = (word_bpe_tokens, piece_tokens, rank_tokens)


def only(*used: Callable) -> None:
    """Gives back the memory of all vocabularies but those of the loaders ``used``: a Python worker serves one operator after another."""
    others = [f for f in LOADERS if f not in used and f.cache_info().currsize]
    for f in others:
        f.cache_clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
            trim(0)
