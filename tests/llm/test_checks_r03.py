"""What the check tool's findings of round 3 were about."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lexigrain.llm import line_dedup, ngram_join, vocab
from lexigrain.llm.arrays import chunks, words
from lexigrain.llm.packing import token_rows
from tests.llm.test_operators import frame

WORD_BPE = "word_bpe_49k.json"


def test_words_in_use_outlive_a_full_memory():
    """Words that come again and again are encoded once, however many seldom ones pass by; ids stay right."""
    asked: list[bytes] = []

    def encode(ws):
        asked.extend(ws)
        return vocab.packed(ws, [list(w) for w in ws])

    tokens = vocab.WordTokens(encode, max_words=100)
    often = [b"w%d" % k for k in range(30)]
    for k in range(40):
        ws = often + [b"once%d-%d" % (k, i) for i in range(20)]
        got = tokens.tokens(tokens.rows(ws))
        assert got.tobytes() == np.array([c for w in ws for c in w], np.int32).tobytes()
        assert len(tokens.index) <= 100 + len(ws)
    assert all(asked.count(w) == 1 for w in often)


def test_rows_of_spans_tell_all_words_apart():
    text = b"a a\x00 \x00a ab abcdefg abcdefgh abcdefgh abcdefg\x00 \xc3\xa9 \xc3 a ab"
    start, end, _ = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    tokens = vocab.WordTokens(lambda ws: vocab.packed(ws, [list(w) for w in ws]))
    assert bytes(tokens.tokens(tokens.rows_of(text, start, end)).astype(np.uint8)) == text.replace(b" ", b"")
    assert not len(tokens.rows_of(b"", start[:0], end[:0]))


def test_words_in_parts_have_the_ids_of_the_whole_text():
    """Accents, capitals, marks behind letters, contractions and special tokens, by ``tokenizers`` itself."""
    from tokenizers import Tokenizer

    path = vocab.vocabulary_path(WORD_BPE)
    whole = Tokenizer.from_file(path)
    texts = [
        "Réré, ÉÀ. été&&& ai%%% ×, ÷. aß. ÿ, x$,. don't DON'T, it's. 'll 's, a's&", "<|endoftext|> A,b. x<|endoftext|>y |> <| >, <,",
        "é, à. İ, K. ſ, ﬁ, ٣, 12, 日本, a​, ́,", "... ,. , . ,, a,, é.. é,. c3\u0097, ·,", "", "a" * 300 + ", " + "é" * 200 + ".",
    ]
    tokens = vocab.WordTokens(vocab.word_bpe_encoder(path))
    for lo, hi, buf, offs in chunks(pa.array(texts), limit=1):
        rows, _ = token_rows(tokens, buf, offs)
        assert hi == lo + 1 and tokens.tokens(rows).tolist() == whole.encode(texts[lo], add_special_tokens=False).ids


def test_another_operator_gives_the_vocabulary_back():
    vocab.word_bpe_tokens(vocab.vocabulary_path(WORD_BPE))
    vocab.only(vocab.word_bpe_tokens)
    assert vocab.word_bpe_tokens.cache_info().currsize
    vocab.only(vocab.piece_tokens, vocab.rank_tokens)
    assert not vocab.word_bpe_tokens.cache_info().currsize


def test_the_bit_field_of_members_needs_no_python_beside_the_sets(spark):
    """A task of the n-gram join runs one Python worker, and members all pass."""
    docs = frame(spark, [(k, f"word{k} and more", "en", "s", 1) for k in range(500)])
    got = ngram_join.only_marked(docs, docs.filter("doc_id % 50 = 7"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and got.columns == docs.columns
    left = [x.doc_id for x in got.collect()]
    assert len(left) == len(set(left)) < 250 and {k for k in range(500) if k % 50 == 7} <= set(left)


def test_a_text_is_split_once_not_once_a_line(spark):
    """What is left of a text is put together from lines that were cut once a row; the bounds of rows of one doc_id hold."""
    rows = [(1, "a line that stands here twice\nown one", "en", "s", 1), (2, "\n".join([*(f"{chr(97 + k % 26) * 9} {k}" for k in range(40)), "a line that stands here twice", ""]), "en", "s", 1), (2, None, "en", "s", 1), (None, "a line that stands here twice", "en", "s", 1)]
    got = line_dedup.remove_lines(frame(spark, rows))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and not re.search(r"lambdafunction\([^\n]{0,40}split\(", plan)
    out = {(x.doc_id, x.text is None): x for x in got.collect()}
    assert out[2, False].text == rows[1][1].replace("\na line that stands here twice", "") and (out[2, False].n_lines, out[2, False].n_removed_lines) == (42, 1)
    assert out[1, False].text == rows[0][1] and out[None, False].text == rows[3][1] and out[2, True].n_removed_lines == 0


def test_only_lines_that_meet_others_are_joined_with_their_texts(spark, monkeypatch):
    """The bit field keeps the texts of lines that meet none out of the shuffle, and loses no line that meets one."""
    counts = []

    def marked(lines, ends, by):
        out = ngram_join.only_marked(lines, ends, by)
        counts.append((lines.count(), out.count(), ends.distinct().count()))
        return out

    monkeypatch.setattr(line_dedup, "only_marked", marked)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    lines = [" ".join(word() for _ in range(12)) for _ in range(400)]
    near = [lines[k].rsplit(" ", 1)[0] + " " + word() for k in range(10)]
    got = line_dedup.remove_lines(frame(spark, [(1, "\n".join(lines), "en", "s", 1), (2, "\n".join(near), "en", "s", 1)]))
    out = {x.doc_id: (x.text, x.n_removed_lines) for x in got.collect()}
    assert out == {1: ("\n".join(lines), 0), 2: ("", 10)}
    (every, joined, meeting), = counts
    assert every == 410 and 20 <= meeting <= joined < every / 2


def test_edit_distances_hold_at_their_bound():
    """Distances along the diagonals that the bound allows: right up to the bound, and more than it beyond."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        a = "".join(rng.choice(list("abé€😀"), rng.integers(1, 90)))
        b = list(a)
        for _ in range(rng.integers(0, 1 + len(a) // 2)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 3))] = list(rng.choice(list("abé€😀"), rng.integers(0, 3)))
        b = "".join(b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        d = row[-1]
        for most in range(max(0, d - 3), d + 3):
            got = line_dedup.edit_distance(a, b, most)
            assert got == d if d <= most else got > most
        assert line_dedup.similar([(a, b)], 80)[0] == (100 * d <= 20 * max(len(a), len(b)))


def test_tokens_in_common_are_weighed_for_many_pairs():
    """``shared`` counts a token as often as both lines have it, by its bytes."""
    rng = np.random.default_rng(11)
    texts = [b" ".join(rng.choice([b"a", b"bc", b"def", b"ghij"], rng.integers(8, 30)).tolist()) for _ in range(40)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    want = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = (Counter(texts[k].split()) for k in (a, b))
        size = lambda c: sum(len(w) * n for w, n in c.items())
        few = min(x.total(), y.total()) <= line_dedup.SHORT
        want.append(few or 100 * size(x & y) >= 70 * max(size(x), size(y)))
    assert line_dedup.Tokens(texts).shared(i, j, 70).tolist() == want and 0 < sum(want) < len(want)


def test_texts_of_lines_are_normal_ones():
    docs = ["One  TWO\t3, four\n\n .,é\v5 6\r", "", "!a!\x0cB-c 789"]
    data = [t.encode() for t in docs]
    x = line_dedup.Lines(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 1)
    want = [n for t in data for line in t.split(b"\n") if (n := line_dedup.normal(line))]
    assert x.texts(np.arange(len(x.judged))) == want == [b"one two 0 four", "é 0 0".encode(), b"a bc 000"]
