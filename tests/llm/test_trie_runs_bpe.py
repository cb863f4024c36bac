"""Prefix tries, periodic runs and BPE against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrain.llm import bpe, periodic_runs, prefix_trie
from lexigrain.llm.vocab import WordTokens, vocabulary_path

# prefix trie


def brute_trie(rows, group=5, heads=9):
    by = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in by.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - int(math.fmod(c, group)), [])[:h] + v[h:]
    nodes, kids, total = {}, {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = [total[x] for x in kids.get(k, [])]
        saved = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        total[k] = (sum(x for x, _ in below) or 1, saved + sum(x for _, x in below))
    out = {}
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out[min(m), len(k)] = (min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *total[k], hashlib.sha256(ends.encode()).hexdigest())
    return out


def conversations(seed):
    r, rows = random.Random(seed), []
    for c in r.sample(range(-20, 120), 45):
        for t in range(r.choice([1, 1, 2, 3, 8, 30])):
            rows.append((c, r.choice([None, t, t]), r.choice(["user", "a", None]), r.choice(["x", "y", "é" * 3, None, "", "long"]), c))
    for c in range(300, 330):  # copies
        rows += [(c, t, "user", f"same {t}", c) for t in range(r.choice([3, 5, 12]))]
    rows += [(None, 1, "a", "b", 0), rows[0], rows[0]]
    return r.sample(rows, len(rows))


def trie(spark, rows, few):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long").repartition(3)
    out = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.numbered(df)), few).collect()
    assert len({(r.conv_id, r.depth) for r in out}) == len(out)
    return {(r.conv_id, r.depth): tuple(r)[2:] for r in out}


@pytest.mark.parametrize("few", [4, 4096])
def test_trie(spark, few):
    rows = conversations(few)
    assert trie(spark, rows, few) == brute_trie(rows)


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(c, t, "u", f"t{t}", 0) for c, n in ((1, 120), (2, 300), (7, 2)) for t in range(n)]
    assert trie(spark, rows, 32) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie(spark, [], 4) == trie(spark, [(None, 1, "a", "b", 0)], 4) == {}


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=60), st.lists(st.integers(0, 5), min_size=60, max_size=60))
@settings(max_examples=200, deadline=None)
def test_components_are_split_to_their_totals(picks, values):
    """Random trees: the parent of node k is one of the nodes before it."""
    n = len(picks)
    parent = np.array([-1] + [p % k for k, p in enumerate(picks[1:], 1)])
    own = np.array(values[:n])
    want, weight = own.copy(), np.ones(n, np.int64)
    for k in range(n - 1, 0, -1):
        want[parent[k]] += want[k]
        weight[parent[k]] += weight[k]
    got = prefix_trie.component_totals(parent, weight, own[:, None], np.zeros((n, 1), np.int64))
    assert got[:, 0].tolist() == want.tolist()


# periodic runs


def brute_runs(w, least=12):
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            s = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - s >= max(least - q, q):
                found.append((s - q, i - s + q, q))
            i += i == s
    kept = []
    for s, n, q in found:  # periods ascend
        if not any(a <= s and a + b >= s + n and c < q for a, b, c in kept):
            kept.append((s, n, q))
    return sorted(kept, key=lambda x: (x[0], x[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed, n):
    r, out = random.Random(seed), []
    for _ in range(n):
        v = "abc"[: r.randint(1, 3)]
        root = r.choices(v, k=r.randint(1, 20))
        kind = r.randrange(5)
        if kind == 0:
            w = r.choices(v, k=r.randint(0, 60))
        elif kind == 1:
            w = (root * 20)[: r.randint(2, 200)]
            w[r.randrange(len(w))] = "d"
        elif kind == 2:
            a = ["a"] * r.randint(1, 40) + ["b"] + ["a", "b"] * r.randint(0, 20)
            w = a * r.randint(1, 5) + root + a * r.randint(1, 4)
        elif kind == 3:
            f = ["a", "ab"]
            for _ in range(9):
                f.append(f[-1] + f[-2])
            w = list(f[-1][r.randint(0, 20) :][: r.randint(1, 150)])
        else:
            w = sum(([*root, *r.choices("xyz", k=r.randint(0, 1))] for _ in range(r.randint(1, 8))), [])
        out.append(w)
    return out


@pytest.mark.parametrize("least", [12, 4, 20])
def test_runs(spark, least):
    ws = texts(least, 1500)
    df = spark.createDataFrame([(k, "\n ".join(w), "x") for k, w in enumerate(ws)], "doc_id long, text string, runs string").repartition(3)
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df, least).collect()}
    for k, w in enumerate(ws):
        runs = brute_runs(w, least)
        assert got[k] == (runs, collapsed(w, runs)), " ".join(w)


def test_runs_of_long_and_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a " * 30), (4, "a " * 30), (4, "a " * 30), (5, "a b " * 60_000), (6, ("a " * 100 + "b ") * 500), (7, " ".join(f"{k % 20} " + "sep" * (k % 20 == 19) for k in range(40_000)))]
    out = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs][-1:], len(r.runs), len(r.collapsed.split())) for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert out[:6] == [(0, [(0, 30, 1)], 1, 1), (1, [], 0, 0), (2, [], 0, 0), (3, [], 0, 0), (4, [(0, 30, 1)], 1, 1), (4, [(0, 30, 1)], 1, 1)]
    assert out[6] == (5, [(0, 120_000, 2)], 1, 2) and out[7][2] == 501 and out[8] == (7, [(0, 42_000, 21)], 1, 21)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), 5)


def test_planted_repeats(spark):
    r = random.Random(2)
    rows = [(k, " \n".join(r.choices("abcdefgh", k=r.choice([0, 1, 2, 5, 40, 300])))) for k in range(-5, 200)] + [(10, None), (None, "a b")]
    for doc_id, old, new in [(k, t, x.text) for (k, t), x in zip(rows, periodic_runs.with_planted_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect(), strict=True)]:
        w = (old or "").split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        assert (new or "").split() == w


# BPE

PATH = vocabulary_path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


ODD = [
    None, "", " \n", "Hello  World's 123 <|endoftext|>x <|ENDOFTEXT|>", "naïve　\xa0x ́a é", "don'T<|startoftext|>A", "İI ΑΣ ΑΣ.", "a\x00b\x85c d", "日本語 ascii_under 12345", "a" * 5001, "ab" * 3000,
    "<|endoftext|><|startoftext|>", "😀😀 it's we'Ll ½²", "� äb", "zxzxqj,. a,b. C, D.", "aaaaaa aaaaa aaaa </w>", "Ġ Ä ÿ",
]


def random_texts(seed, n):
    r = random.Random(seed)
    letters = ["a", "a", "b", "c", "e", "Z", "É", "é", "ß", "Σ", " ", "'s", "'ll", "<|endoftext|>", ",", ".", "!", "1", "२", "日", "́", "̈", "\n", "\x85", "　", "😀", "ing", "tion"]
    return ["".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(n)]


def test_bpe_round_trip(spark):
    ts = [*ODD, ODD[3], *random_texts(1, 1500)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(ts)], "doc_id long, text string, ids long").repartition(3)
    t = library()
    codes = bpe.encoded(df, PATH)
    back = {r.doc_id: r.decoded for r in bpe.decoded(codes, PATH).collect()}
    got = {r.doc_id: r for r in bpe.round_trip(df, PATH).collect()}
    for k, x in enumerate(ts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].n_tokens == len(ids), x
        assert got[k].decoded == back[k] == t.decode(ids, skip_special_tokens=False), x
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_bpe_order_of_joins():
    """One join at a time gives what whole rounds give, and cuts stand inside no token."""
    whole, single = bpe.ForcedBoundaryBpe(PATH), bpe.ForcedBoundaryBpe(PATH)
    assert whole.in_order and not whole.inside.all()
    single.in_order = False
    ws = sorted({w.encode() for t in random_texts(2, 300) for w in re.findall(r"[^\x20\x09-\x0D]+", t)} | {b"aaaaaaa", b"abababa"})
    a, b = WordTokens(whole.encode), WordTokens(single.encode)
    assert a.tokens(a.rows(ws)).tolist() == b.tokens(b.rows(ws)).tolist()
    inside = [s for t in list(whole.spelling.values())[:49_000] for s in [whole.symbols(t.decode())]]
    assert all(whole.inside[s[:-1], s[1:]].all() for s in inside)


def test_bpe_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        bpe.ForcedBoundaryBpe(vocabulary_path("byte_bpe_50k.json"))
