"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeats, long texts and clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import decontam, line_dedup, ngram_join, packing, pii, quality, substring_dedup, suffix_dedup, token_counts, url_filters
from lexigrain.llm.arrays import U, Sums, mix
from lexigrain.llm.components import connected_components
from lexigrain.llm.queries import BANDS, URL_RULES
from lexigrain.llm.vocab import vocabulary_path

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Random texts with copies, near copies, shared passages, odd rows."""
    r = random.Random(seed)
    words = ["the", "of", "a", "é", "naïve", *["".join(r.choices("abcdeft", k=r.randint(2, 7))) for _ in range(400)]]
    make = lambda k: " ".join(r.choices(words, k=k))
    passage, texts = make(90), []
    for _ in range(n):
        kind = r.random()
        if kind < 0.15 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.45 and texts:
            w = (r.choice(texts) or "x").split(" ")
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.6:
            texts.append(make(r.randint(0, 40)) + "\n" + passage + ".\n" + make(r.randint(0, 40)))
        else:
            texts.append("\n".join(make(r.randint(1, 30)) for _ in range(r.randint(1, 6))))
    texts += [None, "", "   \n\t", "one", "one two", "x " * 400, "ab" * 700, " lone　unicode blanks ", make(12_000)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[5]]  # repeated rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def words(t):
    return SPACES.findall(t or "")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# 1


def brute_components(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words(lower(t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i)) for i, *_ in rows)


@pytest.mark.parametrize("n,percent,block", [(3, 90, 4000), (5, 80, 4000), (3, 70, 3)])
def test_ngram_join(spark, n, percent, block):
    rows = corpus(1)
    df = frame(spark, rows)
    assert got(ngram_join.jaccard_components(df, n, percent, block), "doc_id", "n_shingles", "component_id") == brute_components(rows, n, percent)


def test_ngram_join_edges(spark):
    assert ngram_join.jaccard_components(frame(spark, corpus(1)).limit(0), 3, 90).count() == 0
    rows = [(None, "a b c d", "en", "s", 1), (5, "a b c d", "en", "s", 1), (6, None, "en", "s", 1)]
    assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows), 3, 90).collect()} == {(None, 5), (5, 5), (6, 6)}


@pytest.mark.parametrize(("n", "percent", "size"), [(3, 90, 9), (5, 80, 4)])
def test_ngram_join_at_the_threshold(spark, n, percent, size):
    """Sets of ``size`` shingles and supersets of one more, similar by just ``percent``."""
    rows = [(2 * k + j, " ".join(f"w{k}x{i}" for i in range(size + n - 1 + j)), "en", "s", 1) for k in range(3) for j in range(2)]
    out = got(ngram_join.jaccard_components(frame(spark, rows), n, percent), "doc_id", "n_shingles", "component_id")
    assert out == brute_components(rows, n, percent) == [(2 * k + j, size + j, 2 * k) for k in range(3) for j in range(2)]


@pytest.mark.parametrize("percent", [50, 60, 75, 80, 90, 95])
def test_no_link_of_short_sets_is_lost(spark, percent):
    """Pairs of sets of up to 12 shingles (one word each) of every size and overlap, the same common words apart from the pair's own."""
    rows, want = [], []
    for a in range(1, 13):
        for b in range(a, 13):
            for o in range(0, a + 1):
                k = len(rows)
                w = lambda x, y: [f"{x}{k}w{i}" for i in range(y)]  # noqa: B023, E731
                both = w("b", max(0, o - 1)) + ["common"] * (o > 0)
                rows += [(k, " ".join(both + w("l", a - o)), "en", "s", 1), (k + 1, " ".join(both + w("r", b - o)), "en", "s", 1)]
                # links through the common word alone join other pairs, too: those are for the brute force
                want.append((k, 100 * o >= percent * (a + b - o)))
    out = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(frame(spark, rows), 1, percent).collect()}
    assert [(k, out[k] == out[k + 1]) for k, linked in want if linked] == [(k, True) for k, linked in want if linked]
    assert len({out[k] for k in out}) > 100


def test_many_small_pairs_at_the_threshold(spark):
    """8 and 9 words, four of five shingles in common: of such pairs parts alone lose some in ten thousand."""
    rows = []
    for k in range(4000):
        w = [f"p{k}w{i}" for i in range(9)]
        rows += [(2 * k, " ".join(w[:8]), "en", "s", 1), (2 * k + 1, " ".join(w), "en", "s", 1)]
    out = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(frame(spark, rows), 5, 80).collect()}
    assert all(out[2 * k + 1] == 2 * k for k in range(4000))


def test_divide_skip_is_exact():
    r = np.random.default_rng(7)
    base = r.integers(0, 2**63, 60).astype(U)
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(20, 60), replace=False), r.integers(0, 2**63, r.integers(1, 8)).astype(U)])) for _ in range(40)]
    for percent in (50, 80, 90):
        label = np.arange(40)
        ngram_join.links(sets, percent, np.arange(40), np.arange(40), label)
        want = np.arange(40)
        for a, b in itertools.combinations(range(40), 2):
            k = len(np.intersect1d(sets[a], sets[b]))
            if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                want[want == want[b]] = want[a]
        assert len(set(zip(label.tolist(), want.tolist(), strict=True))) == len(set(label.tolist())) == len(set(want.tolist()))


@pytest.mark.parametrize("few", [0, 5, 1_000_000])
def test_components(spark, few):
    edges = [(1, 2), (2, 3), (10, 11), (7, 7), *((100 + k, 101 + k) for k in range(40)), (None, 4), (2, 1), (1, 3)]
    out = dict(got(connected_components(spark.createDataFrame(edges, "a long, b long"), few), "node", "component"))
    assert out[3] == 1 and out[11] == 10 and out[7] == 7 and {out[k] for k in range(100, 141)} == {100} and 4 not in out
    assert connected_components(spark.createDataFrame([], "a long, b long"), few).count() == 0


# 2


def brute_quality(t):
    w = words(t)
    text = t or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_quality(spark):
    import sentencepiece

    rows = [*corpus(2), (900, "# a|b <x>\nsame line\nsame line\n\n", "de", "s", 1), (901, "漢字 \U0001f600 " * 40, None, "s", 1)]
    p, q = vocabulary_path("piece_bpe_32k.model"), vocabulary_path("byte_bpe_multi_50k.tiktoken")
    out = quality.judged(quality.counts(frame(spark, rows), p, q, ["doc_id", "lang"]), BANDS)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got(out, "doc_id", *names) == sorted((i, *brute_quality(t)) for i, t, *_ in rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=p)
    by = {r.doc_id: r for r in out.collect()}
    for i, t, *_ in rows:
        ids = [x for w in words(t) for x in sp.encode(w)]
        c = Counter(ids)
        h = -sum(v / len(ids) * np.log2(v / len(ids)) for v in c.values()) if ids else 0
        r = by[i]
        assert (r.n_tokens, r.n_byte_tokens) == (len(ids), sum(sp.is_byte(x) for x in ids)) and abs(r.token_entropy - h) < 1e-9
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert by[901].byte_share > 0.3 and not by[901].kept


def test_kept_documents_keep_their_columns(spark):
    rows = [(1, "plain words " + " ".join(f"w{k}x" for k in range(30)), "en", "s", 7), (2, None, None, None, None)]
    df = frame(spark, rows).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1))
    p, q = vocabulary_path("piece_bpe_32k.model"), vocabulary_path("byte_bpe_multi_50k.tiktoken")
    out = quality.kept_documents(df, {"default": BANDS["default"]}, p, q)
    assert out.columns == df.columns and [(r.doc_id, r.kept, r.n_words) for r in out.collect()] == [(1, "mine", -1)]


def test_fitted_bands(spark):
    """Lines and spreads against numpy; prose held out is kept, marks and mixed letters are not; no sample rejects nothing."""
    r = random.Random(12)
    syllables = ["ra", "ne", "to", "lis", "mo", "ver", "da", "chi", "pol", "us"]
    prose = lambda k: " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(k))
    junk = lambda k: " ".join("".join(r.choices("xzqjk#$%{}0123456789", k=r.randint(2, 9))) for _ in range(k))
    rows = [(k, prose(r.randint(15, 300)), "la", "s", 1) for k in range(120)] + [(200 + k, junk(r.randint(40, 200)), "la", "s", 1) for k in range(20)] + [(300, "где мы были вчера вечером когда шёл дождь и все спали", "ru", "s", 1), (301, None, None, None, None), (302, "", "la", "s", 0), (303, prose(30), "xx", "s", 1)]
    labels = spark.createDataFrame([(k, 1) for k in range(100)] + [(k, 0) for k in range(200, 205)] + [(None, 1), (5, 1)], "doc_id long, quality int")
    docs = frame(spark, rows)
    p, q = vocabulary_path("piece_bpe_32k.model"), vocabulary_path("byte_bpe_multi_50k.tiktoken")
    count = lambda df: quality.counts(df, p, q, ["doc_id", "lang"])
    sample = quality.label_sample(docs, labels)
    assert sorted(x.doc_id for x in sample.collect()) == list(range(100)) and quality.label_sample(docs, labels, 7).count() == 7
    fitted = quality.fit_bands(count(sample))
    got_ = {(x.lang, x.script): x.bands for x in fitted.collect()}
    assert set(got_) == {("la", "Latin"), (None, None)}
    used = [x for x in quality.measured(count(sample)).collect() if not x.base_failed]
    n = np.array([x.n_tokens for x in used], float)
    for m in quality.MEASURES:
        v = np.array([x[m] for x in used])
        slope, level = np.polyfit(np.log(n), v, 1)
        e = (v - level - slope * np.log(n)) ** 2
        per, fixed = np.polyfit(1 / n, e, 1)
        want = (max(fixed, quality.LEAST_SPREAD**2), per) if per > 1e-12 else (max(e.mean(), quality.LEAST_SPREAD**2), 0)
        b = got_["la", "Latin"][m]
        assert np.allclose((b.level, b.slope, b.fixed, b.per_token), (level, slope, *want), atol=1e-6)
    out = {x.doc_id: x for x in quality.judged_by_fit(count(docs), fitted).collect()}
    good, bad = [out[k] for k in range(100, 120)], [out[k] for k in range(200, 220)]
    assert sum(x.band_failed for x in good) <= 1 and sum(x.band_failed for x in bad) >= 19
    assert out[300].script == "Cyrillic" and out[301].script is None and not out[301].kept and not out[302].kept and out[303].kept
    none = quality.fit_bands(count(docs.limit(0)))
    assert not any(x.band_failed for x in quality.judged_by_fit(count(docs), none).collect())
    assert quality.judged_by_fit(count(docs.limit(0)), fitted).count() == 0


# 3


def brute_bytes(rows, n):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    c = Counter(b[k : k + n] for _, b in data for k in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if c[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("n,width,rows_per_slice", [(400, 128, 16_000), (60, 24, 7), (40, 16, 16_000)])
def test_suffix_dedup(spark, monkeypatch, n, width, rows_per_slice):
    monkeypatch.setattr(suffix_dedup, "SLICE_ROWS", rows_per_slice)
    rows = [r for r in corpus(3) if len(r[1] or "") < 20_000]
    out = suffix_dedup.remove_repeats(frame(spark, rows), n, width)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, n)


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.remove_repeats(frame(spark, corpus(3)).limit(0)).count() == 0
    # the contract judges every document, one without an id too
    assert [r.n_removed for r in suffix_dedup.remove_repeats(frame(spark, [(None, "abc" * 300, None, None, None)])).collect()] == [900]


def test_suffix_dedup_judges_rows_without_an_id(spark):
    """Each is a document: it matches others, with an id or without, and repeated rows match each other."""
    r = random.Random(4)
    a, b = ("".join(r.choices("abcdefgh ", k=900)) for _ in range(2))
    rows = [(None, a, "en", "s", 1), (7, "x" + a[:500], "en", "s", 1), (None, b, "en", "s", 1), (None, b, "en", "s", 1), (None, None, "en", "s", 1), (8, "abc", "en", "s", 1), (8, "y" * 399, "en", "s", 1)]
    out = suffix_dedup.remove_repeats(frame(spark, rows).withColumn("own_id", F.lit("mine")))
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed) for x in out.collect()) == [("7", 501, 500), ("8", 3, 0), ("8", 399, 0), ("None", 0, 0), ("None", 900, 500), ("None", 900, 900), ("None", 900, 900)]


def test_multikey_sort():
    r = np.random.default_rng(1)
    keys = r.integers(0, 3, (3000, 5)).astype(U)
    assert keys[suffix_dedup.multikey_sort(keys)].tolist() == sorted(keys.tolist())


# 4


def brute_lines(rows, bits, percent):
    rows = [r for r in rows if r[0] is not None]
    occ = [(i, k, line_dedup.normal(x)) for i, t, *_ in rows if t is not None for k, x in enumerate(t.encode().split(b"\n"))]
    occ = [o for o in occ if len(o[2].split()) >= 5]
    names = sorted({o[2] for o in occ})
    sims = []
    for n in names:
        w = sorted(set(n.split()))
        b = np.frombuffer(b" ".join(w), np.uint8)
        starts = np.cumsum([0, *[len(x) + 1 for x in w[:-1]]])
        h = mix(Sums(b, line_dedup.TABLE).spans(starts, starts + np.array([len(x) for x in w])) ^ U(0x1B873593CC9E2D51)).tolist()
        sims.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(w)))
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    for i, j in itertools.combinations(range(len(names)), 2):
        if (sims[i] ^ sims[j]).bit_count() <= bits:
            a, b = names[i].decode(), names[j].decode()
            if 100 * distance(a, b) <= (100 - percent) * max(len(a), len(b)):
                parent[root(names[i])] = root(names[j])
    first = {}
    for i, k, n in sorted(occ):
        first.setdefault(root(n), (i, k))
    gone = {(i, k) for i, k, n in occ if first[root(n)] != (i, k)}
    return sorted((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t, *_ in rows if t is not None)


@pytest.mark.parametrize("bits", [3, 9])
def test_line_dedup(spark, bits):
    rows = [r for r in corpus(4, 40) if len(r[1] or "") < 3000]
    many = " ".join(f"v{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600))
    rows = list(dict.fromkeys(rows)) + [(698, many, "en", "s", 1), (699, many + " tail", "en", "s", 1), (700, "first new line of text here\n\nfirst new line, of TEXT here 1", "en", "s", 1)]
    out = line_dedup.remove_lines(frame(spark, rows).withColumn("n_lines", F.lit("clash")), bits=bits)
    assert got(out.filter("text is not null"), "doc_id", "text") == brute_lines(rows, bits, 80)
    assert out.filter("text is null").count() == 1 and "source" in out.columns


def test_line_dedup_edges(spark):
    rows = [(1, "the same five word line", "a", "b", 1), (1, "the same five word line", "a", "b", 1), (None, "the same five word line", "a", "b", 1), (2, "the same five word line", "a", "b", 1)]
    out = line_dedup.remove_lines(frame(spark, rows))
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", "the same five word line")] * 2 + [("2", "")] + [("None", "the same five word line")]
    assert line_dedup.remove_lines(frame(spark, rows).limit(0)).count() == 0
    assert line_dedup.block_count(1000, 3) == 4 < line_dedup.block_count(10**9, 3) < line_dedup.block_count(10**13, 3) + 1


def test_line_dedup_finds_similar_lines(spark):
    """Recall of the search against edit similarity alone: a brute force with all 64 SimHash bits allowed."""
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(3000)]
    lines, rows = [r.choices(words, k=k) for k in (8, 10, 12, 20) for _ in range(5)], []
    for k, w in enumerate(lines):
        one, typo, more, at = list(w), list(w), list(w), r.randrange(1, len(w))
        one[at] = r.choice(words)
        typo[at] = typo[at][:-1] + "ы"
        more.insert(at, "news")
        rows += [(10 * k + j, " ".join(x), "en", "s", 1) for j, x in enumerate((w, one, typo, more))]
    out = got(line_dedup.remove_lines(frame(spark, rows)), "doc_id", "text")
    want = brute_lines(rows, 64, 80)
    gone = lambda x: {i for i, t in x if t == ""}
    assert gone(out) <= gone(want) and len(gone(want)) >= 57
    assert len(gone(out)) >= 0.95 * len(gone(want))


def test_line_dedup_short_lines_and_names_of_columns(spark):
    """Lines of any length are judged with ``min_words=1``; input columns called like inner ones stay."""
    rows = [(1, "yes\nno\n\n--\nwe gather here now"), (2, "Yes.\nnot\n漢字漢字漢字漢字漢字漢字漢字\nwe gathered here now"), (3, "漢字漢字漢字漢字漢字漢字漢\nab\nabsolute"), (4, "absolutes\nabsolved")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"places": F.lit(1), "line": F.lit("x"), "c0": F.lit("y"), "mark": F.lit(2), "cluster": F.lit(3)})
    out = line_dedup.remove_lines(df, min_words=1)
    assert out.columns == [*df.columns, "n_lines", "n_removed_lines"]
    assert got(out, "doc_id", "text", "n_lines", "places", "line", "c0") == [
        (1, "yes\nno\n\n--\nwe gather here now", 5, 1, "x", "y"), (2, "not\n漢字漢字漢字漢字漢字漢字漢字", 4, 1, "x", "y"), (3, "ab\nabsolute", 3, 1, "x", "y"), (4, "absolved", 2, 1, "x", "y"),
    ]


@pytest.mark.parametrize("block", [4000, 4])
def test_line_dedup_of_one_large_group(spark, monkeypatch, block):
    """One group of near copies, whole or cut into blocks: all are linked with one another."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    r = random.Random(5)
    base = ["".join(r.choices("abcdefghij", k=6)) for _ in range(30)]
    rows = []
    for k in range(40):
        w = list(base)
        for i in r.sample(range(30), 2):
            w[i] = "".join(r.choices("klmnop", k=6))
        rows.append((k, " ".join(w) + f"\nown line {k} " + " ".join("".join(r.choices("qrstuvwxyz", k=7)) for _ in range(12)), "en", "s", 1))
    out = line_dedup.remove_lines(frame(spark, rows))
    assert [r.n_removed_lines for r in out.orderBy("doc_id").collect()] == [0] + [1] * 39


def test_rows_of_a_hot_key_need_little_memory():
    """Fifty thousand rows with one SimHash under one key, and keys of many unlike rows."""
    import tracemalloc

    r = np.random.default_rng(3)
    n = 50_000
    key = np.sort(np.concatenate([np.zeros(n, np.int64), r.integers(1, 200, 20_000)]))
    sim = np.where(key == 0, U(7), r.integers(0, 2**63, len(key)).astype(U))
    meets = line_dedup.Meets(sim, np.zeros(len(key), U), np.full(len(key), 100), np.zeros(len(key), bool), 14, 80)
    tracemalloc.start()
    to = line_dedup.joined_under_keys(key, sim, meets)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert len(set(to[:n].tolist())) == 1 and len(set(to[n:].tolist())) > 0.9 * 20_000


def test_edit_distance():
    r = random.Random(2)
    for _ in range(400):
        a, b = ("".join(r.choices("abé漢", k=r.randint(0, 90))) for _ in range(2))
        if r.random() < 0.5:
            b = a[:20] + r.choice("xyz") + a[25:]
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        assert line_dedup.edit_distance(a, b, 1000) == p[-1]
        assert (line_dedup.edit_distance(a, b, 8) > 8) == (p[-1] > 8)
    # many at a time give the same
    texts = ["".join(r.choices("abcdé漢", k=k)) for k in (0, 1, 2, 63, 64, 65, 127, 128, 129, 300, 1025, 1100)]
    texts += [t[:9] + "x" * (len(t) // r.choice((4, 6))) + t[9 + len(t) // 5 :] for t in texts]
    pairs = list(itertools.combinations(texts, 2))
    want = [line_dedup.edit_distance(a, b, 10_000) * 100 <= 20 * max(len(a), len(b)) for a, b in pairs]
    assert line_dedup.similar(pairs, 80).tolist() == want and 5 < sum(want) < len(want)


# 5


def test_url_filters(spark):
    urls = ["http://a.com/en/7", "https://X.Example.COM/en/77?q", "http://example.net/de/8", "http://example.net/de/9#x", "http://b.org/es/", "ftp://b.org/es", "no scheme", None, "", "http://", "http://com/en/", "http://xcom/en/", "http://a.b.c.d.com:80/en/", "x://y.com/en/?://z"]
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, action string")
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, verdict string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fit = [(len(h + p), h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    out = url_filters.match_rules(pages, rules)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())) == sorted((k, *judge(u)) for k, u in enumerate([*urls, urls[0]]))
    assert {r.verdict for r in url_filters.match_rules(pages, rules.limit(0)).collect()} == {"allow"}
    both = spark.createDataFrame([("com", "/en/", "allow"), ("com", "/en/", "block"), (None, None, "block")], "rule_host string, rule_path string, action string")
    assert url_filters.match_rules(pages, both).filter("page_id = 0").first().verdict == "block"


# 6


def test_token_ledger(spark, tmp_path):
    rows = [("insert", "a", "en", "v1", None, 5), ("insert", "a", "en", "v1", None, None), ("insert", None, None, "v1", None, 3)]
    schema = "op string, source string, lang string, tokenizer_version string, old_tokens long, new_tokens long"
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    ledger.commit(spark.createDataFrame(rows, schema), 1)
    ledger.commit(spark.createDataFrame([("revise", "a", "en", "v1", 5, 9), ("delete", None, None, "v1", 3, None)], schema), 2)
    ledger.commit(spark.createDataFrame([("revise", "a", "en", "v1", 5, 9), ("delete", None, None, "v1", 3, None)], schema), 2)
    ledger.commit(spark.createDataFrame([], schema), 3)
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v1", 2, 9)]
    with pytest.raises(Exception):  # noqa: B017
        ledger.commit(spark.createDataFrame([("odd", "a", "en", "v1", 1, 1)], schema), 4)


def test_token_ledger_beside_other_writers(spark, tmp_path, monkeypatch):
    """A commit under way while a fold looks, one that lands while it works, and one that is done anew meanwhile."""
    schema = "op string, source string, lang string, tokenizer_version string, old_tokens long, new_tokens long"
    feed = lambda n: spark.createDataFrame([("insert", "a", "en", "v", None, n)], schema)
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    total = lambda: got(ledger.totals(), "source", "n_docs", "n_tokens")
    ledger.commit(feed(5), 1)
    (tmp_path / "ledger/deltas/_staged/x/_temporary/0").mkdir(parents=True)  # a writer that has begun
    put = token_counts.put

    def busy(rows, folder, name, form="parquet"):
        if folder.endswith("rollups") and name != "later":
            monkeypatch.undo()
            ledger.commit(feed(7), 2)
            ledger.commit(feed(6), 1)
        return put(rows, folder, name, form)

    monkeypatch.setattr(token_counts, "put", busy)
    ledger.fold()
    assert ledger.folded() == (1, {1}) and total() == [("a", 2, 13)]
    ledger.fold()
    assert ledger.folded() == (2, {1, 2}) and total() == [("a", 2, 13)]
    ledger.commit(feed(6), 1)  # closed with its newest delta
    with pytest.raises(ValueError):
        ledger.commit(feed(5), 1)
    # a second fold of the same moment leaves nothing that counts
    ledger.commit(feed(1), 9)
    note = ledger.note()
    ledger.fold()
    monkeypatch.setattr(ledger, "note", lambda: note)
    ledger.fold()
    monkeypatch.undo()
    assert ledger.folded() == (3, {1, 2, 9}) and total() == [("a", 3, 14)] and [tuple(r) for r in ledger.note().ranges] == [(1, 2), (9, 9)]


def test_token_ledger_folds_and_recommits(spark, tmp_path):
    schema = "op string, source string, lang string, tokenizer_version string, old_tokens long, new_tokens long"
    feed = lambda *rows: spark.createDataFrame(list(rows), schema)
    one, two = ("insert", "a", "en", "v", None, 5), ("insert", "b", "en", "v", None, 7)
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    total = lambda: got(ledger.totals(), "source", "n_docs", "n_tokens")
    ledger.commit(feed(one), 1)
    ledger.commit(feed(), 1)  # an emptied batch replaces what it held
    assert total() == []
    ledger.commit(feed(one), 1)
    ledger.commit(feed(one, two), 2)
    ledger.fold()
    ledger.fold()
    assert ledger.folded() == (1, {1, 2}) and total() == [("a", 2, 10), ("b", 1, 7)]
    ledger.commit(feed(one), 1)  # closed: the same again changes nothing
    with pytest.raises(ValueError):
        ledger.commit(feed(two), 1)
    ledger.commit(feed(("delete", "a", "en", "v", 5, None), ("revise", "b", "en", "v", 7, 9)), 3)
    assert total() == [("a", 1, 5), ("b", 1, 9)]
    # a fold that was cut short before its note: the rollup is written again
    ledger.totals().write.parquet(str(tmp_path / "ledger/rollups/version=2"))
    assert total() == [("a", 1, 5), ("b", 1, 9)]
    ledger.fold()
    assert ledger.folded() == (2, {1, 2, 3}) and total() == [("a", 1, 5), ("b", 1, 9)]


def test_vocabulary_counts(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    tok, rows = Tokenizer.from_file(path), corpus(16, 20)
    out = token_counts.vocabulary_counts(frame(spark, rows), path, "bpe-49k")
    assert got(out, "doc_id", "bpe-49k") == sorted((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)


# 7


def brute_windows(rows, n):
    docs = [(i, words(t)) for i, t, *_ in rows]
    least = {}
    for i, w in docs:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in docs:
        gone = {k + j for k in range(len(w) - n + 1) if least[tuple(w[k : k + n])] < i for j in range(n)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("n,base", [(13, 7), (13, 4), (30, 5), (6, 6)])
def test_substring_dedup(spark, n, base):
    rows = corpus(5)
    assert got(substring_dedup.remove_repeats(frame(spark, rows), n, base), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(rows, n)


def test_substring_dedup_edges(spark):
    assert substring_dedup.remove_repeats(frame(spark, corpus(5)).limit(0)).count() == 0
    t = " ".join(map(str, range(20)))
    out = substring_dedup.remove_repeats(frame(spark, [(None, t, "a", "b", 1), (3, t, "a", "b", 1), (3, t + " x", "a", "b", 1), (9, t, "a", "b", 1)]))
    assert sorted((str(r.doc_id), r.n_removed) for r in out.collect()) == [("3", 0), ("3", 0), ("9", 20), ("None", 0)]


# 8


def test_packing(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [*corpus(6), (800, "It's <|endoftext|>, NAÏVE... x2,y. ÉÀ, ſ İ e\u0301. \u00a0z", "en", "s", 1)]
    pieces = packing.pack(frame(spark, rows), path, 512).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    want = sorted((i, p, s, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, *_ in rows for p, s in enumerate(range(0, len(ids[i]), 512)) for c in [ids[i][s : s + 512]])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 512
    assert len(sequences) <= 1.05 * -(-sum(r.length for r in pieces) // 512) + 1
    assert packing.pack(frame(spark, rows).limit(0), path).count() == 0


def fewest(sizes, capacity):
    """Optimal number of bins of a small instance."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[k] <= capacity and bins[j] not in bins[:j]:
                place(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_dominance_keeps_the_optimum():
    r = random.Random(3)
    for _ in range(150):
        capacity = r.randint(10, 40)
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
        fixed, left = packing.dominance(Counter(sizes), capacity)
        rest = sorted((s for s, c in left.items() for _ in range(c)), reverse=True)
        assert all(sum(p) <= capacity for p, _ in fixed)
        assert Counter(x for p, n in fixed for x in p for _ in range(n)) + Counter(rest) == Counter(sizes)
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(sizes, capacity)


def test_plan_uses_every_piece():
    r = random.Random(4)
    counts = {n: r.randint(1, 1000) for n in r.sample(range(1, 2049), 300)}
    p = packing.plan(counts, 2048)
    assert Counter({k: v for k, v in counts.items()}) == sum((Counter({k: v * n for k, v in Counter(x).items()}) for x, n in p), Counter())
    assert all(sum(x) <= 2048 for x, _ in p) and len(p) < 20 * 2048


# 9


def test_pii(spark):
    texts = ["Mail Bob.Lee7@Mail3.Example.com, bob.lee7@mail3.example.com", "+1 (017) 555-7713 or +10175557713", "97.51.17.173 4539 1488 0343 6467; 4539148803436467", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "Mrs. Anna Smith, Mr. SMITH", "госпожа Анна Иванова", None, "", "v1.2.3.4.5 and 12:30", "97.51.17.173!!"]
    df = spark.createDataFrame([(k, t, -1) for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string, n_entities int")
    out, table = pii.pseudonymised(df, "key")
    new = {r.doc_id: r.text for r in out.collect()}
    for k, t in enumerate(texts):
        if t and k != 8:
            assert not [w for w in re.findall(r"\S*\d\S*|\S+@\S+|Smith|SMITH|Иванова", t) if w != "+1" and w.strip(",;!") in new[k]]
    assert new[6] is None and new[7] == "" and new[8] == texts[8] and new[10] == new[0]
    a, b = re.findall(r"\S+@\S+?(?=,|$)", new[0])
    assert a.lower() == b and a.split(".")[-1] == "com" and a[0].isupper()
    digits = lambda s: re.sub(r"\D", "", s)
    x, y = new[1].split(" or ")
    assert digits(x) == digits(y) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", x)
    card = digits(new[2].split("; ")[1])
    assert card == digits(new[2].split(" ", 1)[1].split(";")[0]) and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert new[2].split(" ")[0] == new[9].rstrip("!") and new[2].startswith("10.")
    assert re.fullmatch(r"Mrs\. \w+a (\w+), Mr\. (\w+)", new[4]) and new[4].split()[2].strip(",").upper() == new[4].split()[-1]
    assert re.fullmatch(r"госпожа [А-Я][а-я]+а [А-Я][а-я]+", new[5])
    rows = table.collect()
    assert len({(r.type, r.surrogate) for r in rows}) == len(rows) and not {(r.type, r.surrogate) for r in rows} & {(r.type, r.identity) for r in rows}
    assert pii.pseudonymised(df, "other")[0].filter("doc_id = 0").first().text != new[0]
    assert pii.pseudonymised(df.limit(0), "key")[0].count() == 0


def test_pii_names_without_a_title(spark):
    """Later mentions of a titled name get the same surrogates; parts of other words, other documents and columns of inner names stay."""
    texts = ["Frau Anna-Lena O'Neil kam. Anna-Lena sah O'Neil und O'NEIL; Annale blieb.", "O'Neil alone", "госпожа Анна Иванова и Иванова, Ивановадом", "Mr. Roe " + "w " * 40_000 + "Roe."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"hits": F.lit("h"), "attempts": F.lit(1), "row": F.lit(2), "named": F.lit("n"), "c0": F.lit("c")})
    rows = pii.pseudonymised(df, "key")[0].orderBy("doc_id").collect()
    a, b, c, d = (r.text for r in rows)
    m = re.fullmatch(r"Frau (\S+) (\S+) kam\. (\S+) sah (\S+) und (\S+); Annale blieb\.", a)
    assert m and m[1] == m[3] and m[2] == m[4] and m[5] == m[2].upper() and "Neil" not in a and "Lena" not in a
    assert b == "O'Neil alone"
    m = re.fullmatch(r"госпожа (\S+) (\S+) и (\S+), Ивановадом", c)
    assert m and m[2] == m[3] != "Иванова"
    assert re.fullmatch(r"Mr\. (\w+) (?:w )+\1\.", d) and "Roe" not in d
    assert {(r.hits, r.attempts, r.row, r.named, r.c0) for r in rows} == {("h", 1, 2, "n", "c")}


def test_pii_names_outgrow_their_space(spark, monkeypatch):
    """More surnames than the first attempt has surrogates (2 ** 3 * 4)."""
    monkeypatch.setattr(pii, "SYLLABLES", {k: v[:2] * 16 for k, v in pii.SYLLABLES.items()})
    monkeypatch.setattr(pii, "MAX_ATTEMPTS", 8)
    df = spark.createDataFrame([("SURNAME", f"name{k}") for k in range(60)], "type string, identity string").coalesce(1)
    rows = pii.assigned(df, "key").collect()
    assert len({r.identity for r in rows}) == len({r.surrogate for r in rows}) == 60


def test_pii_clashes_are_resolved(spark, monkeypatch):
    narrow = lambda name, identity, attempt, key: F.when(attempt < 3, F.lit("7")).otherwise(F.concat(F.lit("s"), F.right(identity, F.lit(2))))
    monkeypatch.setattr(pii, "surrogate", narrow)
    df = spark.createDataFrame([("CARD", f"card{k}") for k in range(10, 30)] + [("CARD", "7")], "type string, identity string")
    rows = pii.assigned(df, "key").collect()
    assert len(rows) == 21 == len({r.surrogate for r in rows}) and "7" not in {r.surrogate for r in rows} and max(r.attempt for r in rows) == 3
    docs = spark.createDataFrame([(1, "+1 017 555 7713 and +1 017 555 7714")], "doc_id long, text string")
    monkeypatch.undo()
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda n, i, a, k: F.when(a == 0, F.lit("10000000000")).otherwise(real(n, i, a, k)))
    text = pii.pseudonymised(docs, "key")[0].first().text
    x, y = text.split(" and ")
    assert x != y and "017" not in text


# 10


def test_masks_are_lossless():
    n, most = 13, 2
    for k in range(most + 1):
        for bad in itertools.combinations(range(n), k):
            assert any(all(m == "0" or s + j not in bad for j, m in enumerate(mask)) for mask in decontam.MASKS for s in range(n - len(mask) + 1))


def brute_leaks(rows, items, span=13, subs=2, least=8):
    norm = lambda t: [lower(w).rstrip(decontam.PUNCTUATION.decode()) for w in words(t)]
    out = set()
    for i, t, *_ in rows:
        d = norm(t)
        for j, x in items:
            b = norm(x)
            if len(b) < least:
                continue
            n = min(span, len(b))
            allowed = subs if len(b) >= span else 0
            if any(sum(p != q for p, q in zip(d[a : a + n], b[c : c + n], strict=True)) <= allowed for a in range(len(d) - n + 1) for c in range(len(b) - n + 1)):
                out.add((i, j))
    return out


def test_decontamination(spark):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choices(vocabulary, k=n))) for k, n in enumerate((40, 25, 13, 9, 5, 0))] + [(9, None)]
    rows = corpus(7, 20)[:-2]
    for k in range(60):
        b = r.choice(items[:4])[1].split()
        n = min(len(b), 13)
        s = r.randint(0, len(b) - n)
        part = b[s : s + n]
        for j in r.sample(range(n), r.randint(0, min(n, 4))):
            part[j] = "zz"
        rows.append((1000 + k, " ".join([*r.choices(vocabulary, k=5), " ".join(part).upper() + "!", "end"]), "en", "s", 1))
    df, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(df, bench).collect()} == brute_leaks(rows, items)
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_decontamination_with_a_full_bit_field(spark, monkeypatch):
    """All hashes pass to the join: the results are the same."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(15))) for k in range(12)]
    rows = [(k, "before " + t + " after", "en", "s", 1) for k, t in items]
    monkeypatch.setattr(decontam, "MOST_BITS", 64)
    out = decontam.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert got(out, "doc_id", "item_id", "doc_start", "n_tokens", "n_matched") == [(k, k, 1, 15, 15) for k in range(12)]


def test_decontamination_compares_tokens(spark):
    """Marks inside a token count, those at its ends do not; repeated tokens, repeated rows and long texts."""
    item = "alpha 3.14 beta x=1 gamma -5 delta a/b eps it's zeta e.g eta 1,000"
    swap = str.maketrans(".=-/',", "-<+;`.")
    quoted = " ".join(f'"({w})",' for w in item.split())
    same = " ".join(["ha"] * 14)
    rows = [(1, item.translate(swap), "en", "s", 1), (2, quoted, "en", "s", 1), (3, same + " ha ha", "en", "s", 1), (3, same + " ha ha", "en", "s", 1), (4, "w " * 60_000 + quoted, "en", "s", 1), (5, '"' + same[:-3], "en", "s", 1), (None, item, "en", "s", 1), (6, None, "en", "s", 1), (7, "-- .. --", "en", "s", 1)]
    items = [(0, item), (1, same), (0, item), (2, " ".join(["--", ".."] * 7)), (None, item), (3, None)]
    out = decontam.contaminated(frame(spark, rows).withColumns({"row": F.lit("x"), "item": F.lit("y"), "seeds": F.lit("z")}), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((str(r.doc_id), r.item_id, r.doc_start, r.n_tokens, r.n_matched) for r in out.collect()) == [("2", 0, 0, 14, 14), ("3", 1, 0, 14, 14), ("3", 1, 0, 14, 14), ("4", 0, 60_000, 14, 14), ("5", 1, 0, 13, 13), ("None", 0, 0, 14, 14)]
