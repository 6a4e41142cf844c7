import re
from collections import Counter

import numpy as np
import pytest

from caseloom.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=3, least=10, covered=50, top=2000):
    """The contract by loops over words."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for size in range(1, longest + 1):
                for i in range(len(ws) - size + 1):
                    f[lang, tuple(ws[i : i + size])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, ws), a in found.items():
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                key = lang, ws[i : i + size]
                longer[key] = max(longer[key], a)
    out = {}
    for (lang, ws), a in found.items():
        if 100 * longer[lang, ws] >= covered * a:
            continue
        score, _, left, right = min(
            (1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]])
            for k in range(1, len(ws))
        )
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, many in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(many)[:top])
    )


def prose(n=400, seed=3):
    rng = np.random.default_rng(seed)
    words = ["Der", "new", "york", "city", "é", "ß", "x.y", "token", "a", "b", " ", "Żółć", "c\x01d", "in", "of"]
    weights = 1 / np.arange(1, len(words) + 1)
    gaps = [" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "\x0b", "\r\n", "!"]
    rows = []
    for k in range(n):
        size = int(rng.integers(0, 40))
        picked = rng.choice(words, size, p=weights / weights.sum())
        text = "".join(w + gaps[g] for w, g in zip(picked, rng.integers(0, len(gaps), size), strict=True))
        rows.append((text, [None, "en", "de", ""][k % 4]))
    return rows + [(None, "en"), ("", "en"), (" .,\n", "xx")] + [("New York City is a city of", "en")] * 30


@pytest.fixture
def found(spark):
    def run(rows, **more):
        docs = spark.createDataFrame([(i, t, g, 0, 0) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, fp int, rank int")
        return sorted(tuple(r) for r in phrases.collocations(docs, **more).collect())

    return run


def test_against_plain_counting(found):
    rows = prose()
    expected = plain(rows)
    assert len(expected) > 40
    assert found(rows) == expected


def test_longer_phrases_small_blocks_and_full_bitmaps(found, monkeypatch):
    rows = prose(300, 5)
    rows.append((" ".join(t or "" for t, _ in rows), "en"))
    monkeypatch.setattr(phrases, "COMPACT", 300)
    monkeypatch.setattr(phrases, "SEND", 200)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 500)
    expected = plain(rows, 5, 4, 80, 25)
    assert found(rows, longest=5, least=4, covered=80, top=25) == expected
    monkeypatch.setattr(phrases, "_bitmap", lambda grams: np.full(1 << 13, 255, np.uint8))  # rules nothing out
    assert found(rows, longest=5, least=4, covered=80, top=25) == expected


def counted(texts, n, monkeypatch, window):
    monkeypatch.setattr(phrases, "WINDOW", window)
    seeds = np.full(len(texts), phrases.seed("en"), np.uint64)
    held = [phrases._counted(c, n, seeds, np.arange(len(texts)), None) for c in phrases.chunks(iter(texts), 5)]
    return phrases.added(*map(np.concatenate, zip(*held, strict=True)))


def test_long_texts_are_cut_between_words_without_losing_phrases(monkeypatch):
    texts = [(t or "").encode() for t, _ in prose(60, 2)]
    texts += [b" ".join(texts), b"w" * 500 + b" " * 300 + b"new york city of" * 3, b" " * 400, b"a\n" * 200]
    for n in (1, 2, 3, 5):
        whole, cut = (counted(texts, n, monkeypatch, window) for window in (1 << 21, 64))
        for one, other in zip(whole[:3], cut[:3], strict=True):
            assert np.array_equal(one, other)
        for fp, mark, doc, at in zip(cut[0], cut[1], cut[3], cut[4], strict=True):
            if at >= 0:  # the pointer leads to the words
                words = phrases.Words(texts[doc].translate(phrases._TABLE)[at:])
                assert words.grams(np.zeros(1, np.int64), n, np.full(1, phrases.seed("en"), np.uint64)) == (fp, mark)


def test_phrases_that_share_a_fingerprint_stay_apart():
    fp, mark = np.array([7, 7, 9, 7, 7], np.uint64), np.array([1, 2, 1, 1, 2], np.int32)
    got = phrases.added(fp, mark, np.array([1, 2, 3, 4, 5]), np.array([5, 5, 5, 3, 9]), np.arange(5))
    assert [x.tolist() for x in got] == [[7, 7, 9], [1, 2, 1], [5, 7, 3], [3, 5, 5], [3, 1, 2]]


def test_ties_go_by_bytes_and_empty_tables_give_nothing(found):
    rows = [(f"{a} {b}. ", "en") for a, b in ("zz aa", "Éa bb", "a b", "a￿ q", "a\U0001f600 q") for a, b in [(a, b)] for _ in range(10)] if False else [
        (f"{pair}. ", "en") for pair in ("zz aa", "éa bb", "a b", "a￿ q", "a\U0001f600 r") for _ in range(10)
    ]
    got = found(rows)
    assert [r[2] for r in got] == ["a b", "a￿ q", "a\U0001f600 r", "zz aa", "éa bb"]
    assert got == plain(rows)
    assert found(rows, top=2) == plain(rows, top=2)
    assert found([]) == [] and found([(None, None)]) == [] and found([("only once here", "en")]) == []


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000
    kind = "fp long, mark int, a long, cuts array<struct<k:int,first:struct<fp:bigint,mark:int>,rest:struct<fp:bigint,mark:int>>>"
    one = spark.createDataFrame([(1, 1, big, [(1, (2, 2), (3, 3)), (2, (3, 3), (2, 2))])], kind)
    counts = spark.createDataFrame([(1, 2, 2, big * 3), (1, 3, 3, big * 2)], "n int, fp long, mark int, a long")
    row = phrases.scored(one, counts).first()
    assert (row.score, row.l, row.r) == (1_000_000 * big * big // (6 * big * big), big * 3, big * 2)
