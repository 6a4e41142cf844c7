import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from caseloom.llm import packing

VOCABULARY = path("word_bpe_49k.json")


def plain_best_fit(sizes, length):
    free = []
    for size in sorted(sizes, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= size]
        if fits:
            k = min(fits, key=lambda k: free[k])
            free[k] -= size
        else:
            free.append(length - size)
    return len(free)


def fewest(sizes, length):
    """The smallest number of sequences, by trying all packings."""
    best = plain_best_fit(sizes, length)
    sizes, seen = sorted(sizes, reverse=True), set()

    def place(k, free):
        nonlocal best
        least = len(free) + max(0, -(-(sum(sizes[k:]) - sum(free)) // length))
        if least >= best or (k, free) in seen:
            return
        seen.add((k, free))
        if k == len(sizes):
            best = len(free)
            return
        for f in sorted(set(free)):
            if f >= sizes[k]:
                rest = list(free)
                rest.remove(f)
                place(k + 1, tuple(sorted([*rest, f - sizes[k]])))
        place(k + 1, tuple(sorted([*free, length - sizes[k]])))

    place(0, ())
    return best


def checked(counts, length):
    """Every piece has one place; places are gapless from 0 and within a sequence."""
    made = packing.plan(counts, length)
    taken = {}
    for size, n in counts.items():
        sequence, offset = made.places(np.full(n, size), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            taken.setdefault(s, []).append((o, size))
    assert set(taken) == set(range(made.sequences))
    for own in taken.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
    return made.sequences


def test_reduction_loses_no_best_packing():
    rng = np.random.default_rng(8)
    fixed = 0
    for round_ in range(400):
        length = int(rng.integers(8, 40))
        low = int(rng.integers(1, max(2, length // 3)))
        sizes = rng.integers(low, length + 1, int(rng.integers(1, 13))).tolist()
        left = packing.Histogram(Counter(sizes))
        sets = packing.reduce(left, length)
        assert all(sum(items) <= length for items, _ in sets)
        rest = [s for s, n in left.count.items() for _ in range(n)]
        assert sorted(rest + [s for items, n in sets for _ in range(n) for s in items]) == sorted(sizes)
        assert sum(n for _, n in sets) + fewest(rest, length) == fewest(sizes, length), (sizes, length)
        fixed += len(sizes) - len(rest)
        n = checked(Counter(sizes), length)
        assert fewest(sizes, length) <= n
    assert fixed > 1500


def test_best_fit_of_groups_is_best_fit_piece_by_piece():
    rng = np.random.default_rng(2)
    for _ in range(100):
        length = int(rng.integers(10, 60))
        sizes = rng.integers(1, length + 1, int(rng.integers(1, 80))).tolist()
        groups = packing.best_fit(packing.Histogram(Counter(sizes)), length)
        assert sum(g.copies for g in groups) == plain_best_fit(sizes, length)


def test_many_pieces_need_hardly_more_than_their_tokens():
    rng = np.random.default_rng(5)
    sizes = np.minimum(np.maximum(1, rng.lognormal(6, 1, 20_000).astype(int)), 2048)
    counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
    least = -(-int(sizes.sum()) // 2048)
    assert least <= checked(counts, 2048) <= least + 2
    many = {s: n * 10**9 for s, n in counts.items()}  # the work depends on lengths, not on pieces
    made = packing.plan(many, 2048)
    assert made.sequences < 1.001 * sum(s * n for s, n in many.items()) / 2048 and len(made.key) < 50_000
    with pytest.raises(ValueError):
        packing.plan({2049: 1}, 2048)
    assert packing.plan({}, 2048).sequences == 0


def test_against_the_library(spark):
    library = Tokenizer.from_file(VOCABULARY)
    rng = np.random.default_rng(6)
    words = ["Haus", "l'été", "don't", "x.", "(and)", "***", "naïve", "<|endoftext|>", "<|ENDOFTEXT|>", "ÉCOLE,", "a…", "İ!", "\t", "42"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 90, 150)]
    texts += ["same text again"] * 60 + ["", None, "word " * 700, "\n \n"]
    rows = [(None if k % 50 == 7 else k // 2, t, k, "x", 1, 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, number string, task int, length int").repartition(5)
    length = 64
    packed = packing.pack(docs, VOCABULARY, 0, length, keep_ids=True)
    got = packed.collect()
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), length)):
            own = np.array(ids[at : at + length], "<u4")
            expected[doc_id, piece, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    taken = {}
    for r in got:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    for own in taken.values():
        at = 0
        for offset, size, ids in sorted(own):
            assert offset == at and len(ids) == size
            at += size
        assert at <= length
    sizes = [r.length for r in got]
    assert len(taken) <= plain_best_fit(sizes, length)
    joined = {r.sequence_id: (r.ids, len(r.spans)) for r in packing.sequences(packed).collect()}
    assert joined == {s: (sum((ids for *_, ids in sorted(own)), []), len(own)) for s, own in taken.items()}
    assert packing.pack(docs.limit(0), VOCABULARY).collect() == []
