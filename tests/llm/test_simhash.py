import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caseloom.llm import simhash
from caseloom.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    """Bit by bit, straight from the definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in values) > len(values))


def plain_components(prints):
    ids = sorted(prints, key=lambda p: p[0])
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (ids[i][1] ^ ids[j][1]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {ids[i][0]: ids[root(i)][0] for i in range(len(ids))}


def test_fingerprints_by_definition():
    texts = ["", " \t\n", "One", "A b C", "a b c d", "Ä É a b c d", "x " * 300, "a b c d e f", "Iİ KK q w e"]
    for text in texts:
        assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)


def test_many_shingles_in_steps(monkeypatch):
    text = " ".join(str(i * 7919 % 1000) for i in range(900))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "ROWS", 64)
    assert simhash.fingerprint(text.encode()) == whole


def test_test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    expected = plain_components(rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = dict(rows)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", expected[r.doc_id])


def test_block_keys_and_chunks_lose_no_link(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = set(centres)
    while len(prints) < 400:  # one crowd around the first centre, some around the others
        value = centres[0 if rng.random() < 0.7 else rng.randrange(6)]
        for bit in rng.sample(range(64), rng.randrange(1, 9)):
            value ^= 1 << bit
        prints.add(value)
    rows = list(enumerate(sorted(prints)))
    expected = plain_components(rows)
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in rows]
    classes = spark.createDataFrame(signed, "node long, fp long")
    for chunk in (7, 64, 1024):
        found = {r.node: r.component for r in connected_components(simhash.links(classes, chunk=chunk)).collect()}
        assert {i: found.get(i, i) for i, _ in rows} == expected


def test_pivots_discard_only_pairs_beyond_the_limit():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 200, np.uint64)
    near = fp.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 200, np.uint64)
    keys = simhash.pivots()
    assert (np.abs(simhash.distance_table(fp, keys) - simhash.distance_table(near, keys)) <= 4).all()
    assert len(keys) == simhash.PIVOTS
    far = simhash.distance_table(fp[:100], keys) - simhash.distance_table(fp[100:], keys)
    assert (np.abs(far).max(axis=1) > 4).mean() > 0.95


def test_a_hot_group_gives_links_not_pairs():
    n = 900
    rng = np.random.default_rng(4)
    fp = np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64))
    zero = np.zeros(n, np.int64)
    a, b = simhash.cell_links(zero, zero.astype(bool), zero, fp, simhash.pivots())
    assert len(a) < 3 * n


def test_edges(documents, spark):
    long_text = "word " * 200_000
    docs = documents([(5, None), (3, ""), (9, " \n"), (4, "one two"), (4, "one two"), (None, "one two"), (7, long_text),
                      (None, "only one without a name at all")])
    docs = docs.withColumns({"node": F.lit("x"), "fp": F.lit(1), "component": F.lit(2), "low": F.lit(0)})
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 8
    empty = [r.component_id for r in got if r.fingerprint == "0" * 16]
    assert empty == [3, 3, 3]
    assert [r.component_id for r in got if r.doc_id == 4] == [4, 4]
    unnamed = sorted((r.component_id for r in got if r.doc_id is None), key=str)
    assert unnamed == [4, None]
    none = simhash.near_duplicates(documents([]))
    assert none.collect() == [] and none.columns == ["doc_id", "fingerprint", "component_id"]


@pytest.mark.parametrize("shape", ["path", "hub", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    links = {
        "path": [(i, i + 1) for i in range(60)] + [(100, 101)],
        "hub": [(7, i) for i in range(100, 300)] + [(3, 299), (3, 3), (None, 4), (5, None), (3, 299)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "none": [],
    }[shape]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent}
    assert len(got) == len(parent)
