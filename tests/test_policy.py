"""Sections, slices, vectors, nearest passages and the index, against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.functions.embedding import token_codes, token_weights, unit
from caseloom.operators import nearest as N
from caseloom.operators import policy
from caseloom.operators.nearest import nearest
from caseloom.plans import policy_index
from caseloom.sources import corpus


def docs(spark, *texts, name="d"):
    rows = [(f"{name}{i}", "v1", f"{name}{i}", t, f"/{name}{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id string, version string, title string, text string, source_path string"
    )


def sections(spark, text):
    rows = policy.sections(docs(spark, text)).orderBy("section_no").collect()
    assert [r.section_no for r in rows] == list(range(len(rows)))
    return [(r.section, r.body) for r in rows]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("# Title\nLine one.\nLine two.\n", [("Title", "Line one.\nLine two.")]),
        ("before\n\n## A \n x \n# B\ny", [("Introduction", "before"), ("A", "x"), ("B", "y")]),
        ("# only\n## headings\n", []),
        ("", []),
        ("  \n ", []),
        ("####### seven\n#no space\n# \nrest", [("Introduction", "####### seven\n#no space\n# \nrest")]),
        ("   ###   padded   title  \nbody", [("padded   title", "body")]),
        ("a\r\nb\rc\x0bd\x85e\u2028f\x1cg", [("Introduction", "a\nb\nc\nd\ne\nf\ng")]),
        ("\u00a0# wide\u3000\n\u2003body\u00a0", [("wide", "body")]),
        ("# same\nx\n# same\nx", [("same", "x"), ("same", "x")]),
        ("x # not a heading\n# h\n$1 \\ y", [("Introduction", "x # not a heading"), ("h", "$1 \\ y")]),
    ],
)
def test_sections(spark, text, wanted):
    assert sections(spark, text) == wanted


def test_long_runs_of_blanks_are_quick(spark):
    gap = " " * 200_000
    assert sections(spark, f"# a\nx{gap}y{gap}\n{gap}#{gap}b{gap}\nz") == [("a", f"x{gap}y"), ("b", "z")]


def plain_slices(text, size, overlap):
    """The windows of the rule, by position."""
    if len(text) <= size:
        return [text]
    starts = range(0, len(text) - overlap, size - overlap)
    return [text[s : s + size].strip() for s in starts]


@pytest.mark.parametrize("length", [1, 1199, 1200, 1201, 2299, 2300, 2301, 3400, 3401, 9000])
def test_slice_boundaries(spark, length):
    rng = random.Random(length)
    text = "x" + "".join(rng.choice("ab é𝄞\n ") for _ in range(length - 2)) + "z" * (length > 1)
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.slices("t")).first()[0] == plain_slices(text, 1200, 100)


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        X.slices("t", 100, 100)


def test_chunk_ids_and_citations(spark):
    d = docs(spark, "# S\n" + "word " * 500)
    rows = sorted(policy.chunks(d).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in rows] == [0, 1, 2]
    for r in rows:
        identity = f"d0||v1||S||{r.chunk_index}||{r.text}"
        assert r.chunk_id == hashlib.sha256(identity.encode()).hexdigest()
        assert r.citation == "d0 S (v1)"
    assert sorted(r.chunk_id for r in policy.chunks(d).collect()) == sorted(r.chunk_id for r in rows)


def plain_vector(text, dimension):
    vector = [0] * dimension
    for token in re.findall("[A-Za-z0-9_]+", text.lower()):
        h = hashlib.sha256(token.encode()).hexdigest()
        vector[int(h[:8], 16) % dimension] += 1 if int(h[8], 16) % 2 else -1
    return vector


@pytest.mark.parametrize("dimension", [64, 128, 100])
def test_vectors(spark, dimension):
    texts = ["Money moved. MONEY moved_1 twice!", "", "…", "a b c a", "x " * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    w = df.select("t", token_weights(token_codes("t", dimension), dimension).alias("w"))
    for row in w.select("t", "w", unit("w").alias("u")).collect():
        plain = plain_vector(row.t, dimension)
        assert row.w == plain
        length = math.sqrt(sum(x * x for x in plain))
        assert row.u == pytest.approx([x / length if length else 0.0 for x in plain])


def plain_nearest(queries, items, k):
    out = {}
    for q, a in queries.items():
        scored = []
        for i, b in items.items():
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            same = len(a) == len(b) and na > 0 and nb > 0
            scored.append((-(float(np.dot(a, b)) / (na * nb) if same else 0.0), i))
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


@pytest.mark.parametrize("blocks", [(32_768, 8_192, 256), (7, 5, 3), (7, 9, 3)])
def test_nearest_equals_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("QUERY_BLOCK", "TILE"), blocks[::2]):
        monkeypatch.setattr(N, name, value)
    block_bytes, pays = blocks[1] * 8 * 4, 1.0 if blocks[1] == 5 else N.PAYS
    rng = random.Random(5)

    def vectors(n, prefix):
        found = {f"{prefix}{i:02d}": [float(rng.randrange(-2, 3)) for _ in range(4)] for i in range(n)}
        found[f"{prefix}90"] = [0.0] * 4
        found[f"{prefix}91"] = [1.0, 2.0]
        return found

    queries, items = vectors(30, "q"), vectors(25, "i")
    q = spark.createDataFrame(list(queries.items()), "query_id string, vector array<double>")
    i = spark.createDataFrame(list(items.items()), "item_id string, vector array<double>")
    got = {}
    for r in nearest(q, i, 4, decimals=12, block_bytes=block_bytes, pays=pays).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, round(r.score, 12)))
    wanted = plain_nearest(queries, items, 4)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {
        k: [i for i, _ in v] for k, v in wanted.items()
    }


def test_blocks_that_cannot_hold_a_best_item_are_skipped(spark, monkeypatch):
    rng = np.random.default_rng(2)
    heads = rng.standard_normal((12, 16))

    def rows(n, prefix, seed):
        own = np.random.default_rng(seed)
        vectors = heads[own.integers(0, 12, n)] + 0.15 * own.standard_normal((n, 16))
        return {f"{prefix}{k:04d}": [float(x) for x in v] for k, v in enumerate(vectors)}

    queries, items = rows(60, "q", 3), rows(600, "i", 4)
    items |= {f"j{k:04d}": items["i0007"] for k in range(80)}  # copies fill blocks of their own
    items |= {"odd": [1.0, 2.0], "zero": [0.0] * 16}
    queries |= {"odd": [3.0], "zero": [0.0] * 16}
    q = spark.createDataFrame(list(queries.items()), "query_id string, vector array<double>")
    i = spark.createDataFrame(list(items.items()), "item_id string, vector array<double>")
    asked, real = [], N._asked

    def counting(*args):
        out = real(*args)
        asked.append(out.groupBy("query_id").count().collect())
        return out

    monkeypatch.setattr(N, "_asked", counting)
    got = {}
    for r in nearest(q, i, 5, decimals=12, block_bytes=40 * 8 * 16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == {k: [i for i, _ in v] for k, v in plain_nearest(queries, items, 5).items()}
    first, rest = ({r.query_id: r["count"] for r in some} for some in asked)
    assert set(first.values()) == {2}  # the best centre and the odd vectors
    centres = math.ceil(len(items) / 40)
    looked_at = sum(first[k] + rest.get(k, 0) for k in queries if k[1:].isdigit())
    assert looked_at < 60 * centres / 3  # of all pairs of a query and a centre


def test_bounds_hold(spark):
    rng = np.random.default_rng(6)
    for d in (1, 2, 3, 40):
        centres = rng.standard_normal((5, d))
        centres /= np.sqrt((centres**2).sum(1, keepdims=True))
        items, queries = rng.standard_normal((2, 200, d))
        units = [x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (items, queries)]
        own = N._angles(units[0], centres)
        radius = np.full(5, -1.0)
        np.maximum.at(radius, own.argmin(1), own.min(1))
        bound = N.bounds(units[1], np.ones(200, bool), centres, radius)
        assert (units[1] @ units[0].T <= bound[:, own.argmin(1)] + N.SLACK).all()


def test_pilots_tell_whether_bounds_skip_much():
    rng = np.random.default_rng(1)

    def unit(x):
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    heads = unit(rng.standard_normal((8, 64)))
    near = unit(heads[rng.integers(0, 8, 2000)] + 0.03 * rng.standard_normal((2000, 64)))
    far = unit(rng.standard_normal((2000, 64)))
    assert N.share_left(near[:100], near[100:], N.fitted_centres(near[100:], 16), 5) < 0.4
    assert N.share_left(far[:100], far[100:], N.fitted_centres(far[100:], 16), 5) > 0.9
    assert N.share_left(far[:0], far, far[:2], 5) == N.share_left(far, far[:0], far[:2], 5) == 1.0


def test_nearest_among_many_ties_and_near_ties(spark):
    rng = random.Random(9)
    base = [rng.random() - 0.5 for _ in range(16)]
    items = {}
    for n in range(900):
        vector = list(base) if n % 3 else [x + rng.choice([0, 1e-7, -1e-7, 0.3]) for x in base]
        items[n] = vector
    queries = {0: base, 1: [-x for x in base], 2: [rng.random() for _ in base]}
    q = spark.createDataFrame(list(queries.items()), "query_id int, vector array<double>")
    i = spark.createDataFrame(list(items.items()), "item_id int, vector array<double>")
    got = {}
    for r in nearest(q, i, 7, decimals=12).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    wanted = plain_nearest(queries, items, 7)
    assert got == {k: [i for i, _ in v] for k, v in wanted.items()}


def test_fewer_items_than_asked_for(spark):
    q = spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>")
    i = spark.createDataFrame([("i", [2.0])], "item_id string, vector array<double>")
    assert [tuple(r) for r in nearest(q, i, 5).collect()] == [("q", "i", 1.0, 1)]
    assert nearest(q, i.limit(0), 5).count() == 0


def case(spark, **more):
    row = {
        "case_id": "c", "party_type": "business", "industry": "payments", "risk_rating": "high",
        "model_types": [], "scenario_codes": ["ESCALATE"],
        "alerts": [("report of suspicious activity",)],
    }
    row.update(more)
    return spark.createDataFrame(
        [tuple(row.values())],
        "case_id string, party_type string, industry string, risk_rating string, "
        "model_types array<string>, scenario_codes array<string>, "
        "alerts array<struct<trigger_summary: string>>",
    )


def test_query_text(spark):
    packet = case(
        spark, industry=None, model_types=["a", "b"],
        alerts=[("one",), ("",), (None,), ("four",), ("five",), ("six",)],
    )
    assert policy.case_queries(packet).first().query == (
        "party_type: business\nrisk_rating: high\nmodel_types: a, b\n"
        "scenario_codes: ESCALATE\none\nfour\nfive"
    )
    nothing = case(spark, party_type="", industry=None, risk_rating=None, scenario_codes=None, alerts=None)
    assert policy.case_queries(nothing).first().query == ""


def test_index_and_retrieval(spark, tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    (folder / "reporting__v1.md").write_text(
        "# When to report\nReport suspicious activity at once and escalate open questions.\n"
    )
    (folder / "card_limits__v1.md").write_text("# Card limits\nWho may raise a limit, and how far.\n")
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        policy_index.read_index(spark, root)
    policy_index.update(spark, corpus.read_corpus(spark, str(folder)), root, "g1")
    index = policy_index.read_index(spark, root)
    assert index.count() == 2
    queries = policy.case_queries(case(spark)).withColumnRenamed("case_id", "query_id")
    best = policy.passages(queries, index, 1).collect()
    assert [r.doc_id for r in best] == ["reporting"]
    empty = queries.withColumn("query", F.lit(""))
    assert policy.passages(empty, index).count() == 0

    # The text changes: the document is replaced, its old chunk stays.
    (folder / "card_limits__v1.md").write_text("# Card limits\nNew text.\n")
    policy_index.update(spark, corpus.read_corpus(spark, str(folder)), root, "g2")
    assert policy_index.read_index(spark, root).count() == 3
    documents = spark.read.parquet(f"{root}/g2/documents")
    assert documents.count() == 2
    hashes = {r.doc_id: r.content_hash for r in documents.collect()}
    assert hashes["card_limits"] == hashlib.sha256(b"# Card limits\nNew text.\n").hexdigest()


def texts(spark, **named):
    rows = [(d, "v1", d, f"# {d}\n{t}", f"/{d}") for d, t in named.items()]
    return spark.createDataFrame(rows, "doc_id string, version string, title string, text string, source_path string")


def test_unchanged_documents_are_not_embedded_again(spark, tmp_path, monkeypatch):
    root, embedded = str(tmp_path / "index"), []
    real = policy.embed
    monkeypatch.setattr(policy, "embed", lambda df: embedded.append(sorted(r.doc_id for r in df.collect())) or real(df))
    given = [{"a": "one", "b": "two", "c": "three"}, {"a": "one", "b": "changed", "d": "four"}, {"b": "two", "c": "three"}, {"a": "one"}]
    seen: dict[str, set] = {}
    for k, now in enumerate(given):
        policy_index.update(spark, texts(spark, **now), root, f"g{k}")
        for d, t in now.items():
            seen.setdefault(d, set()).add(f"{t}")
        index = policy_index.read_index(spark, root).collect()
        assert sorted((r.doc_id, r.text) for r in index) == sorted((d, t) for d, ts in seen.items() for t in ts)
        fresh = policy.embed(policy.chunks(texts(spark, **{r.doc_id: r.text for r in index}))).collect()
        vectors = {r.chunk_id: (r.weights, r.embedding) for r in fresh}
        assert all(vectors.get(r.chunk_id, (r.weights, r.embedding)) == (r.weights, r.embedding) for r in index)
        embedded.pop()
    # b goes back to its first text, whose chunk is there: nothing is left to embed.
    assert embedded == [["a", "b", "c"], ["b", "d"], [], []]
    entries = {r.doc_id: r.content_hash for r in policy_index.read_documents(spark, root).collect()}
    assert entries == {d: hashlib.sha256(f"# {d}\n{t}".encode()).hexdigest() for d, t in {"a": "one", "b": "two", "c": "three", "d": "four"}.items()}
    assert policy_index._parts(spark, root, "g3") == ["g0", "g1"]


def test_many_generations_are_put_together(spark, tmp_path):
    root = str(tmp_path / "index")
    for k in range(5):
        policy_index.update(spark, texts(spark, **{f"d{k}": "x"}), root, f"g{k}", parts=2)
        assert policy_index.read_index(spark, root).count() == k + 1
        assert len(policy_index._parts(spark, root, f"g{k}")) <= 2
    gone = policy_index.vacuum(spark, root, [f"g{k}" for k in range(5)])
    assert gone and policy_index.read_index(spark, root).count() == 5 == policy_index.read_documents(spark, root).count()
    with pytest.raises(ValueError):
        policy_index.update(spark, texts(spark, z="x"), root, "g4")


def test_upsert_keeps_the_last_of_repeats(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "k string, n int, v string")
    new = spark.createDataFrame(
        [("b", 1, "x"), ("b", 3, "z"), ("b", 2, "y"), ("c", 0, "w")], "k string, n int, v string"
    )
    rows = policy.upsert(old, new, ["k"], F.col("n")).collect()
    assert sorted((r.k, r.v) for r in rows) == [("a", "old"), ("b", "z"), ("c", "w")]


def test_index_stats_count_repeats(spark):
    d = docs(spark, "# a\nx\n# a\nx", "y")
    assert tuple(policy.index_stats(d, policy.chunks(d)).first()) == (2, 3)
