import hashlib

import corpus_pipeline
import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from caseloom.llm import decontaminate, graph_index, toxicity
from caseloom.llm.common import table
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_text_operators import plain_base

SF = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<float>"


def groups(n, d=16, seed=9, noise=0.06):
    """Vectors alone, in small groups, and one large group."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre = rng.standard_normal(d)
        size = n // 3 if not out else int(rng.choice([1, 1, 1, 2, 5]))
        out += [centre + noise * np.linalg.norm(centre) * rng.standard_normal(d) / 1.5 for _ in range(size)]
    out = np.array(out[:n], np.float32)
    return out[rng.permutation(n)]


def brute(x):
    u = graph_index.unit(x)
    return (u @ u.T >= graph_index.COSINE) & ~np.eye(len(x), dtype=bool)


def test_graph_against_brute_force(spark, monkeypatch):
    x = groups(900)
    near = brute(x)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND)
    monkeypatch.setattr(graph_index, "SHARD", 128)  # the large group is cut into chunks
    monkeypatch.setattr(graph_index, "FILL", 100)
    result = graph_index.near_duplicates(vectors)
    rows = {r.vec_id: r for r in result.collect()}
    found = sum(r.n_links for r in rows.values())
    assert found >= 0.97 * near.sum() and all(rows[i].n_links <= near[i].sum() for i in rows)
    expected = list(range(len(x)))
    for i in range(len(x)):  # smallest row reachable
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if int(j) not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        expected[i] = min(seen)
    assert np.mean([rows[i].component_id == expected[i] for i in rows]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows.values())
    audit = graph_index.audit(vectors, result, queries=200).first()
    assert audit.queries == 200 and audit.recall >= 0.95


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    x = graph_index.unit(np.array([[1, 0, 0], [1, 0.1, 0], [1, 0.12, 0], [0, 1, 0], [0, 0, 1]], float))
    pool = np.array([[1, 2, 3, 4, -1]])
    kept = graph_index.prune(x, np.array([0]), pool, np.array([[*(x[0] @ x[1:].T), -2]]))
    assert kept[0, 0] == 1 and 2 not in kept[0] and {3, 4} <= set(kept[0].tolist())


def test_graph_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-30, 0.0]), (0, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, KIND).selectExpr("*", "'clash' AS node", "1 AS n_links", "2 AS cells", "3 AS vector")
    got = graph_index.near_duplicates(vectors).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: tuple(r)[1:] for r in got}
    assert by[1] == (4, 1, True) and by[2] == (4, 1, False) and by[3] == (4, 1, False) and by[12] == (4, 1, False)
    for alone in (0, 4, 5, 6, 7, 8, 9, 10, 11):
        assert by[alone] == (0, alone, True)
    assert by[None] == (0, None, False)
    assert graph_index.near_duplicates(vectors.limit(0)).collect() == []


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    kept = [r for r in toxicity.score(docs, model).collect() if r.toxicity < toxicity.CUT]
    components = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in kept])
    kept = [r for r in kept if components[r.doc_id] == r.doc_id]
    items = [decontaminate.split(r.text) for r in table(spark, SF, "benchmark").collect()]
    joined = [b" " + b" ".join(i) + b" " for i in items]
    clean = {r.doc_id: r.text for r in kept if not any(i in b" " + b" ".join(decontaminate.split(r.text)) + b" " for i in joined)}
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    # the latent search may find items in other words as well
    assert set(rows) <= set(clean) and len(rows) >= len(clean) - 2
    for doc_id, r in rows.items():
        spans, text, last = [tuple(map(int, s.split(":")[1:])) for s in plain_base(clean[doc_id])], "", 0
        for start, end in spans:
            if start >= last:
                text += clean[doc_id][last:start] + "[SECRET]"
            last = max(last, end)
        text += clean[doc_id][last:]
        if hashlib.sha256(text.encode()).hexdigest() == r.decoded_sha256:
            ids = library.encode(text, add_special_tokens=False).ids
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        else:  # a value that several owners have
            assert spans


def test_stages_with_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (2, "", "en", "a", 0), (None, "no id at all, only some words here", "en", "b", 34),
            (3, "token = abcdefabcdefabcdef", "en", "c", 26), (4, "long " * 50_000, "en", "c", 250_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "nothing of this is anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given, wanted in ((rows, 4), ([], 0)):
        docs = spark.createDataFrame(given, schema)
        for name, work in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = work(spark, docs, str(tmp_path))
            docs.write.parquet(f"{tmp_path}/{name}-{wanted}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{wanted}")
            assert name == "byte pairs" or docs.columns == columns
        assert docs.count() == wanted


def test_stages_keep_columns_of_their_own_names(spark, tmp_path):
    own = ["toxicity", "near_row", "place", "place_", "base", "same", "row", "spans", "component_id", "carried", "source", "lang"]
    text = "one two three four five six seven eight nine ten"
    rows = [(i, t, *range(len(own))) for i, t in [(3, text), (1, text), (1, text), (None, text), (None, ""), (None, None), (7, "alone here")]]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in own)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "nothing of this is anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, work in corpus_pipeline.STAGES[:-1]:
        kept = work(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        got = kept.collect()
        assert all(list(r)[2:] == list(range(len(own))) for r in got), name
    assert len(got) == 7
    for given in (docs, None):  # rows in memory, and rows of a file
        if given is None:
            docs.write.parquet(f"{tmp_path}/documents.parquet")
            given = spark.read.parquet(f"{tmp_path}/documents.parquet")
        kept = corpus_pipeline.without_near_copies(spark, given, str(tmp_path)).collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (1, text), (7, "alone here")]
