import numpy as np
import pytest

from caseloom.llm import graph_index


@pytest.mark.parametrize("count", [100, 1_024])
def test_partners_share_a_cell(count):
    """Vectors without any groups, pairs at 0.90 to 0.93."""
    rng = np.random.default_rng(1)
    centres = graph_index.fit_centres(graph_index.unit(rng.standard_normal((16_384, 64))), count, rounds=2)
    one = graph_index.unit(rng.standard_normal((1_000, 64)))
    aside = rng.standard_normal(one.shape)
    aside = graph_index.unit(aside - (aside * one).sum(axis=1, keepdims=True) * one)
    cosine = rng.uniform(0.90, 0.93, (len(one), 1))
    two = cosine * one + np.sqrt(1 - cosine**2) * aside
    a, b = (graph_index.reached(x, centres, 0.9) for x in (one, two))
    assert (a & b).any(axis=1).mean() > 0.99


def test_a_class_is_in_as_many_graphs_however_many_cells(spark, monkeypatch):
    """Vectors without any groups, pairs at 0.90 to 0.93, in many small cells."""
    rng = np.random.default_rng(4)
    one = graph_index.unit(rng.standard_normal((1_500, 64)))
    aside = rng.standard_normal(one.shape)
    aside = graph_index.unit(aside - (aside * one).sum(axis=1, keepdims=True) * one)
    cosine = rng.uniform(0.90, 0.93, (len(one), 1))
    x = np.concatenate([one, cosine * one + np.sqrt(1 - cosine**2) * aside])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(graph_index, "FILL", 100)
    shards = graph_index.shards_of(graph_index.classes_of(vectors, "vec_id", "embedding")).cache()
    graphs = shards.where("home").groupBy("node").count()
    assert {r["count"] for r in graphs.collect()} == {graph_index.OVERLAP} and graphs.count() == len(x)
    assert shards.count() > graph_index.OVERLAP * len(x)
    near = (x @ x.T >= 0.9).sum(axis=1) - 1
    links = {r.vec_id: r.n_links for r in graph_index.near_duplicates(vectors).collect()}
    assert all(links[i] <= n for i, n in enumerate(near)) and sum(links.values()) > 0.97 * near.sum()
