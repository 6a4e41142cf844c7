"""Queries and items of the exact search are not repeated in a shuffle."""

import random

from caseloom.operators import nearest as N
from caseloom.operators.ranking import with_position
from pyspark.sql import functions as F

from tests.test_policy import plain_nearest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_are_read_beside_the_queries_however_many_blocks(spark, conf, monkeypatch):
    for name, value in (("QUERY_BLOCK", 8), ("TILE", 3), ("OUT_ROWS", 4)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(3)
    vectors = [[float(rng.randrange(-2, 3)) for _ in range(6)] for _ in range(90)]
    queries = {f"q{n:02d}": v for n, v in enumerate(vectors[:30])} | {"zero": [0.0] * 6, "odd": [1.0, 2.0]}
    # Ids in another order than rows, copies in several blocks, other lengths and no length.
    items = {f"i{(7 * n) % 90:02d}": vectors[n % 50] for n in range(90)}
    items |= {"zero": [0.0] * 6, "odd": [3.0], "long": [1.0] * 9}
    q = spark.createDataFrame(list(queries.items()), "query_id string, vector array<double>")
    i = spark.createDataFrame(list(items.items()), "item_id string, vector array<double>")
    conf(spark__sql__adaptive__enabled="false")
    for rows in (1, 4, 7, 200):
        best = N.nearest(q, i, 4, decimals=12, block_bytes=rows * 8 * 9, pays=-1.0)
        text = plan(best)
        assert "CoGroup" not in text and text.count("Exchange ") == 1 and "Generate" not in text
        got = {}
        for r in best.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.item_id, round(r.score, 12) + 0.0))
        wanted = plain_nearest(queries, items, 4)
        assert got == {key: [(n + 1, i, s + 0.0) for n, (i, s) in enumerate(v)] for key, v in wanted.items()}


def test_an_id_that_repeats_has_the_best_of_all_its_rows(spark):
    rows = [("q", [1.0, 0.0]), ("q", [0.0, 1.0]), ("p", [1.0, 1.0]), (None, [1.0, 0.0]), (None, [1.0, 0.0])]
    q = spark.createDataFrame(rows, "query_id string, vector array<double>")
    i = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 0.2]), (1, [2.0, 0.0])], "item_id int, vector array<double>")
    found = {}
    for r in N.nearest(q, i, 3).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.item_id))
    assert {key: sorted(v) for key, v in found.items()} == {
        "q": [(1, 1), (2, 1), (3, 2)], "p": [(1, 3), (2, 1), (3, 1)], None: [(1, 1), (2, 1), (3, 1)],
    }


def test_rows_numbered_as_one_group_are_not_shuffled_again(spark, conf):
    conf(spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1")
    numbered = with_position(spark.range(50).repartition(3).withColumn("wide", F.lit("x")), [], [F.col("id").desc()])
    assert "SortMergeJoin" not in plan(numbered)
    assert {r.id: r.position for r in numbered.collect()} == {n: 49 - n for n in range(50)}
