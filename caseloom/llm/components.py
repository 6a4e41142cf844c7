"""Connected components of a link table, by alternating star contractions.

A large-star step hangs every larger neighbour of a node on the smallest node around it, a
small-star step does the same with the smaller neighbours.  Both keep the components and
end in stars whose centre is the smallest node.  Every round is a few shuffles by node and
one staged table; nothing is collected.  A node with very many links is combined before
the shuffle (minimum) and split by adaptive skew handling (join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import delete, scratch_path


def _written(df: DataFrame, rounds: int) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, f"stars-{rounds}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has a link to another node.

    ``links`` holds undirected links as two columns of one orderable type; ``component``
    is the smallest node reachable.  Null ends, loops and repeated links are ignored; no
    links give no rows.
    """
    spark = links.sparkSession
    start = (
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    stars, path = _written(start, 0)
    mark, rounds = _mark(stars), 0
    while mark[0]:
        rounds += 1
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("u").agg(F.min("v").alias("low"))
        around = around.select("u", F.least("u", "low").alias("low"))
        large = (
            both.join(around, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .distinct()
        )
        large, large_path = _written(large, rounds)
        below = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(below, "u")
            .where(F.col("v") != F.col("low"))
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .union(below.select("u", F.col("low").alias("v")))
            .distinct()
        )
        stars, new_path = _written(small, rounds)
        now = _mark(stars)
        delete(spark, large_path)
        delete(spark, path)
        path = new_path
        if now == mark:
            break
        mark = now
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(centres)
