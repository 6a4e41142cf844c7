"""The policy job: a folder of documents into the passage index.

A generation of the index is three folders: ``documents`` (an entry per document, without texts),
``chunks`` (only chunks that no earlier generation has, by leading digit of their id) and
``parts`` (the generations whose chunks make up the index).  Documents whose content hash the index
has already are neither cut nor embedded again.  As a chunk's id covers its content, chunks of
different generations never replace each other, so readers take all parts as they are.  When
there are many parts, a generation takes over the chunks of all of them.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import policy
from caseloom.session import build_session, delete_folder, stage, staging
from caseloom.sources import generations
from caseloom.sources.corpus import read_corpus
from caseloom.sources.datasets import file_count

# Generations with chunks of their own that a reader takes together at most.
PARTS = 8


def changed_documents(documents: DataFrame, entries: DataFrame | None) -> DataFrame:
    """Documents that have no entry with the same content; all if there are no entries."""
    if entries is None:
        return documents
    known = entries.select("doc_id", "version", "content_hash")
    hashed = documents.withColumn("content_hash", F.sha2("text", 256))
    return hashed.join(known, known.columns, "left_anti").select(*documents.columns)


def _parts(spark: SparkSession, root: str, generation: str | None) -> list[str]:
    if generation is None:
        return []
    return sorted(r["part"] for r in spark.read.schema("part STRING").parquet(f"{root}/{generation}/parts").collect())


def _chunks(spark: SparkSession, root: str, parts: list[str]) -> DataFrame:
    paths = [f"{root}/{part}/chunks" for part in parts]
    schema = spark.read.parquet(paths[-1]).schema
    found = [spark.read.schema(schema).parquet(path) for path in paths]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _write_chunks(chunks: DataFrame, path: str) -> None:
    """By leading digit of the id, so that later generations look up only the digits they have."""
    placed = chunks.withColumn("bucket", F.substring("chunk_id", 1, 1))
    tasks = file_count(chunks.sparkSession)
    spread = F.floor(F.conv(F.substring("chunk_id", 1, 6), 16, 10).cast("bigint") * tasks / F.lit(16**6)).cast("int")
    placed.repartitionById(tasks, spread).sortWithinPartitions("bucket", "chunk_id").write.mode("overwrite").partitionBy(
        "bucket"
    ).parquet(path)


def update(spark: SparkSession, documents: DataFrame, root: str, generation: str, parts: int = PARTS) -> None:
    """Merge ``documents`` into the index below ``root`` as a new generation.

    Readers keep the old generation until the pointer is replaced, so a failed run
    changes nothing and can be repeated under the same name.  ``generation`` names must sort
    by age.  Beyond ``parts`` generations the chunks of all are written together.
    """
    before = generations.newer(spark, root, generation)
    target, held = f"{root}/{generation}", _parts(spark, root, before)
    entries = policy.document_entries(documents)
    old = None if before is None else spark.read.parquet(f"{root}/{before}/documents")
    known = entries.limit(0) if old is None else old
    policy.upsert_documents(known, entries).write.mode("overwrite").parquet(f"{target}/documents")
    with staging(spark):
        cut = policy.chunks(changed_documents(documents, old))
        fresh = policy.upsert_chunks(cut.limit(0), cut)
        if held:
            fresh = fresh.join(_chunks(spark, root, held).select("chunk_id"), "chunk_id", "left_anti")
            fresh = stage(fresh.select(*cut.columns), "fresh-chunks")
        new = policy.embed(fresh)
        together = len(held) >= parts
        if together:
            new = _chunks(spark, root, held).drop("bucket").unionByName(new)
        # A generation without new chunks is no part of the index.
        added = together or not held or not fresh.isEmpty()
        if added:
            _write_chunks(new, f"{target}/chunks")
    kept = [] if together else held
    names = [(part,) for part in [*kept, *([generation] if added else [])]]
    spark.createDataFrame(names, "part STRING").coalesce(1).write.mode("overwrite").parquet(f"{target}/parts")
    generations.publish(spark, root, generation)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """All chunks of the newest generation, each once."""
    current = generations.current(spark, root)
    if current is None:
        raise FileNotFoundError(f"no index below {root}")
    return _chunks(spark, root, _parts(spark, root, current)).drop("bucket")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """The entry of every document of the newest generation."""
    current = generations.current(spark, root)
    if current is None:
        raise FileNotFoundError(f"no index below {root}")
    return spark.read.parquet(f"{root}/{current}/documents")


def vacuum(spark: SparkSession, root: str, old: list[str]) -> list[str]:
    """Delete what the newest generation does not need of the ``old`` ones; their deleted folders."""
    current = generations.current(spark, root)
    needed = {*_parts(spark, root, current)}
    paths = [f"{root}/{name}/documents" for name in old if name != current]
    paths += [f"{root}/{name}/chunks" for name in old if name not in needed]
    return [path for path in paths if delete_folder(spark, path)]


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--policy-corpus", default="policy_corpus", help="folder of documents")
    parser.add_argument("--index", default="policy_index", help="folder of the index")
    parser.add_argument("--generation", required=True, help="name of the new generation")
    args = parser.parse_args()
    spark = build_session("caseloom-policy-index")
    try:
        update(spark, read_corpus(spark, args.policy_corpus), args.index, args.generation)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
