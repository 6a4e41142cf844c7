"""Corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import bpe, decontaminate, secrets, simhash, toxicity
from caseloom.llm.common import delete, free_name, scratch_path, stage, table
from caseloom.session import staging


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores below its cut; null and empty texts are scored too, very long
    ones whole.  Repeated rows go or stay together, no rows give no rows, own columns stay as they are."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "toxicity")
    scored = toxicity.score(docs, model, out=score)
    return scored.where(F.col(score) < toxicity.CUT).select(*docs.columns)


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells rows apart: the place in the Parquet file that a row is read
    from.  Other frames are written first."""
    place = free_name(docs.columns, "place")
    at = F.struct("_metadata.file_path", "_metadata.row_index").alias(place)
    try:
        return docs.select(*docs.columns, at), place
    except AnalysisException:
        return stage(docs, "placed").select(*docs.columns, at), place


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (SimHash of four-word shingles, four bits): that with the
    smallest id, a row without an id only if no other is in the group.  Of rows with that id one stays.

    Null and empty texts are copies of each other, very long ones are taken whole; no rows give
    no rows.  Texts are not copied: rows are known by their place in the file."""
    placed, place = _placed(docs)
    row = free_name(placed.columns, "near_row")
    numbered = placed.withColumn(row, F.monotonically_increasing_id())
    known = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(place).alias("place"))
    marked = stage(simhash.near_duplicates(numbered, row, carry=known), "near-rows")
    # Written, so that the join has an exchange on both sides and a large group is split in it.
    first = stage(marked.groupBy("component_id").agg(F.min("carried").alias("first")), "near-first")
    rest = marked.join(first, "component_id").where(F.col("carried") != F.col("first"))
    return placed.join(rest.select(F.col("carried.place").alias(place)), place, "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found; null, empty and wordless texts hold none, very long ones
    are searched whole, repeated rows go or stay together, and no rows give no rows."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced; ``n_chars`` follows the text, if there is such a column.

    Null texts stay null, empty and very long ones are scanned whole, repeated rows stay, no rows give no rows."""
    clean = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; null texts count as empty and have
    no tokens, very long ones are encoded whole, repeated rows stay, no rows give no rows."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near-dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("byte pairs", encoded),
]

# Hashing, a trained classifier, latent search and tokens are not SQL; tests/llm compares the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``.  What a stage stages, and its predecessor's rows, go once
    its own rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, work in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with staging(spark):
            kept = work(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return docs
