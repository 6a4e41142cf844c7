"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import (
    bpe,
    decontaminate,
    extraction,
    graph_index,
    packing,
    phrases,
    secrets,
    seqfile,
    simhash,
    token_counts,
    toxicity,
    urlrules,
    whitening,
)
from caseloom.llm.common import scratch_path, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "sequences")
    parts = seqfile.write(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return seqfile.read_documents(spark, folder, parts)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.CUT).cast("int").alias("predicted"),
    )


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op5_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; then those labelled of low quality are deleted and those with
    runs of blanks are revised to single blanks, in a batch that is delivered twice."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    ledger = token_counts.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.apply("0001", inserts=token_counts.counted(docs, path, "byte_bpe_50k"))
    gone = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    revised = docs.where(F.col("text").rlike(r"\s\s")).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    revised = revised.join(gone, "doc_id", "left_anti")
    for _ in range(2):
        ledger.apply("0002", token_counts.counted(revised, path, "byte_bpe_50k"), gone)
    return ledger.totals()


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.named(F.col("base")), 256).alias("base_sha256"),
        secrets.named(F.col("spans")).alias("spans"),
    )


def op10_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_sequences, op3_toxicity, op4_main_text, op5_byte_pairs, op6_token_totals,
        op7_url_rules, op8_decontaminate, op9_secrets, op10_graph, op11_phrases, op12_whitening,
        op13_packing,
    )
}
