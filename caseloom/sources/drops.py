"""Input files taken as they are dropped, each once.

Spark's file stream remembers in a checkpoint which files it has taken.  A run takes all files
that are new and ends.  Each micro-batch is written to a folder of its own number, over what a
failed attempt left there, so neither a failure nor a repeated delivery under the same name gives a
row twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.sources.datasets import CSV_DIALECT

FILES_PER_BATCH = 1_000


def take_drops(
    spark: SparkSession, files: str, schema: T.StructType, store: str, files_per_batch: int = FILES_PER_BATCH
) -> int:
    """Take the files that match ``files`` and were not taken before; the number of new micro-batches.

    ``store`` gets the rows (``rows/batch=N``) with the name of their file, and the checkpoint.  A file
    counts as taken by its name alone, also when it is dropped again into another folder.
    A file that does not fit ``schema`` fails the run; nothing of its micro-batch is stored.
    """
    drops = (
        spark.readStream.options(**CSV_DIALECT)
        .schema(schema)
        .option("fileNameOnly", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(files)
        .withColumn("source_file", F.url_decode(F.col("_metadata.file_name")))
    )
    taken = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/rows/batch={number}")
        taken.append(number)

    run = (
        drops.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{store}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    try:
        run.awaitTermination()
    finally:
        run.stop()
    return len(taken)


def _finished(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the micro-batches that the checkpoint has as finished."""
    try:
        names = spark.read.format("binaryFile").load(f"{store}/checkpoint/commits").select("path")
        rows = names.select(F.regexp_extract("path", "([0-9]+)$", 1).alias("n")).where("n <> ''").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(int(r["n"]) for r in rows)


def read_drops(spark: SparkSession, schema: T.StructType, store: str) -> DataFrame:
    """All rows taken so far, with ``source_file``; none before the first drop.  Rows of a micro-batch
    that is not finished are left out: a later run writes them again."""
    stored = T.StructType([*schema.fields, T.StructField("source_file", T.StringType())])
    folders = [f"{store}/rows/batch={n}" for n in _finished(spark, store)]
    if not folders:
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).parquet(*folders)
