"""Readers and writers of the exchanged files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom import schemas
from caseloom.functions.cases import case_id
from caseloom.session import COMPRESSED, give_back

# Dialect of the input files.
CSV_DIALECT = {
    "header": "true",
    "mode": "FAILFAST",
    "quote": '"',
    "escape": '"',
    "multiLine": "false",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
}


# Bytes that one sorting and writing task should have.
FILE_BYTES = 256 << 20


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, match_header: bool = False
) -> DataFrame:
    """Typed scan of one file, folder or glob; several files are concatenated.

    Columns bind by position.  ``match_header`` also requires every file's header
    to name the schema's columns in order.
    """
    reader = spark.read.options(**CSV_DIALECT).schema(schema)
    return reader.option("enforceSchema", str(not match_header).lower()).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write in the dialect that :func:`read_csv` expects."""
    df.write.options(header="true", quote='"', escape='"').csv(path)


def write_named_csv(df: DataFrame, folder: str, name: str) -> None:
    """Write one file of a given name, as exchanged files have: the rows must be few enough for one
    task.  The file appears under its name when it is whole."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    made = f"{folder}/.{name}-made"
    write_csv(df.coalesce(1), made)
    system = path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(path(f"{made}/part-*")):
        system.rename(status.getPath(), path(f"{folder}/{name}"))
    system.delete(path(made), True)


def read_inputs(spark: SparkSession, base: str, match_header: bool = False) -> dict[str, DataFrame]:
    """The five inputs of a run; alerts come from one file per model family."""
    return {
        name: read_csv(
            spark,
            f"{base}/alerts_*.csv" if name == "alerts" else f"{base}/{name}.csv",
            schemas.schema(name),
            match_header,
        )
        for name in schemas.INPUTS
    }


def file_count(spark: SparkSession, size: int = 0) -> int:
    """Files for a dataset of about ``size`` bytes: a task's share each, and at least as many
    as there are shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // FILE_BYTES))


def write_by_case(df: DataFrame, path: str, files: int | None = None, columns: list[str] | None = None) -> None:
    """Overwrite a dataset, laid out for reads by case id.

    Ids are hashes, so cutting their range into equal slices gives even files
    without a sampling pass.  File i holds slice i in order, and a filter on one id
    leaves one file's row group to read.

    A frame under the case key gets its ids after the shuffle: for narrow rows they are
    most of what would be moved.  ``columns`` are those written, all by default.
    """
    if files is None:
        files = file_count(df.sparkSession)
    named = "case_id" in df.columns
    own = F.col("case_id") if named else case_id()
    head = F.conv(F.substring(own, 1, 6), 16, 10).cast("bigint")
    slice_no = F.floor(head * files / F.lit(16**6)).cast("int")
    laid_out = df.repartitionById(files, slice_no)
    if not named:
        laid_out = laid_out.select(own.alias("case_id"), *df.columns)
    laid_out = laid_out.sortWithinPartitions("case_id").select(*(columns or laid_out.columns))
    laid_out.write.options(**COMPRESSED).mode("overwrite").parquet(path)
    give_back(df.sparkSession, path)


def read_dataset(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.schema(name)).parquet(f"{base}/{name}")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        for name, df in tables.items()
    ]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out
