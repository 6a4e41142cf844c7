"""Token totals by source, language and tokenizer version, maintained by signed changes.

A batch writes signed document rows and then, per source, language and tokenizer, the sum of
its own rows.  Totals add up these sums alone, so they cost a row per group and batch and
never look at documents again.  An insert adds a document's counts; a delete subtracts what
the ledger holds for the document; a revision does both.

Document rows lie in buckets of their id; a batch reads the buckets that its ids fall in.
:meth:`Ledger.compact` puts the rows and sums of finished batches together.

A batch is committed by the success marker that Spark writes after its sums, which come last.
What a failed job left has no such marker and is ignored and overwritten.  A batch that is
delivered again finds its marker and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.bpe import load
from caseloom.llm.common import text_or_empty

KEY = ["source", "lang", "tokenizer"]
COUNTS = ["docs", "tokens", "chars"]
SUMS = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
ROW = f"doc_id long, {SUMS}"


def counted(
    docs: DataFrame, vocabulary: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """Signed rows that insert ``docs``: one document, its tokens and its code points.

    Null texts count as empty; null sources and languages are groups of their own.  Very long
    texts are counted whole.  Repeated rows give repeated rows, no rows give none, and other
    columns are ignored.
    """

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = load(vocabulary)
        for batch in batches:
            yield pa.array(coder.count_each(batch.to_pylist()), pa.int64())

    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"),
        F.lit(1).cast("long").alias("docs"), tokens(text).alias("tokens"), F.char_length(text).cast("long").alias("chars"),
    )


class Ledger:
    """Signed token counts in a shared folder; one writer at a time.

    ``buckets`` is fixed with the first batch of a folder: a bucket of all rows should be a
    file or two.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}")

    def _finished(self, kind: str) -> list[str]:
        """Names of the complete folders of a kind."""
        if not self.system.exists(self._path(kind)):
            return []
        names = [s.getPath().getName() for s in self.system.listStatus(self._path(kind))]
        return sorted(n for n in names if self.system.exists(self._path(f"{kind}/{n}/_SUCCESS")))

    def _parts(self) -> tuple[list[str], list[str]]:
        """Folders that together hold all that counts, and the batches put together in the first."""
        batches = [n for n in self._finished("sums") if n.startswith("part=b-")]
        compacted = self._finished("covers")
        if not compacted:
            return batches, []
        last = max(compacted, key=lambda n: int(n.rpartition("-")[2]))
        covered = [r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/covers/{last}").collect()]
        return [last, *(n for n in batches if n.removeprefix("part=b-") not in set(covered))], covered

    def committed(self) -> list[str]:
        """Names of the committed batches."""
        return sorted(n.removeprefix("part=b-") for n in self._finished("sums") if n.startswith("part=b-"))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/{part}" for part in self._parts()[0]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def rows(self) -> DataFrame:
        """Signed rows of committed batches, with the ``bucket`` they lie in."""
        return self._read("rows", f"{ROW}, bucket int").select("doc_id", *KEY, *COUNTS, "bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, part: str, signed: DataFrame) -> None:
        """Rows by bucket, then their sums.  Rows of one id are added up before they move, so
        an id with very many rows is one row per task."""
        rows = signed.groupBy("doc_id", *KEY).agg(*[F.sum(c).alias(c) for c in COUNTS])
        rows = rows.where("docs != 0 or tokens != 0 or chars != 0").withColumn("bucket", self._bucket())
        path = f"{self.folder}/rows/{part}"
        rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(f"{ROW}, bucket int").parquet(path)
        sums = written.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in COUNTS])
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sums/{part}")

    def apply(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Commit a batch; False if it was committed before.

        ``inserts`` are rows of :func:`counted`; an inserted id that the ledger holds under the
        same tokenizer is revised (its old counts go).  ``deletes`` has ``doc_id``: the counts
        under every tokenizer go; unknown ids change nothing.  An id that is in both is
        replaced.  Several inserted rows of one id all count.  Null ids can be inserted, and
        never revised or deleted.  Empty tables are a batch without changes.
        """
        earlier = self.committed()
        if batch in earlier:
            return False
        signed = [self.spark.createDataFrame([], ROW)]
        if inserts is not None:
            signed.append(inserts.select("doc_id", *KEY, *COUNTS))
        if earlier:
            signed += self._taken_back(inserts, deletes)
        self._write(f"part=b-{batch}", reduce(DataFrame.unionByName, signed))
        return True

    def _taken_back(self, inserts: DataFrame | None, deletes: DataFrame | None) -> list[DataFrame]:
        """Held rows of deleted and revised ids with the opposite sign."""
        gone = again = None
        touched = set()
        if deletes is not None:
            gone = deletes.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
            touched |= {r.bucket for r in gone.select(self._bucket()).distinct().collect()}
        if inserts is not None:
            again = inserts.select("doc_id", "tokenizer").where("doc_id is not null").distinct()
            touched |= {r.bucket for r in again.select(self._bucket()).distinct().collect()}
        held = self.rows().where(F.col("bucket").isin(sorted(touched)))
        old = []
        if gone is not None:
            old.append(held.join(gone, "doc_id", "left_semi"))
            held = held.join(gone, "doc_id", "left_anti")
        if again is not None:
            old.append(held.join(again, ["doc_id", "tokenizer"], "left_semi"))
        return [rows.select("doc_id", *KEY, *[(-F.col(c)).alias(c) for c in COUNTS]) for rows in old]

    def compact(self) -> None:
        """Put rows and sums of all committed batches together; totals and the names of the
        batches stay.  Counts until the list of batches is written, which comes last, are
        read from where they were."""
        parts, _ = self._parts()
        if len(parts) < 2:
            return
        number = 1 + max((int(n.rpartition("-")[2]) for n in self._finished("covers")), default=0)
        part = f"part=c-{number}"
        batches = self.spark.createDataFrame([(b,) for b in self.committed()], "batch string")
        self._write(part, self.rows().drop("bucket"))
        batches.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/covers/{part}")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens, chars`` of what is not deleted; groups
        without documents are left out."""
        sums = [F.sum(c).alias(c) for c in COUNTS]
        return self._read("sums", SUMS).groupBy(*KEY).agg(*sums).where("docs != 0").select(*KEY, *COUNTS)
