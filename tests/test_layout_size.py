"""Datasets are shuffled narrow and written small."""

from pyspark.sql import functions as F

from caseloom import schemas, session
from caseloom.operators.packet import CaseFrames, with_case_id
from caseloom.sources import datasets
from tests.rows import DAY, alert, inputs, txn


def given(spark):
    days = [txn(f"T{p}-{i}", party=p, ts=i * DAY // 2, merchant_id="M1") for p in ("P1", "P2", "P3") for i in range(9)]
    return inputs(spark, transactions=days, alerts=[alert("1", party="P1", start=0, end=3 * DAY - 1), alert("2", party="P2", start=5, end=2 * DAY)])


def rows(df):
    return sorted(map(repr, df.collect()))


def test_ids_of_a_layout_are_made_after_its_shuffle(spark, tmp_path):
    timeline = CaseFrames(given(spark), staged=False).timeline
    columns = schemas.schema("tx_timeline_daily").fieldNames()
    datasets.write_by_case(timeline, f"{tmp_path}/late", 3, columns)
    datasets.write_by_case(with_case_id(timeline).select(*columns), f"{tmp_path}/early", 3)
    late, early = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("late", "early"))
    assert late.columns == early.columns == columns and rows(late) == rows(early) != []
    files = late.select("case_id", F.col("_metadata.file_name").alias("f")).distinct()
    assert files.groupBy("case_id").count().where("count > 1").isEmpty()


def test_tables_are_written_small(spark):
    assert all(name.endswith(".zstd.parquet") for name in session.stage(spark.range(5), "rows").inputFiles())
