"""Queue, pages, lookups, and the datasets of the daily job."""

import pytest
from pyspark.sql import functions as F

from caseloom import schemas, session
from caseloom.operators import triage
from caseloom.operators.packet import CaseFrames, Limits
from caseloom.plans import daily
from caseloom.plans.views import SQL_VIEWS, register_views
from caseloom.sources import datasets
from tests.rows import DAY, alert, inputs, txn


@pytest.fixture(scope="module")
def given(spark):
    scores = [70.0, 90.0, None, 90.0, 10.0, 70.0, 70.0]
    return inputs(
        spark,
        alerts=[alert(f"a{i}", party=f"P{i}", risk_score=s) for i, s in enumerate(scores)],
        transactions=[txn("x", party="P1", ts=5), txn("y", party="P3", ts=9),
                      txn("z", party="P0", ts=1), txn("w", party="P0", ts=2 * DAY, instrument_type="ngi")],
        parties=[{"party_id": "P1", "party_name": "One"}],
    )


@pytest.fixture(scope="module")
def out(spark, given, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("out"))
    daily.run(spark, given, folder, Limits())
    daily.run(spark, given, folder, Limits())  # outputs are replaced, not added to
    return folder


@pytest.fixture(scope="module")
def packets(spark, out):
    return datasets.read_dataset(spark, out, "case_packet")


def expected_order(packets):
    low = float("-inf")
    return sorted(
        packets.select(*triage.QUEUE_COLUMNS).collect(),
        key=lambda r: (
            -(low if r.max_risk_score is None else r.max_risk_score),
            -(low if r.last_txn_ms_utc_case is None else r.last_txn_ms_utc_case),
            r.case_id,
        ),
    )


def test_queue_order_puts_nulls_last(spark, packets, out):
    wanted = [r.case_id for r in expected_order(packets)]
    assert [r.case_id for r in triage.queue(packets).collect()] == wanted
    stored = spark.read.parquet(f"{out}/case_queue").orderBy("position").collect()
    assert [r.case_id for r in stored] == wanted


@pytest.mark.parametrize("shallow", [10_000, 0])
def test_pages(packets, monkeypatch, shallow):
    monkeypatch.setattr(triage, "SHALLOW", shallow)
    wanted = [r.case_id for r in expected_order(packets)]
    for limit, offset in [(3, 0), (3, 2), (50, 5), (9999, 0), (2, 7)]:
        rows = triage.page(packets, limit, offset).collect()
        assert [r.case_id for r in rows] == wanted[offset : offset + limit]
        assert [r.position for r in rows] == list(range(offset, min(7, offset + limit)))
        assert all(r.total == 7 for r in rows)


def test_page_bounds(packets):
    for limit, offset in [(0, 0), (1, -1)]:
        with pytest.raises(ValueError):
            triage.page(packets, limit, offset)


def test_pages_of_the_written_queue(spark, packets, out):
    numbered = datasets.read_dataset(spark, out, "case_queue")
    wanted = [r.case_id for r in expected_order(packets)]
    for limit, offset in [(3, 0), (2, 5), (50, 6), (5, 7)]:
        rows = triage.stored_page(numbered, limit, offset).collect()
        assert [r.case_id for r in rows] == wanted[offset : offset + limit]
        assert all(r.total == 7 for r in rows)
    plan = triage.stored_page(numbered, 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(position,5)" in plan


def test_the_job_checks_its_tables_and_clears_its_scratch(spark, given, out, tmp_path):
    found = spark.read.parquet(f"{out}/contract")
    outputs = found.where(F.col("table").isin(*schemas.OUTPUTS)).collect()
    assert {(r.table, r.rule) for r in outputs} == {
        ("case_packet", "unique"), ("case_queue", "unique"),
        ("case_queue", "required"), ("tx_timeline_daily", "required"),
    }
    assert all(r.violations == 0 for r in outputs)
    with session.staging(spark) as staged:
        daily.run(spark, given, str(tmp_path / "again"), files=3, checked=False)
        assert staged() == []
        frame = session.stage(spark.range(3), "rows")
        assert frame.count() == 3 and session.stored_bytes(spark, staged()[0]) > 0
    assert not spark._jvm.java.io.File(frame.inputFiles()[0].removeprefix("file://")).exists()
    assert not (tmp_path / "again" / "contract").exists()


def test_page_size_is_clamped(packets, monkeypatch):
    monkeypatch.setattr(triage, "PAGE_MAX", 2)
    assert triage.page(packets, 100).count() == 2


def test_lookups(spark, packets, out):
    case = packets.where("party_id = 'P0'").first().case_id
    assert triage.case_packet(packets, case).first().party_id == "P0"
    with pytest.raises(triage.CaseNotFound):
        triage.case_packet(packets, "nothing")
    timeline = datasets.read_dataset(spark, out, "tx_timeline_daily")
    days = triage.case_timeline(timeline, case).collect()
    assert [(d.txn_date_utc, d.instrument_type) for d in days] == [
        ("1970-01-01", "cash"), ("1970-01-03", "ngi"),
    ]
    assert triage.case_timeline(timeline, "nothing").count() == 0
    ids = spark.createDataFrame([(case,), (case,), ("nothing",)], "case_id string")
    assert triage.of_cases(packets, ids).count() == 1


def test_counterparties_of_one_case(packets):
    case = packets.where("party_id = 'P0'").first().case_id
    rows = triage.case_counterparties(packets, case).collect()
    assert [(r.counterparty_id, r.txn_count, r.amount_total_usd) for r in rows] == [("C1", 2, 20.0)]


def test_lookup_filter_reaches_the_scan(packets):
    plan = packets.where("case_id = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(case_id), EqualTo(case_id,x)]" in plan


def test_queue_reads_its_columns_only(packets):
    plan = triage.queue(packets)._jdf.queryExecution().executedPlan().toString()
    assert "alerts_count" in plan and "supporting_transactions" not in plan


def test_files_hold_disjoint_ranges_of_ids(spark, out):
    rows = spark.read.parquet(f"{out}/case_packet").selectExpr("_metadata.file_path f", "case_id")
    bounds = rows.groupBy("f").agg(F.min("case_id").alias("lo"), F.max("case_id").alias("hi"))
    files = sorted((r.lo, r.hi) for r in bounds.collect())
    assert len(files) > 1
    assert all(left[1] < right[0] for left, right in zip(files, files[1:]))


def test_every_view_answers(spark, given):
    register_views(spark, CaseFrames(given))
    for name in SQL_VIEWS:
        spark.table(name).collect()
    top = spark.sql("SELECT party_id FROM v_case_queue LIMIT 1").first()
    assert top.party_id == "P3"
    opened = spark.sql("SELECT counterparty_id, txn_count FROM v_top_counterparties WHERE party_id = 'P0'")
    assert [tuple(r) for r in opened.collect()] == [("C1", 2)]


def test_a_view_builds_only_what_it_reads(spark, given):
    frames = CaseFrames(given)
    register_views(spark, frames, ["v_alert_summary"])
    assert spark.table("v_alert_summary").count() == 7
    assert "packet" not in vars(frames) and "tx_case" not in vars(frames)
    with pytest.raises(KeyError):
        register_views(spark, frames, ["v_nothing"])
