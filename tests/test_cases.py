"""Case rules on hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from caseloom.functions.cases import CASE_KEY, case_id, pipe_items, usd, utc_day
from caseloom.operators import cases as C
from caseloom.operators import evidence as E
from caseloom.operators.packet import CaseFrames, Limits, packet_json
from tests.rows import DAY, alert, inputs, table, txn


def tx_ids(frames):
    rows = frames.tx_case.select(*CASE_KEY, "txn_id").collect()
    return sorted((r[1], r[2], r[3]) for r in rows)


def test_window_ends_are_inclusive_and_windows_may_overlap(spark):
    given = inputs(
        spark,
        transactions=[txn("a", ts=100), txn("b", ts=200), txn("c", ts=99), txn("d", ts=201),
                      txn("e", party="P2", ts=150), txn("n", ts=None)],
        alerts=[alert("1", start=100, end=200), alert("2", start=100, end=200),
                alert("3", start=200, end=40 * DAY), alert("4", start=300, end=100)],
    )
    frames = CaseFrames(given, staged=False)
    assert frames.cases.count() == 3
    assert tx_ids(frames) == [
        (100, 200, "a"), (100, 200, "b"),
        (200, 40 * DAY, "b"), (200, 40 * DAY, "d"),
    ]


def test_window_join_equals_brute_force(spark):
    rng = random.Random(7)
    spans = [0, 1, DAY - 1, DAY, 3 * DAY, 64 * DAY, 365 * DAY, 5000 * DAY]
    txns = [
        (f"t{i}", rng.choice(["P1", "P2"]), rng.randrange(-50 * DAY, 400 * DAY)) for i in range(300)
    ]
    windows = set()
    for _ in range(60):
        start = rng.randrange(-60 * DAY, 380 * DAY)
        windows.add((rng.choice(["P1", "P2", "P3"]), start, start + rng.choice(spans)))
    windows.add(("P1", -(2**62), 2**62))
    given = inputs(
        spark,
        transactions=[txn(i, party=p, ts=ts) for i, p, ts in txns],
        alerts=[alert(f"a{k}", party=p, start=s, end=e) for k, (p, s, e) in enumerate(windows)],
    )
    joined = C.transactions_in_cases(given["transactions"], C.case_index(given["alerts"]))
    found = sorted(tuple(r) for r in joined.select(*CASE_KEY, "txn_id").collect())
    wanted = sorted(
        (p, s, e, i) for p, s, e in windows for i, tp, ts in txns if tp == p and s <= ts <= e
    )
    assert found == wanted


def test_no_windows_no_transactions(spark):
    for alerts in ([], [alert("1", start=9, end=3)]):
        frames = CaseFrames(inputs(spark, transactions=[txn("a", ts=5)], alerts=alerts))
        assert frames.tx_case.count() == 0
        assert frames.packet.count() == len(alerts)


def test_span_of_windows_reaches_the_scan(spark, tmp_path):
    given = inputs(spark, transactions=[txn("a", ts=5)], alerts=[alert("1", start=3, end=9)])
    given["transactions"].write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    joined = C.transactions_in_cases(stored, C.case_index(given["alerts"]))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(txn_timestamp_ms_utc,3)" in plan
    assert joined.count() == 1


def test_alerts_without_a_whole_key_make_an_empty_case(spark):
    given = inputs(spark, alerts=[alert("1", start=None), alert("2")], transactions=[txn("a", ts=5)])
    rows = CaseFrames(given).packet.select("case_window_start_ms_utc", "alerts_count").collect()
    assert sorted(map(tuple, rows), key=str) == [(0, 1), (None, None)]


def test_fx_and_id_lists_and_days(spark):
    df = spark.createDataFrame(
        [("EUR", 2.0, "a||b|", -1), ("JPY", 2.0, None, 0), (None, 2.0, "", DAY), ("USD", 2.0, "x", 1)],
        "currency string, amount double, ids string, ms bigint",
    )
    rows = df.select(usd(), pipe_items("ids"), utc_day("ms")).collect()
    assert [tuple(r) for r in rows] == [
        (2.2, ["a", "b"], "1969-12-31"),
        (2.0, [], "1970-01-01"),
        (2.0, [], "1970-01-02"),
        (2.0, ["x"], "1970-01-01"),
    ]


def test_days_do_not_depend_on_the_session_zone(spark, conf):
    conf(spark__sql__session__timeZone="America/New_York")
    df = spark.createDataFrame([(DAY,)], "ms bigint")
    assert df.select(utc_day("ms")).first()[0] == "1970-01-02"


def test_case_id_is_the_hash_of_the_key(spark):
    import hashlib

    df = spark.createDataFrame([("P1", 0, 5)], "p string, s bigint, e bigint").toDF(*CASE_KEY)
    assert df.select(case_id()).first()[0] == hashlib.sha256(b"P1||0||5").hexdigest()


def test_case_without_transactions_has_nulls(spark):
    given = inputs(spark, alerts=[alert("1")])
    row = CaseFrames(given).packet.first()
    assert row["alerts_count"] == 1 and len(row["alerts"]) == 1
    for name in ("txn_count_case", "amount_total_usd_case", "top_counterparties", "party_name",
                 "instrument_types_case", "supporting_transactions"):
        assert row[name] is None
    text = packet_json(CaseFrames(given).pages).first()[1]
    assert "party_name" not in text and '"tx_summary":{}' in text


def test_severity_counts_are_zero_not_null(spark):
    alerts = C.alerts_in_cases(table(spark, "alerts", [alert("1", severity="low")]))
    row = C.alerts_summary(alerts).first()
    assert (row.alerts_high, row.alerts_medium, row.alerts_low) == (0, 0, 1)


def test_ties_at_the_cut_go_to_the_smaller_id(spark):
    given = inputs(
        spark,
        transactions=[txn(f"t{i}", ts=i, counterparty_id=f"C{9 - i}", merchant_id=f"M{9 - i}")
                      for i in range(6)],
        alerts=[alert("1")],
    )
    row = CaseFrames(given, Limits(top_counterparties=2, top_merchants=2)).packet.first()
    assert [c.counterparty_id for c in row.top_counterparties] == ["C4", "C5"]
    assert [m.merchant_id for m in row.top_merchants] == ["M4", "M5"]


def test_supporting_ids_outside_the_window_stay_without_details(spark):
    given = inputs(
        spark,
        transactions=[txn("in", ts=5), txn("late", ts=7), txn("out", ts=99 * DAY)],
        alerts=[alert("1", supporting_txn_ids="out|in||late"), alert("2", supporting_txn_ids="in")],
    )
    row = CaseFrames(given).packet.first()
    assert [(t.txn_id, t.ts) for t in row.supporting_transactions] == [
        ("late", 7), ("in", 5), ("out", None),
    ]
    cut = CaseFrames(given, Limits(supporting_transactions=2)).packet.first()
    assert [t.txn_id for t in cut.supporting_transactions] == ["late", "in"]


def test_repeated_transaction_ids_fan_out(spark):
    given = inputs(
        spark,
        transactions=[txn("x", ts=i) for i in range(5)],
        alerts=[alert("1", supporting_txn_ids="x|y")],
    )
    row = CaseFrames(given).packet.first()
    assert [t.ts for t in row.supporting_transactions] == [4, 3, 2, 1, 0, None]
    few = CaseFrames(given, Limits(supporting_transactions=2)).packet.first()
    assert [t.ts for t in few.supporting_transactions] == [4, 3]


@pytest.mark.parametrize("page", [1, 3, 7, 100])
def test_alert_pages_hold_every_alert_in_order(spark, page):
    rng = random.Random(page)
    rows = [
        alert(f"a{i:03d}", party=rng.choice("ABBBBBBB"), alert_timestamp_ms_utc=rng.randrange(9))
        for i in range(120)
    ]
    pages = E.alert_pages(C.alerts_in_cases(table(spark, "alerts", rows)), page).collect()
    for party in "AB":
        mine = sorted((p.page, p.alerts) for p in pages if p.party_id == party)
        assert [n for n, _ in mine] == list(range(len(mine)))
        assert all(len(a) == page for _, a in mine[:-1])
        listed = [(a.ts, a.alert_id) for _, alerts in mine for a in alerts]
        wanted = [(r["alert_timestamp_ms_utc"], r["alert_id"]) for r in rows if r["party_id"] == party]
        assert listed == sorted(wanted, reverse=True)


def test_packet_has_the_first_page_and_the_rest_is_beside_it(spark):
    given = inputs(spark, alerts=[alert(f"a{i}", alert_timestamp_ms_utc=i) for i in range(5)])
    frames = CaseFrames(given, Limits(alert_page=2))
    row = frames.packet.first()
    assert row.alerts_count == 5 and [a.alert_id for a in row.alerts] == ["a4", "a3"]
    rest = frames.further_alerts.orderBy("page").collect()
    assert [[a.alert_id for a in r.alerts] for r in rest] == [["a2", "a1"], ["a0"]]
    assert rest[0].case_id == row.case_id


def test_json_holds_every_alert(spark):
    rows = [alert(f"a{i}", alert_timestamp_ms_utc=i) for i in range(5)] + [alert("b", party="P2")]
    texts = packet_json(CaseFrames(inputs(spark, alerts=rows), Limits(alert_page=2)).pages).collect()
    found = {}
    for r in texts:
        body = json.loads(r.case_packet_json)
        assert (body.get("alert_page", 0), body.get("alert_pages", 1)) == (r.page, r.pages)
        found.setdefault(r.case_id, []).append((r.page, body))
    for pages in found.values():
        listed = [a["alert_id"] for _, body in sorted(pages, key=lambda p: p[0]) for a in body["alerts"]]
        assert len(listed) == pages[0][1]["alerts_summary"]["alerts_count"]
    assert sorted(len(p) for p in found.values()) == [1, 3]


def test_no_further_pages_costs_no_scan(spark):
    given = inputs(spark, alerts=[alert("1")])
    plan = CaseFrames(given).further_alerts._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan


def test_packet_matches_its_schema(spark):
    from caseloom import schemas

    packet = CaseFrames(inputs(spark, alerts=[alert("1")])).packet
    declared = schemas.schema("case_packet")
    assert [f.name for f in packet.schema] == [f.name for f in declared]
    for ours, wanted in zip(packet.schema, declared):
        assert ours.dataType.simpleString() == wanted.dataType.simpleString()


def test_duplicate_dimension_keys_fan_out(spark):
    given = inputs(
        spark, alerts=[alert("1")],
        parties=[{"party_id": "P1", "party_name": n} for n in ("x", "y")],
    )
    assert CaseFrames(given).packet.select(F.col("party_name")).count() == 2
