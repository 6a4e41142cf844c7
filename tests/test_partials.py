"""Figures from daily partials against the window join, for windows of any kind."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.functions.cases import CASE_KEY
from caseloom.operators import cases as C
from caseloom.operators import partials as P
from caseloom.operators.packet import CaseFrames
from tests.rows import DAY, alert, inputs, txn


def windows(spark, spans, party="P1"):
    return spark.createDataFrame([(party, a, b) for a, b in spans], f"{CASE_KEY[0]} string, {CASE_KEY[1]} long, {CASE_KEY[2]} long")


def test_blocks_and_edges_cover_each_window_once(spark):
    rng = random.Random(3)
    spans = {(0, 0), (0, DAY - 1), (0, DAY), (1, DAY - 1), (-DAY, DAY - 1), (-5 * DAY - 3, 7 * DAY + 5), (5, 4)}
    for _ in range(300):
        start = rng.randrange(-400 * DAY, 400 * DAY)
        start -= start % DAY if rng.random() < 0.5 else 0
        end = start + rng.choice([0, 1, DAY - 1, DAY, 3 * DAY, 365 * DAY, 366 * DAY - 1, rng.randrange(0, 900 * DAY)])
        spans.add((start, end))
    cases = windows(spark, sorted(spans))
    blocks, edges = {}, {}
    for r in P.day_blocks(cases).collect():
        blocks.setdefault((r[1], r[2]), []).append((r._level, r._block))
    for r in P.edge_days(cases).collect():
        edges.setdefault((r[1], r[2]), []).append(r._day)
    for start, end in spans:
        days = sorted(d for k, b in blocks.get((start, end), []) for d in range(b << k, (b + 1) << k))
        whole = [d for d in range(start // DAY, end // DAY + 1) if d * DAY >= start and (d + 1) * DAY - 1 <= end]
        cut = [d for d in range(start // DAY, end // DAY + 1) if d not in whole] if start <= end else []
        assert days == whole and sorted(edges.get((start, end), [])) == cut
        assert len(blocks.get((start, end), [])) <= 2 * max(1, len(whole)).bit_length()


def test_days_are_placed_in_wanted_blocks_only(spark):
    """A day is in one block of a window, not in one of every level of its party."""
    spans = [(0, 365 * DAY - 1), (365 * DAY, 731 * DAY - 1), (-5000 * DAY, -1000 * DAY - 1), (-9 * DAY, -7 * DAY - 1)]
    days = [-5001, -5000, -3500, -2000, -1500, -1001, -1000, -9, -8, -7, 0, 1, 364, 365, 730, 731]
    given = inputs(spark, transactions=[txn(f"t{d}", ts=d * DAY) for d in days])
    for some in (spans, spans[:2], [(5, 6)]):
        partials = P.DayPartials(C.with_usd(given["transactions"]), windows(spark, some))
        placed = partials._placed(given["transactions"].select("party_id", P._floor_day(F.col(P.TS)).alias("_day")), partials.blocks, [])
        held = [d for d in days for a, b in some if a <= d * DAY and (d + 1) * DAY - 1 <= b]
        assert sorted(r._day for r in placed.collect()) == sorted(held)
        assert all(r._block << r._level <= r._day < (r._block + 1) << r._level for r in placed.collect())
        assert ("explode(_levels" in placed._jdf.queryExecution().optimizedPlan().toString()) == (some is spans)


def test_value_ranges_rise_with_values(spark):
    values = [float("-inf"), -1e300, -7.5, -7.25, -1e-9, 0.0, 1e-300, 0.01, 1.0, 1.01, 1e9, 1e300, float("inf"), float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", P.value_range("v").alias("r")).collect()
    found = [r.r for r in rows]
    assert found == sorted(found)


FRAMES = ("tx_summary", "instrument_breakdown", "counterparty_totals", "merchant_totals", "timeline", "supporting_transactions")


def rows(frame):
    out = []
    for row in frame.collect():
        out.append(tuple(round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in row.asDict().values()))
    return sorted(out, key=repr)


@pytest.fixture
def given(spark):
    rng = random.Random(11)
    amounts = [10.0, 10.0, 25.5, -3.25, 0.0, None, 1e6, 99.99]
    txns = [
        txn(f"T{i % 900}", party=rng.choice(["P1", "P1", "P1", "P2", "P3", None]), ts=None if i % 97 == 0 else rng.randrange(-200 * DAY, 200 * DAY),
            amount=rng.choice([*amounts, rng.uniform(0, 500)]), currency=rng.choice(["USD", "EUR", None, "XXX"]),
            instrument_type=rng.choice(["cash", "wires", None]), counterparty_id=rng.choice(["C1", "C2", "C3", None]),
            merchant_id=rng.choice(["M1", "M2", None]), is_international=rng.choice([0, 1, None]))
        for i in range(1000)
    ]
    alerts = []
    for k in range(200):  # windows of one party that overlap
        start = rng.randrange(-220 * DAY, 100 * DAY)
        start -= start % DAY if k % 2 else 0
        alerts.append(alert(f"A{k}", party="P1" if k % 5 else "P2", start=start, end=start + rng.choice([0, DAY - 1, 40 * DAY, 300 * DAY - 1, 77 * DAY + 5]),
                            supporting_txn_ids=f"T{k}|T{k + 1}|missing"))
    alerts += [alert("B", party="P9"), alert("C", start=5, end=1), alert("D", start=None), alert("E", party=None)]
    return inputs(spark, transactions=txns, alerts=alerts)


@pytest.mark.parametrize("name", FRAMES)
def test_two_hundred_overlapping_windows_equal_the_join(given, name):
    joined, by_day = (getattr(CaseFrames(given, by_day=way), name) for way in (False, True))
    assert by_day.columns == joined.columns
    assert rows(by_day) == rows(joined) != []


def test_transactions_are_read_once_however_many_windows_overlap(spark, given):
    cases = C.case_index(given["alerts"])
    made = P.DayPartials(C.with_usd(given["transactions"]), cases)
    assert made.facts.count() <= given["transactions"].count()
    joined = C.transactions_in_cases(given["transactions"], cases).count()
    # What meets windows: blocks of days and cut days instead of every transaction of every window.
    per_case = made.blocks.groupBy(*CASE_KEY).count().agg(F.max("count")).first()[0]
    assert per_case <= 2 * 9 and made.edges.count() < joined / 20


def test_no_windows_and_no_transactions(spark):
    for given in (inputs(spark, [txn("a", ts=5)], []), inputs(spark, [], [alert("1")]), inputs(spark)):
        made = CaseFrames(given, by_day=True)
        assert made.tx_summary.collect() == [] == made.timeline.collect() == made.counterparty_totals.collect()
        assert made.packet.count() == given["alerts"].count()


def test_medians_of_a_crowded_range(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGES", 1)
    day = [txn(f"T{i}", ts=i * 1000, amount=1000.0 + (i * 37 % 500) / 512) for i in range(501)]
    given = inputs(spark, transactions=day, alerts=[alert("1", start=0, end=DAY - 1), alert("2", start=1, end=400_000), alert("3", start=0, end=2000)])
    medians = {tuple(r)[1:3]: r[3] for r in P.DayPartials(C.with_usd(given["transactions"]), C.case_index(given["alerts"])).medians().collect()}
    for (start, end), found in medians.items():
        values = sorted(t["amount"] for t in day if start <= t["txn_timestamp_ms_utc"] <= end)
        assert found == values[(len(values) - 1) // 2]
    assert len(medians) == 3
