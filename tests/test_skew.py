"""One key with most of the rows: results stay whole and the work is split."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.functions.cases import CASE_KEY
from caseloom.operators import cases as C
from caseloom.operators import ranking
from caseloom.operators.packet import CaseFrames
from caseloom.operators.ranking import top_n, with_position
from tests.rows import DAY, alert, inputs, txn


def hot_inputs(spark, rows=60_000):
    """A busy party with two of every three transactions, all on one day."""
    given = inputs(
        spark,
        alerts=[alert("1", party="HOT", end=3 * DAY), alert("2", party="HOT", start=DAY, end=9 * DAY)]
        + [alert(f"c{i}", party=f"P{i}", end=300 * DAY) for i in range(50)],
    )
    n = F.col("id")
    hot = n % 3 != 0
    columns = {
        "txn_id": F.concat(F.lit("t"), n),
        "party_id": F.when(hot, "HOT").otherwise(F.concat(F.lit("P"), n % 50)),
        "account_id": F.lit("A"),
        "instrument_type": F.lit("cash"),
        "txn_timestamp_ms_utc": F.when(hot, 2 * DAY + n).otherwise((n * 7919) % (300 * DAY)),
        "direction": F.lit("debit"),
        "amount": F.lit(1.0),
        "currency": F.lit("USD"),
        "counterparty_id": F.concat(F.lit("C"), n % 5),
        "merchant_id": F.lit(None).cast("string"),
        "channel": F.lit("pos"),
        "country": F.lit("US"),
        "state": F.lit(None).cast("string"),
        "is_international": F.lit(0),
        "description": F.sha2(n.cast("string"), 256),
    }
    given["transactions"] = spark.range(0, rows, 1, 16).select(
        *[c.alias(name) for name, c in columns.items()]
    )
    return given


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_join_splits_a_hot_party(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="100KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    given = hot_inputs(spark)
    joined = C.transactions_in_cases(given["transactions"], C.case_index(given["alerts"]))
    assert joined.columns == [*given["transactions"].columns, *CASE_KEY[1:]]
    assert "skew=true" in final_plan(joined.select("txn_id", *CASE_KEY, "description"))
    counts = {
        (r.party_id, r.case_window_start_ms_utc): r["count"]
        for r in joined.groupBy(*CASE_KEY).count().collect()
    }
    assert counts[("HOT", 0)] == counts[("HOT", DAY)] == 40_000
    assert sum(n for (p, _), n in counts.items() if p != "HOT") == 20_000


def test_rows_are_repeated_for_their_own_partys_levels_only(spark, conf):
    days = [1, 2, 4, 8, 16, 32, 64, 128, 256, 512]
    alerts = [alert(f"a{d}", party=f"P{d}", start=0, end=d * DAY - 1) for d in days]
    txns = [txn(f"t{d}-{i}", party=f"P{d}", ts=i) for d in days for i in range(3)] + [txn("x", party="other")]
    given = inputs(spark, transactions=txns, alerts=alerts)
    for limit in ("10485760", "-1"):  # with and without broadcast
        conf(spark__sql__autoBroadcastJoinThreshold=limit)
        joined = C.transactions_in_cases(given["transactions"], C.case_index(given["alerts"]))
        assert sorted(r.txn_id for r in joined.collect()) == sorted(t["txn_id"] for t in txns if t["txn_id"] != "x")
        assert "explode(_levels" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_one_or_two_lengths_need_no_join_by_party(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    alerts = [alert("a", party="P1", end=365 * DAY - 1), alert("b", party="P2", start=7 * DAY, end=8 * DAY - 1)]
    txns = [txn(f"{p}-{d}", party=p, ts=d * DAY) for p in ("P1", "P2", "other") for d in (-1, 0, 7, 8, 364, 365)]
    for some in (alerts, alerts[:1], []):
        given = inputs(spark, transactions=txns, alerts=some)
        joined = C.transactions_in_cases(given["transactions"], C.case_index(given["alerts"]))
        held = {(t["txn_id"], a["window_start_ms_utc"]) for t in txns for a in some if t["party_id"] == a["party_id"]
                and a["window_start_ms_utc"] <= t["txn_timestamp_ms_utc"] <= a["window_end_ms_utc"]}
        assert sorted((r.txn_id, r[CASE_KEY[1]]) for r in joined.collect()) == sorted(held)
        assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") <= 1


def test_packet_of_a_hot_party_is_whole(spark):
    rows = CaseFrames(hot_inputs(spark, 9_000)).packet.where("party_id = 'HOT'").collect()
    assert [r.txn_count_case for r in rows] == [6000, 6000]
    assert all(sum(c.txn_count for c in r.top_counterparties) == 6000 for r in rows)


def test_medians_of_large_groups_are_exact(spark, monkeypatch):
    rng = random.Random(11)
    rows = [("x" if i % 10 else "y", rng.choice([None, 1.0, 2.0, rng.random() * 9])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    summary = df.groupBy("g").agg(ranking.median_column("v").alias("m"), F.count("*").alias("n"))
    for bound in (10_000, 500, 5):
        monkeypatch.setattr(ranking, "GROUP_BOUND", bound)
        got = {r.g: (r.m, r.n) for r in ranking.exact_medians(summary, df, ["g"], "v", "m", "n").collect()}
        for g in "xy":
            values = sorted(v for k, v in rows if k == g and v is not None)
            assert got[g] == (values[(len(values) - 1) // 2], sum(k == g for k, _ in rows))


def test_a_frequent_value_is_one_row_before_values_are_placed(spark, monkeypatch):
    # One group, nine of ten values equal.
    df = spark.range(20_000).select(
        F.lit("x").alias("g"), F.when(F.col("id") % 10 > 0, 35.0).otherwise(F.col("id") / 7).alias("v")
    )
    placed = []
    number = ranking.with_position
    monkeypatch.setattr(ranking, "GROUP_BOUND", 100)
    monkeypatch.setattr(ranking, "with_position", lambda d, *a: placed.append(d.count()) or number(d, *a))
    summary = df.groupBy("g").agg(ranking.median_column("v").alias("m"), F.count("*").alias("n"))
    row = ranking.exact_medians(summary, df, ["g"], "v", "m", "n").first()
    assert (row.m, row.n) == (35.0, 20_000)
    assert placed == [df.select("v").distinct().count()]


@pytest.mark.parametrize("n", [4_999, 5_001, 9_999, 10_000])
def test_sketch_is_exact_up_to_the_bound(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 104_729).cast("double").alias("v"))
    rows = df.repartition(6).agg(ranking.median_column("v")).first()
    assert rows[0] == sorted(i * 7919 % 104_729 for i in range(n))[(n - 1) // 2]


def test_top_n_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    plan = top_n(df, ["g"], [F.col("id").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_per_case_figures_are_combined_before_the_shuffle(spark):
    frames = CaseFrames(hot_inputs(spark, 100), staged=False)
    for df in (frames.tx_summary, frames.timeline, frames.instrument_breakdown,
               C.counterparty_totals(frames.tx_case), frames.alerts_summary):
        assert "partial_" in df._jdf.queryExecution().executedPlan().toString()


def test_positions_of_a_group_in_many_partitions(spark, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    rng = random.Random(3)
    rows = [(rng.choice("aaaaaaab") if i else None, rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = with_position(df, ["g"], [F.col("v").desc(), F.col("id").asc()])
    for group in (None, "a", "b"):
        mine = sorted((r.position, r.v, r.id) for r in got.collect() if r.g == group)
        wanted = sorted(((v, i) for g, v, i in rows if g == group), key=lambda x: (-x[0], x[1]))
        assert [(v, i) for _, v, i in mine] == wanted
        assert [p for p, _, _ in mine] == list(range(len(wanted)))


def test_positions_over_all_rows(spark, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    got = with_position(df, [], [F.col("v").asc()]).collect()
    assert sorted((r.position, r.v) for r in got) == list(enumerate(sorted(r.v for r in got)))
