"""Cases, the alerts and transactions that belong to them, and per-case figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.cases import CASE_KEY, DAY_MS, pipe_items, usd, utc_day
from caseloom.operators.ranking import exact_medians, median_column
from caseloom.session import stage

# Widest slot of the window join: 2^36 days still fits a BIGINT of milliseconds.
MAX_LEVEL = 36
# With so many levels in use every transaction is placed on all of them, without a join by party.
FEW_LEVELS = 2


def _with_case_key(alerts: DataFrame) -> DataFrame:
    return alerts.withColumnsRenamed(
        {"window_start_ms_utc": CASE_KEY[1], "window_end_ms_utc": CASE_KEY[2]}
    )


def case_index(alerts: DataFrame) -> DataFrame:
    """One row per party and alert window."""
    return _with_case_key(alerts).select(*CASE_KEY).distinct()


def case_party(cases: DataFrame, parties: DataFrame) -> DataFrame:
    """Cases with the party's profile; a party without one keeps its cases."""
    profile = parties.select(
        "party_id", "party_type", "party_name", "industry", "country", "state",
        "onboarding_date", "expected_monthly_volume_usd", "expected_avg_txn_usd", "risk_rating",
    )
    return cases.join(profile, "party_id", "left")


def alerts_in_cases(alerts: DataFrame) -> DataFrame:
    """Alerts under their case key, with the listed transaction ids as an array.

    The case key is made of alert columns, so no join is needed; alerts without
    a complete key belong to no case.
    """
    keyed = _with_case_key(alerts).dropna(subset=CASE_KEY)
    return keyed.withColumn("supporting_txn_id_arr", pipe_items("supporting_txn_ids"))


def _slot_width(level: str) -> str:
    return f"shiftleft({DAY_MS}L, {level})"


def transactions_in_cases(transactions: DataFrame, cases: DataFrame) -> DataFrame:
    """Every transaction under every case of its party whose window holds it.

    A join on the party alone would compare each transaction with each window of
    the party and put a busy party into one task.  Time is therefore cut into
    slots of 2^level days, with the level taken from the window's length, so a
    window touches two or three slots and a transaction one per level of its party (where all
    windows together have one or two levels, one per level, which saves a shuffle by party).
    The join key (party, level, slot) spreads a busy party over time; a slot that
    is still too large is split by adaptive skew handling, as this is a plain
    inner join.  Both window ends are inclusive.
    """
    start, end = CASE_KEY[1], CASE_KEY[2]
    days = (F.col(end).cast("double") - F.col(start) + 1) / DAY_MS
    level = F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(0), F.ceil(F.log2(days)))).cast("int")
    windows = cases.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    slotted = windows.withColumn(
        "_slot",
        F.explode(F.expr(
            f"sequence({start} div {_slot_width('_level')}, {end} div {_slot_width('_level')})"
        )),
    ).withColumnRenamed("party_id", "_party")

    # The span of all windows lets the scan skip older files.
    span = windows.agg(F.min(start).alias("first"), F.max(end).alias("last")).first()
    ts = F.col("txn_timestamp_ms_utc")
    relevant = transactions.where(ts.between(F.lit(span["first"]), F.lit(span["last"])))
    # Levels of all windows: at most MAX_LEVEL + 1 numbers.
    used = sorted(r["_level"] for r in windows.select("_level").distinct().collect())
    if len(used) <= FEW_LEVELS:
        # A shuffle by party costs as much as one more copy of a transaction, so both levels are tried.
        placed = relevant.withColumn("_at_level", F.explode(F.lit(used or [0]).cast("array<int>")))
    else:
        # A party's own levels.  The join drops transactions of parties without cases, and each
        # other one is repeated for its own party's levels only.
        levels = windows.groupBy(F.col("party_id").alias("_of")).agg(
            F.sort_array(F.collect_set("_level")).alias("_levels")
        )
        own = relevant.join(levels, F.col("party_id") == F.col("_of"))
        placed = own.withColumn("_at_level", F.explode("_levels"))
    placed = placed.withColumn("_at_slot", F.expr(f"txn_timestamp_ms_utc div {_slot_width('_at_level')}"))
    return placed.join(
        slotted,
        (F.col("party_id") == F.col("_party"))
        & (F.col("_at_level") == F.col("_level"))
        & (F.col("_at_slot") == F.col("_slot"))
        & ts.between(F.col(start), F.col(end)),
    ).select(*transactions.columns, start, end)


def with_usd(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn("amount_usd", usd())


def _distinct_sorted(column: str) -> Column:
    return F.sort_array(F.collect_set(column))


def _total_usd() -> Column:
    """Whole dollars and the rest are added apart.  The whole ones add up exactly, so
    the total of a large group does not depend on the order of its rows."""
    whole = F.rint("amount_usd")
    return F.sum(whole) + F.sum(F.col("amount_usd") - whole)


def alerts_summary(alerts: DataFrame, staged: bool = False) -> DataFrame:
    """Counts, risk figures and the distinct models, scenarios and severities; ``staged`` as in
    :func:`tx_summary`."""
    summary = alerts.groupBy(*CASE_KEY).agg(
        F.count("*").alias("alerts_count"),
        *[
            F.count_if(F.col("severity") == level).alias(f"alerts_{level}")
            for level in ("high", "medium", "low")
        ],
        F.max("risk_score").alias("max_risk_score"),
        median_column("risk_score").alias("median_risk_score"),
        _distinct_sorted("model_type").alias("model_types"),
        _distinct_sorted("scenario_code").alias("scenario_codes"),
        _distinct_sorted("severity").alias("severities"),
    )
    summary = stage(summary, "alerts-summary") if staged else summary
    return exact_medians(summary, alerts, CASE_KEY, "risk_score", "median_risk_score", "alerts_count")


def tx_summary(tx_case: DataFrame, staged: bool = False) -> DataFrame:
    """Counts, dollars, first and last time, and instruments; large cases are read a second
    time, so ``tx_case`` should be a written table.  With ``staged`` the figures are written once
    before the large cases are looked for in them; without it their keys are counted."""
    summary = tx_case.groupBy(*CASE_KEY).agg(
        F.count("*").alias("txn_count_case"),
        _total_usd().alias("amount_total_usd_case"),
        median_column("amount_usd").alias("median_amount_usd_case"),
        F.max("amount_usd").alias("max_amount_usd_case"),
        F.min("txn_timestamp_ms_utc").alias("first_txn_ms_utc_case"),
        F.max("txn_timestamp_ms_utc").alias("last_txn_ms_utc_case"),
        F.avg("is_international").alias("intl_ratio_case"),
        _distinct_sorted("instrument_type").alias("instrument_types_case"),
    )
    summary = stage(summary, "tx-summary") if staged else summary
    return exact_medians(
        summary, tx_case, CASE_KEY, "amount_usd", "median_amount_usd_case", "txn_count_case"
    )


def _totals_by(tx_case: DataFrame, *columns: str, extra: tuple[Column, ...] = ()) -> DataFrame:
    return tx_case.groupBy(*CASE_KEY, *columns).agg(
        F.count("*").alias("txn_count"), _total_usd().alias("amount_total_usd"), *extra
    )


def instrument_breakdown(tx_case: DataFrame) -> DataFrame:
    return _totals_by(tx_case, "instrument_type")


def timeline_daily(tx_case: DataFrame) -> DataFrame:
    """Transactions per case, UTC day and instrument."""
    dated = tx_case.withColumn("txn_date_utc", utc_day("txn_timestamp_ms_utc"))
    return _totals_by(dated, "txn_date_utc", "instrument_type")


def counterparty_totals(tx_case: DataFrame) -> DataFrame:
    return _totals_by(
        tx_case,
        "counterparty_id",
        extra=(
            F.avg("is_international").alias("intl_ratio"),
            F.max("txn_timestamp_ms_utc").alias("last_txn_ms_utc"),
        ),
    )


def merchant_totals(tx_case: DataFrame) -> DataFrame:
    return _totals_by(
        tx_case.where(F.col("merchant_id").isNotNull()),
        "merchant_id",
        extra=(F.max("txn_timestamp_ms_utc").alias("last_txn_ms_utc"),),
    )


def alerts_by_model(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("model_type").agg(F.count("*").alias("alerts"))
