"""Ranked lists behind a case: counterparties, merchants, transactions, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.cases import CASE_KEY
from caseloom.operators import cases as C
from caseloom.operators.ranking import GROUP_BOUND, crowded_groups, top_n, with_position

# How much of each list a packet shows.
SUPPORTING_TRANSACTIONS = 200
TOP_COUNTERPARTIES = 50
TOP_MERCHANTS = 50

# Alerts that one packet row holds.  A case with more continues in further pages
# of the same size, so no alert is left out and no row grows without limit.
ALERT_PAGE = GROUP_BOUND

ALERT_DETAILS = [
    "alert_id", "model_type", "scenario_code", "risk_score", "severity", "trigger_summary",
    "supporting_txn_ids", "amount_total_usd", "txn_count", "features_json",
    "data_quality_flags",
]
COUNTERPARTY_FIELDS = [
    "amount_total_usd", "txn_count", "intl_ratio", "last_txn_ms_utc",
    "counterparty_id", "counterparty_type", "country",
]
MERCHANT_FIELDS = [
    "amount_total_usd", "txn_count", "last_txn_ms_utc",
    "merchant_id", "merchant_name", "merchant_category", "country", "state",
]
TRANSACTION_DETAILS = [
    "instrument_type", "direction", "amount", "currency", "counterparty_id", "merchant_id",
    "channel", "country", "state", "is_international", "description",
]


def _alert_item() -> Column:
    return F.struct(F.col("alert_timestamp_ms_utc").alias("ts"), *ALERT_DETAILS)


def _largest_first(id_column: str) -> list[Column]:
    """By amount, then count, then id.  Amounts equal to a millionth of a dollar
    are ties, so the order does not depend on the order of summation."""
    return [
        F.round("amount_total_usd", 6).desc(),
        F.col("txn_count").desc(),
        F.col(id_column).asc(),
    ]


def top_counterparties(
    totals: DataFrame, counterparties: DataFrame, n: int = TOP_COUNTERPARTIES
) -> DataFrame:
    """Largest counterparties of each case by their totals, ranked before the profile is joined."""
    ranked = top_n(totals, CASE_KEY, _largest_first("counterparty_id"), n)
    profile = counterparties.select("counterparty_id", "counterparty_type", "country")
    return ranked.join(profile, "counterparty_id", "left")


def top_merchants(totals: DataFrame, merchants: DataFrame, n: int = TOP_MERCHANTS) -> DataFrame:
    ranked = top_n(totals, CASE_KEY, _largest_first("merchant_id"), n)
    profile = merchants.select(
        "merchant_id", "merchant_name", "merchant_category", "country", "state"
    )
    return ranked.join(profile, "merchant_id", "left")


def supporting_ids(alerts: DataFrame) -> DataFrame:
    """Distinct transaction ids that a case's alerts list."""
    return alerts.select(*CASE_KEY, F.explode("supporting_txn_id_arr").alias("txn_id")).distinct()


def supporting_transactions(
    alerts: DataFrame, tx_case: DataFrame, n: int = SUPPORTING_TRANSACTIONS
) -> DataFrame:
    """The ``n`` most recent listed transactions of each case, with details.

    A listed id without a transaction in the window stays, with empty details,
    and ranks last.  Transactions are first reduced to listed ones, and of one id
    at most ``n`` copies are kept (no more can be shown), so a repeated id cannot
    fill a task.  Ties go to the smaller id, then to the larger details.
    """
    ids = supporting_ids(alerts)
    key = [*CASE_KEY, "txn_id"]
    ts, details = "txn_timestamp_ms_utc", F.struct(*TRANSACTION_DETAILS).alias("details")
    listed = tx_case.select(*key, ts, details).join(ids, key, "left_semi")
    recent_first = [F.col(ts).desc_nulls_last(), F.col("txn_id"), F.col("details").desc()]
    copies = top_n(listed, key, recent_first, n).drop("rank")
    return top_n(ids.join(copies, key, "left"), CASE_KEY, recent_first, n)


def supporting_transactions_read(
    alerts: DataFrame, transactions: DataFrame, n: int = SUPPORTING_TRANSACTIONS
) -> DataFrame:
    """:func:`supporting_transactions` from the transactions themselves, where no other frame needs
    them under their cases.

    A listed id names its transactions, so they are looked up by party and id, and the case's window
    is a condition of that one join: what no alert lists is not put under cases first, and ids
    and transactions are shuffled once for the join and the copies of an id.
    """
    place, ts, details = ["party_id", "txn_id"], "txn_timestamp_ms_utc", F.struct(*TRANSACTION_DETAILS).alias("details")
    key = [*CASE_KEY, "txn_id"]
    ids = alerts.select(*CASE_KEY, F.explode("supporting_txn_id_arr").alias("txn_id")).repartition(*place).distinct()
    # The span of all windows lets the scan skip older files.
    span = alerts.agg(F.min(CASE_KEY[1]).alias("first"), F.max(CASE_KEY[2]).alias("last")).first()
    near = transactions.where(F.col(ts).between(F.lit(span["first"]), F.lit(span["last"])))
    rows = near.select(F.col("party_id").alias("_party"), F.col("txn_id").alias("_txn"), ts, details)
    inside = F.col(ts).between(F.col(CASE_KEY[1]), F.col(CASE_KEY[2]))
    found = ids.join(rows, (F.col("party_id") == F.col("_party")) & (F.col("txn_id") == F.col("_txn")) & inside, "left")
    recent_first = [F.col(ts).desc_nulls_last(), F.col("txn_id"), F.col("details").desc()]
    copies = top_n(found.select(*key, ts, "details"), key, recent_first, n).drop("rank")
    return top_n(copies, CASE_KEY, recent_first, n)


def alert_pages(alerts: DataFrame, page: int = ALERT_PAGE) -> DataFrame:
    """Alert lists, latest first, in pages: page 0 goes into the packet, later ones
    beside it.

    Cases of up to ``page`` alerts are one page each.  If a count finds larger
    ones, their alerts are numbered by a range sort that spreads one case over
    many tasks, and are collected page by page.
    """
    latest_first = F.sort_array(F.collect_list(_alert_item()), asc=False).alias("alerts")

    def single(df: DataFrame) -> DataFrame:
        return df.groupBy(*CASE_KEY).agg(latest_first).withColumn("page", F.lit(0))

    crowded = crowded_groups(alerts, CASE_KEY, page)
    if crowded is None:
        return single(alerts)
    order = [F.col(c).desc() for c in ("alert_timestamp_ms_utc", *ALERT_DETAILS)]
    numbered = with_position(alerts.join(crowded, CASE_KEY, "left_semi"), CASE_KEY, order)
    paged = numbered.withColumn("page", F.floor(F.col("position") / page).cast("int"))
    large = paged.groupBy(*CASE_KEY, "page").agg(latest_first)
    return single(alerts.join(crowded, CASE_KEY, "left_anti")).unionByName(large)


def ordered_list(rank: str, item: Column) -> Column:
    """Items of a group as an array in rank order; groups must be bounded."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("rank"), item.alias("item"))))
    return F.transform(pairs, lambda pair: pair["item"])


def counterparty_list(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy(*CASE_KEY).agg(
        ordered_list("rank", F.struct(*COUNTERPARTY_FIELDS)).alias("top_counterparties")
    )


def merchant_list(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy(*CASE_KEY).agg(
        ordered_list("rank", F.struct(*MERCHANT_FIELDS)).alias("top_merchants")
    )


def supporting_list(ranked: DataFrame) -> DataFrame:
    """Supporting transactions, latest first; ties by the following fields, descending."""
    item = F.struct(
        F.col("txn_timestamp_ms_utc").alias("ts"), F.col("txn_id"), F.col("details.*")
    )
    return ranked.groupBy(*CASE_KEY).agg(
        F.sort_array(F.collect_list(item), asc=False).alias("supporting_transactions")
    )
