"""Named views for SQL users."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from caseloom.operators import evidence as E
from caseloom.operators.packet import CaseFrames, packet_json, with_case_id

# Views over other views.  Lists are opened into one row per item.
_CASE_COLUMNS = "case_id, party_id"
SQL_VIEWS = {
    "v_case_packet": "SELECT * FROM case_packet",
    "v_alert_summary": f"""
        SELECT {_CASE_COLUMNS}, case_window_start_ms_utc, case_window_end_ms_utc,
               s.* EXCEPT ({_CASE_COLUMNS}, case_window_start_ms_utc, case_window_end_ms_utc)
        FROM case_index LEFT JOIN alerts_summary AS s
        USING ({_CASE_COLUMNS}, case_window_start_ms_utc, case_window_end_ms_utc)""",
    "v_instrument_breakdown": f"""
        SELECT {_CASE_COLUMNS}, instrument_type, txn_count, amount_total_usd
        FROM tx_instrument_breakdown""",
    "v_top_counterparties": f"""
        SELECT {_CASE_COLUMNS}, item.counterparty_id, item.counterparty_type, item.country,
               item.txn_count, item.amount_total_usd, item.intl_ratio, item.last_txn_ms_utc
        FROM top_counterparties_enriched LATERAL VIEW explode(top_counterparties) AS item""",
    "v_top_merchants": f"""
        SELECT {_CASE_COLUMNS}, item.merchant_id, item.merchant_name, item.merchant_category,
               item.country, item.state, item.txn_count, item.amount_total_usd,
               item.last_txn_ms_utc
        FROM top_merchants_enriched LATERAL VIEW explode(top_merchants) AS item""",
    "v_supporting_transactions": f"""
        SELECT {_CASE_COLUMNS}, item.ts AS txn_timestamp_ms_utc, item.* EXCEPT (ts)
        FROM supporting_tx_packet LATERAL VIEW explode(supporting_transactions) AS item""",
    "v_case_queue": f"""
        SELECT {_CASE_COLUMNS}, party_type, party_name, risk_rating, max_risk_score,
               alerts_count, txn_count_case, amount_total_usd_case, last_txn_ms_utc_case,
               case_window_start_ms_utc, case_window_end_ms_utc
        FROM case_packet
        ORDER BY max_risk_score DESC NULLS LAST, last_txn_ms_utc_case DESC NULLS LAST, case_id""",
}


def _frames(frames: CaseFrames) -> dict[str, Callable[[], DataFrame]]:
    """Per-case frames under their view names, each built when it is called for."""
    return {
        "case_index": lambda: with_case_id(frames.cases),
        "case_party": lambda: with_case_id(frames.case_party),
        "alerts_case": lambda: with_case_id(frames.alerts_case),
        "alerts_summary": lambda: with_case_id(frames.alerts_summary),
        "alerts_details": lambda: with_case_id(frames.alert_pages),
        "tx_case": lambda: with_case_id(frames.tx_case),
        "tx_summary": lambda: with_case_id(frames.tx_summary),
        "tx_instrument_breakdown": lambda: with_case_id(frames.instrument_breakdown),
        "top_counterparties_enriched": lambda: with_case_id(
            E.counterparty_list(frames.top_counterparties)
        ),
        "top_merchants_enriched": lambda: with_case_id(E.merchant_list(frames.top_merchants)),
        "supporting_txn_ids": lambda: with_case_id(frames.supporting_ids),
        "supporting_tx_packet": lambda: with_case_id(
            E.supporting_list(frames.supporting_transactions)
        ),
        "case_packet": lambda: frames.packet,
        "packet_for_llm": lambda: packet_json(frames.pages),
        "v_tx_timeline_daily": lambda: frames.timeline_daily,
    }


def register_views(
    spark: SparkSession, frames: CaseFrames, names: Iterable[str] | None = None
) -> None:
    """Create the named views in the session, or all; only the frames they read are built."""
    tables = _frames(frames)
    wanted = {*tables, *SQL_VIEWS} if names is None else set(names)
    unknown = wanted - {*tables, *SQL_VIEWS}
    if unknown:
        raise KeyError(f"no such view: {sorted(unknown)}")
    views = {name: sql for name, sql in SQL_VIEWS.items() if name in wanted}
    for name, build in tables.items():
        read = any(re.search(rf"\b{name}\b", sql) for sql in views.values())
        if read or name in wanted:
            build().createOrReplaceTempView(name)
    for name, sql in views.items():
        spark.sql(sql).createOrReplaceTempView(name)
