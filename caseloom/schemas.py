"""Table contracts, written as Spark DDL.

``NOT NULL`` marks a required column.  File sources read every column as
nullable, so the mark is enforced by :mod:`caseloom.sources.contract`, not by
the reader.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, order and types of the exchanged tables.
TRANSACTIONS = """
    txn_id STRING NOT NULL, party_id STRING NOT NULL, account_id STRING NOT NULL,
    instrument_type STRING NOT NULL, txn_timestamp_ms_utc BIGINT NOT NULL,
    direction STRING NOT NULL, amount DOUBLE NOT NULL, currency STRING NOT NULL,
    counterparty_id STRING NOT NULL, merchant_id STRING, channel STRING NOT NULL,
    country STRING NOT NULL, state STRING, is_international INT NOT NULL,
    description STRING NOT NULL
"""
PARTIES = """
    party_id STRING NOT NULL, party_type STRING NOT NULL, party_name STRING NOT NULL,
    industry STRING, country STRING NOT NULL, state STRING,
    onboarding_date STRING NOT NULL, expected_monthly_volume_usd DOUBLE NOT NULL,
    expected_avg_txn_usd DOUBLE NOT NULL, risk_rating STRING NOT NULL
"""
COUNTERPARTIES = """
    counterparty_id STRING NOT NULL, counterparty_type STRING NOT NULL,
    country STRING NOT NULL
"""
MERCHANTS = """
    merchant_id STRING NOT NULL, merchant_name STRING NOT NULL,
    merchant_category STRING NOT NULL, country STRING NOT NULL, state STRING
"""
ALERTS = """
    alert_id STRING NOT NULL, party_id STRING NOT NULL, party_type STRING,
    model_type STRING NOT NULL, model_version STRING NOT NULL,
    scenario_code STRING NOT NULL, alert_timestamp_ms_utc BIGINT NOT NULL,
    window_start_ms_utc BIGINT NOT NULL, window_end_ms_utc BIGINT NOT NULL,
    risk_score DOUBLE NOT NULL, severity STRING NOT NULL,
    trigger_summary STRING NOT NULL, supporting_txn_ids STRING NOT NULL,
    amount_total_usd DOUBLE NOT NULL, txn_count INT NOT NULL,
    features_json STRING NOT NULL, data_quality_flags STRING NOT NULL
"""

ALERT_ITEM = """
    ts: BIGINT, alert_id: STRING, model_type: STRING, scenario_code: STRING,
    risk_score: DOUBLE, severity: STRING, trigger_summary: STRING,
    supporting_txn_ids: STRING, amount_total_usd: DOUBLE, txn_count: INT,
    features_json: STRING, data_quality_flags: STRING
"""
COUNTERPARTY_ITEM = """
    amount_total_usd: DOUBLE, txn_count: BIGINT, intl_ratio: DOUBLE,
    last_txn_ms_utc: BIGINT, counterparty_id: STRING, counterparty_type: STRING,
    country: STRING
"""
MERCHANT_ITEM = """
    amount_total_usd: DOUBLE, txn_count: BIGINT, last_txn_ms_utc: BIGINT,
    merchant_id: STRING, merchant_name: STRING, merchant_category: STRING,
    country: STRING, state: STRING
"""
TRANSACTION_ITEM = """
    ts: BIGINT, txn_id: STRING, instrument_type: STRING, direction: STRING,
    amount: DOUBLE, currency: STRING, counterparty_id: STRING, merchant_id: STRING,
    channel: STRING, country: STRING, state: STRING, is_international: INT,
    description: STRING
"""
CASE_PACKET = f"""
    case_id STRING, party_id STRING, party_type STRING, party_name STRING,
    industry STRING, country STRING, state STRING, onboarding_date STRING,
    expected_monthly_volume_usd DOUBLE, expected_avg_txn_usd DOUBLE,
    risk_rating STRING, case_window_start_ms_utc BIGINT,
    case_window_end_ms_utc BIGINT, alerts_count BIGINT, alerts_high BIGINT,
    alerts_medium BIGINT, alerts_low BIGINT, max_risk_score DOUBLE,
    median_risk_score DOUBLE, model_types ARRAY<STRING>,
    scenario_codes ARRAY<STRING>, severities ARRAY<STRING>, txn_count_case BIGINT,
    amount_total_usd_case DOUBLE, median_amount_usd_case DOUBLE,
    max_amount_usd_case DOUBLE, first_txn_ms_utc_case BIGINT,
    last_txn_ms_utc_case BIGINT, intl_ratio_case DOUBLE,
    instrument_types_case ARRAY<STRING>, alerts ARRAY<STRUCT<{ALERT_ITEM}>>,
    top_counterparties ARRAY<STRUCT<{COUNTERPARTY_ITEM}>>,
    top_merchants ARRAY<STRUCT<{MERCHANT_ITEM}>>,
    supporting_transactions ARRAY<STRUCT<{TRANSACTION_ITEM}>>
"""
CASE_PACKET_JSON = "case_id STRING, case_packet_json STRING, page INT, pages INT"
CASE_FURTHER_ALERTS = f"""
    case_id STRING, party_id STRING, page INT, alerts ARRAY<STRUCT<{ALERT_ITEM}>>
"""
CASE_QUEUE = """
    case_id STRING, party_id STRING, party_type STRING, party_name STRING,
    risk_rating STRING, max_risk_score DOUBLE, alerts_count BIGINT, txn_count_case BIGINT,
    amount_total_usd_case DOUBLE, last_txn_ms_utc_case BIGINT,
    case_window_start_ms_utc BIGINT, case_window_end_ms_utc BIGINT, position BIGINT NOT NULL
"""
TX_TIMELINE_DAILY = """
    case_id STRING, party_id STRING, txn_date_utc STRING, instrument_type STRING,
    txn_count BIGINT NOT NULL, amount_total_usd DOUBLE
"""

_DDL = {
    "transactions": TRANSACTIONS,
    "parties": PARTIES,
    "counterparties": COUNTERPARTIES,
    "merchants": MERCHANTS,
    "alerts": ALERTS,
    "case_packet": CASE_PACKET,
    "case_packet_json": CASE_PACKET_JSON,
    "case_further_alerts": CASE_FURTHER_ALERTS,
    "tx_timeline_daily": TX_TIMELINE_DAILY,
    "case_queue": CASE_QUEUE,
}

INPUTS = ("transactions", "parties", "counterparties", "merchants", "alerts")
OUTPUTS = (
    "case_packet", "case_packet_json", "case_further_alerts", "tx_timeline_daily", "case_queue",
)

# Column that must identify one row; other tables have no single one.
KEYS = {
    "transactions": "txn_id",
    "parties": "party_id",
    "counterparties": "counterparty_id",
    "merchants": "merchant_id",
    "alerts": "alert_id",
    "case_packet": "case_id",
    "case_queue": "case_id",
}


def schema(name: str) -> T.StructType:
    """The declared schema of a table; unknown names are an error."""
    if name not in _DDL:
        raise KeyError(f"no schema is declared for {name!r}; known: {sorted(_DDL)}")
    return T.StructType.fromDDL(_DDL[name])


def required_columns(name: str) -> list[str]:
    return [f.name for f in schema(name) if not f.nullable]
