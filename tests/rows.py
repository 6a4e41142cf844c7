"""Small hand-made inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from caseloom import schemas

DAY = 86_400_000


def table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """Rows with the given columns; the others are null."""
    declared = schemas.schema(name)
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in declared])
    return spark.createDataFrame([tuple(r.get(f.name) for f in declared) for r in rows], loose)


def txn(txn_id, party="P1", ts=0, amount=10.0, **more) -> dict:
    row = {
        "txn_id": txn_id, "party_id": party, "account_id": "A", "instrument_type": "cash",
        "txn_timestamp_ms_utc": ts, "direction": "debit", "amount": amount, "currency": "USD",
        "counterparty_id": "C1", "merchant_id": None, "channel": "pos", "country": "US",
        "state": None, "is_international": 0, "description": "d",
    }
    return {**row, **more}


def alert(alert_id, party="P1", start=0, end=10 * DAY, **more) -> dict:
    row = {
        "alert_id": alert_id, "party_id": party, "model_type": "cash", "model_version": "v1",
        "scenario_code": "S1", "alert_timestamp_ms_utc": end, "window_start_ms_utc": start,
        "window_end_ms_utc": end, "risk_score": 50.0, "severity": "high",
        "trigger_summary": f"summary {alert_id}", "supporting_txn_ids": "",
        "amount_total_usd": 1.0, "txn_count": 1, "features_json": "{}", "data_quality_flags": "",
    }
    return {**row, **more}


def inputs(spark, transactions=(), alerts=(), parties=(), counterparties=(), merchants=()):
    given = {
        "transactions": transactions, "parties": parties, "counterparties": counterparties,
        "merchants": merchants, "alerts": alerts,
    }
    return {name: table(spark, name, list(rows)) for name, rows in given.items()}
