"""Column expressions shared by the case operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A case is one party and one alert window.  These three columns are the key of
# every per-case frame; they are much narrower in a shuffle than the 64-character
# id, which is computed where rows leave the engine.
CASE_KEY = ["party_id", "case_window_start_ms_utc", "case_window_end_ms_utc"]

# US dollars per unit.  Other currencies count at face value.
USD_PER_UNIT = {"USD": 1.0, "EUR": 1.10, "GBP": 1.28, "CAD": 0.75, "MXN": 0.058}

DAY_MS = 86_400_000


def case_id() -> Column:
    """Stable id of a case: sha-256 over its key, joined by two pipes."""
    return F.sha2(F.concat_ws("||", *CASE_KEY), 256)


def usd(amount: str = "amount", currency: str = "currency") -> Column:
    """Amount in US dollars; unlisted or missing currencies stay as they are."""
    rates = F.create_map(*[F.lit(x) for pair in USD_PER_UNIT.items() for x in pair])
    return F.col(amount) * F.coalesce(F.try_element_at(rates, F.col(currency)), F.lit(1.0))


def pipe_items(column: str) -> Column:
    """Items of a pipe-delimited text; empty items and a missing text give none."""
    return F.array_remove(F.split(F.coalesce(F.col(column), F.lit("")), r"\|"), "")


def utc_day(ms: str) -> Column:
    """``yyyy-MM-dd`` of an epoch-millisecond column, whatever the session zone."""
    days = F.floor(F.col(ms) / F.lit(DAY_MS)).cast("int")
    return F.date_from_unix_date(days).cast("string")
