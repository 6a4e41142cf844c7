"""Risk-ordered queue of cases and keyed reads of the written datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.operators.ranking import with_position

# Queue columns and page sizes.
QUEUE_COLUMNS = [
    "case_id", "party_id", "party_type", "party_name", "risk_rating", "max_risk_score",
    "alerts_count", "txn_count_case", "amount_total_usd_case", "last_txn_ms_utc_case",
    "case_window_start_ms_utc", "case_window_end_ms_utc",
]
PAGE_DEFAULT = 50
PAGE_MAX = 500

# Pages up to this depth come from a top-k of the packets; deeper ones would make
# every task hold that many rows, so they are cut out of the numbered queue.
SHALLOW = 10_000


class CaseNotFound(KeyError):
    """No packet has this case id."""


def _riskiest_first() -> list[Column]:
    return [
        F.col("max_risk_score").desc_nulls_last(),
        F.col("last_txn_ms_utc_case").desc_nulls_last(),
        F.col("case_id").asc(),
    ]


def queue(packets: DataFrame) -> DataFrame:
    """All cases by risk, then most recent transaction."""
    return packets.select(*QUEUE_COLUMNS).orderBy(*_riskiest_first())


def numbered_queue(packets: DataFrame) -> DataFrame:
    """The queue with each case's place (from 0), computed without a single-task sort."""
    return with_position(packets.select(*QUEUE_COLUMNS), [], _riskiest_first())


def _page_size(limit: int, offset: int) -> int:
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    return min(limit, PAGE_MAX)


def stored_page(numbered: DataFrame, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """:func:`page` from the written queue, at any depth: the filter on ``position`` reaches
    the scan, and nothing is sorted but the page."""
    limit = _page_size(limit, offset)
    total = numbered.select(F.count("*")).scalar()
    place = F.col("position")
    rows = numbered.where((place >= offset) & (place < offset + limit))
    return rows.withColumn("total", total).orderBy("position")


def page(packets: DataFrame, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """One page of the queue; ``total`` counts all cases.  Where the queue is written,
    :func:`stored_page` is cheaper for deep pages."""
    limit = _page_size(limit, offset)
    total = packets.select(F.count("*")).scalar()
    if offset + limit <= SHALLOW:
        rows = queue(packets).offset(offset).limit(limit)
        # The window sees this page only.
        place = F.row_number().over(Window.orderBy(*_riskiest_first())) - 1 + offset
        rows = rows.withColumn("position", place.cast("bigint"))
    else:
        rows = numbered_queue(packets).where(
            (F.col("position") >= offset) & (F.col("position") < offset + limit)
        )
    return rows.withColumn("total", total).orderBy("position")


def highest_risk(packets: DataFrame, n: int = 20) -> DataFrame:
    columns = [
        "case_id", "party_id", "max_risk_score", "alerts_count",
        "txn_count_case", "amount_total_usd_case",
    ]
    order = [F.col("max_risk_score").desc_nulls_last(), F.col("case_id").asc()]
    return packets.select(*columns).orderBy(*order).limit(n)


def case_packet(packets: DataFrame, case: str) -> DataFrame:
    """The packet of one case; the filter reaches the file scan."""
    found = packets.where(F.col("case_id") == case).limit(1)
    if found.isEmpty():
        raise CaseNotFound(case)
    return found


def case_timeline(timeline: DataFrame, case: str) -> DataFrame:
    """Days of one case in order; a case without transactions has none."""
    return timeline.where(F.col("case_id") == case).orderBy("txn_date_utc", "instrument_type")


def of_cases(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of many cases at once: those whose id is in ``ids.case_id``."""
    return df.join(ids.select("case_id").distinct(), "case_id", "left_semi")


def case_counterparties(packets: DataFrame, case: Column | str, n: int = 50) -> DataFrame:
    """Largest counterparties of one case, opened from its packet.

    ``case`` is an id or a scalar subquery that gives one.
    """
    wanted = F.lit(case) if isinstance(case, str) else case
    opened = packets.where(F.col("case_id") == wanted).select(
        "case_id", "party_id", F.inline("top_counterparties")
    )
    order = [F.round("amount_total_usd", 6).desc(), F.col("counterparty_id").asc()]
    return opened.orderBy(*order).limit(n)
