"""The nested packet of a case, its JSON form, and all frames behind it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.cases import CASE_KEY, case_id
from caseloom.operators import cases as C
from caseloom.operators import evidence as E
from caseloom.operators.partials import DayPartials
from caseloom.session import stage


# Groups of the JSON form, as output name -> packet column.
_PARTY = [
    "party_id", "party_type", "party_name", "industry", "country", "state", "onboarding_date",
    "risk_rating", "expected_monthly_volume_usd", "expected_avg_txn_usd",
]
_ALERTS_SUMMARY = [
    "alerts_count", "alerts_high", "alerts_medium", "alerts_low", "max_risk_score",
    "median_risk_score", "model_types", "scenario_codes",
]
_TX_SUMMARY = [
    "txn_count_case", "amount_total_usd_case", "median_amount_usd_case", "max_amount_usd_case",
    "first_txn_ms_utc_case", "last_txn_ms_utc_case", "intl_ratio_case", "instrument_types_case",
]
JSON_LAYOUT: dict[str, str | dict[str, str]] = {
    "case_id": "case_id",
    "party": {name: name for name in _PARTY},
    "window": {
        "start_ms_utc": "case_window_start_ms_utc",
        "end_ms_utc": "case_window_end_ms_utc",
    },
    "alerts_summary": {name: name for name in _ALERTS_SUMMARY},
    "alerts": "alerts",
    "tx_summary": {name: name for name in _TX_SUMMARY},
    "top_counterparties": "top_counterparties",
    "top_merchants": "top_merchants",
    "supporting_transactions": "supporting_transactions",
}


def with_case_id(df: DataFrame) -> DataFrame:
    """Put the id in front of a frame under the case key."""
    return df.select(case_id().alias("case_id"), *df.columns)


@dataclass(frozen=True)
class Limits:
    supporting_transactions: int = E.SUPPORTING_TRANSACTIONS
    top_counterparties: int = E.TOP_COUNTERPARTIES
    top_merchants: int = E.TOP_MERCHANTS
    alert_page: int = E.ALERT_PAGE


class CaseFrames:
    """The per-case frames of one run, each built when first asked for.

    Five of them read the case transactions.  With ``staged`` the window join is
    written once and each reads just its columns; without it each repeats the
    join, which only makes sense where a single frame is wanted.

    With ``by_day`` the figures come from daily partials instead of the join, and the join is
    asked for listed transactions only: for windows that overlap, or parties with many
    transactions a day.  The frames are the same.
    """

    def __init__(
        self,
        inputs: Mapping[str, DataFrame],
        limits: Limits = Limits(),
        staged: bool = True,
        by_day: bool = False,
    ) -> None:
        self._inputs = inputs
        self._limits = limits
        self._staged = staged
        self._by_day = by_day

    @cached_property
    def cases(self) -> DataFrame:
        return C.case_index(self._inputs["alerts"])

    @cached_property
    def case_party(self) -> DataFrame:
        return C.case_party(self.cases, self._inputs["parties"])

    @cached_property
    def alerts_case(self) -> DataFrame:
        return C.alerts_in_cases(self._inputs["alerts"])

    @cached_property
    def alerts_summary(self) -> DataFrame:
        return C.alerts_summary(self.alerts_case, self._staged)

    @cached_property
    def alert_pages(self) -> DataFrame:
        return E.alert_pages(self.alerts_case, self._limits.alert_page)

    @cached_property
    def tx_case(self) -> DataFrame:
        joined = C.with_usd(C.transactions_in_cases(self._inputs["transactions"], self.cases))
        return stage(joined, "tx-case") if self._staged else joined

    @cached_property
    def partials(self) -> DayPartials:
        return DayPartials(C.with_usd(self._inputs["transactions"]), self.cases)

    @cached_property
    def listed_tx_case(self) -> DataFrame:
        """Case transactions that alerts of their party list; only these are joined to windows."""
        ids = self.supporting_ids.select("party_id", "txn_id").distinct()
        listed = self._inputs["transactions"].join(ids, ["party_id", "txn_id"], "left_semi")
        return C.transactions_in_cases(listed.select(*self._inputs["transactions"].columns), self.cases)

    @cached_property
    def tx_summary(self) -> DataFrame:
        if self._by_day:
            return self.partials.tx_summary()
        return C.tx_summary(self.tx_case, self._staged)

    @cached_property
    def instrument_breakdown(self) -> DataFrame:
        if self._by_day:
            return self.partials.instrument_breakdown()
        return C.instrument_breakdown(self.tx_case)

    @cached_property
    def counterparty_totals(self) -> DataFrame:
        if self._by_day:
            return self.partials.counterparty_totals()
        return C.counterparty_totals(self.tx_case)

    @cached_property
    def merchant_totals(self) -> DataFrame:
        if self._by_day:
            return self.partials.merchant_totals()
        return C.merchant_totals(self.tx_case)

    @cached_property
    def top_counterparties(self) -> DataFrame:
        return E.top_counterparties(
            self.counterparty_totals, self._inputs["counterparties"], self._limits.top_counterparties
        )

    @cached_property
    def top_merchants(self) -> DataFrame:
        return E.top_merchants(
            self.merchant_totals, self._inputs["merchants"], self._limits.top_merchants
        )

    @cached_property
    def supporting_ids(self) -> DataFrame:
        return E.supporting_ids(self.alerts_case)

    @cached_property
    def supporting_transactions(self) -> DataFrame:
        if not self._staged and not self._by_day:
            return E.supporting_transactions_read(
                self.alerts_case, self._inputs["transactions"], self._limits.supporting_transactions
            )
        found = self.listed_tx_case if self._by_day else self.tx_case
        return E.supporting_transactions(
            self.alerts_case, found, self._limits.supporting_transactions
        )

    @cached_property
    def timeline(self) -> DataFrame:
        if self._by_day:
            return self.partials.timeline_daily()
        return C.timeline_daily(self.tx_case)

    @cached_property
    def packet(self) -> DataFrame:
        """One row per case.  Sides are one row per case, so the joins cannot fan
        out, and all are partitioned on the same key; a missing side gives nulls."""
        sides = [
            self.alerts_summary,
            self.alert_pages.where(F.col("page") == 0).drop("page"),
            self.tx_summary,
            E.counterparty_list(self.top_counterparties),
            E.merchant_list(self.top_merchants),
            E.supporting_list(self.supporting_transactions),
        ]
        joined = reduce(lambda left, side: left.join(side, CASE_KEY, "left"), sides, self.case_party)
        return with_case_id(joined).select(*schemas.schema("case_packet").fieldNames())

    @cached_property
    def further_alerts(self) -> DataFrame:
        """Alert pages that did not fit into the packet row."""
        rest = with_case_id(self.alert_pages.where(F.col("page") > 0))
        return rest.select("case_id", "party_id", "page", "alerts")

    @cached_property
    def pages(self) -> DataFrame:
        """Packets with all alerts, see :func:`paged`."""
        return paged(self.packet, self.further_alerts)

    @cached_property
    def timeline_daily(self) -> DataFrame:
        columns = schemas.schema("tx_timeline_daily").fieldNames()
        return with_case_id(self.timeline).select(*columns)


def _json_value(source: str | dict[str, str]) -> Column:
    if isinstance(source, str):
        return F.col(source)
    return F.struct(*[F.col(column).alias(name) for name, column in source.items()])


def paged(packet: DataFrame, further: DataFrame) -> DataFrame:
    """The packet with ``page`` and ``pages``: one row per page of alerts.

    A case of one page is its packet row.  Each further page repeats the row with its own
    alerts, so the rows of a case hold all of them and no row grows without limit.
    """
    rest = packet.drop("alerts").join(further.select("case_id", "page", "alerts"), "case_id")
    counts = further.groupBy("case_id").agg((F.max("page") + 1).alias("pages"))
    rows = packet.withColumn("page", F.lit(0)).unionByName(rest)
    return rows.join(counts, "case_id", "left").withColumn("pages", F.coalesce("pages", F.lit(1)))


def packet_json(pages: DataFrame) -> DataFrame:
    """One JSON text per row of :func:`paged`; null fields are left out.

    The text of a case with several pages says which of them it is.
    """
    many = F.col("pages") > 1
    numbers = [F.when(many, F.col("page")).alias("alert_page"), F.when(many, F.col("pages")).alias("alert_pages")]
    body = F.struct(*[_json_value(source).alias(name) for name, source in JSON_LAYOUT.items()], *numbers)
    return pages.select("case_id", F.to_json(body).alias("case_packet_json"), "page", "pages")
