"""Per-case figures from daily partials, for windows that overlap.

The window join repeats a transaction for every window that holds it.  Here each transaction is
read into the partial figures of its party and day, days are put together into blocks of 2^level
days, and a window takes its whole days from at most two blocks per level: a window of a year
reads some fifteen rows instead of all its transactions, and a hundred windows over one year share
them.  Only the days that a window cuts at its ends are read from transactions.

Partials are counts, sums, smallest and largest, so they are put together without subtraction and
lose nothing.  Medians are exact: counts per value range are put together in the same way, which
tells the range that holds the median and its place in it, and then counts per value of that
range alone.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.cases import CASE_KEY, DAY_MS
from caseloom.operators.cases import MAX_LEVEL
from caseloom.operators.ranking import with_position
from caseloom.session import stage

START, END = CASE_KEY[1], CASE_KEY[2]
TS = "txn_timestamp_ms_utc"
# Ranges of values: this many for each doubling of the amount.
RANGES = 64
NAN_RANGE = 1 << 20
# Days are matched with wanted blocks by stretches of 2^CHUNK_LEVEL days, which hold 2^(CHUNK_LEVEL+1) - 1
# blocks of these levels.
CHUNK_LEVEL = 9
# So many parties with a window are always looked up before transactions are written.  Of more, only where they
# are less than half of all parties: else a shuffle of all transactions by party would drop hardly any.
FEW_PARTIES = 100_000


def _floor_day(ms: Column) -> Column:
    """UTC day of a time; exact for all times, also before 1970."""
    return F.floor((ms - F.pmod(ms, F.lit(DAY_MS))) / F.lit(DAY_MS)).cast("bigint")


def whole_days(cases: DataFrame) -> DataFrame:
    """Windows with ``_from`` and ``_to``: their whole days, the second one after the last."""
    windows = cases.where(F.col(START) <= F.col(END)).select(*CASE_KEY)
    return windows.withColumns(
        {"_from": _floor_day(F.col(START) + (DAY_MS - 1)), "_to": _floor_day(F.col(END) + 1)}
    )


def day_blocks(cases: DataFrame) -> DataFrame:
    """``_level, _block`` for each window: blocks of 2^level days that are its whole days, each once.

    On a level the window's days are [a, b) in blocks; what cannot be in a block of the next level is
    block a, if a is odd, and block b - 1, if b is odd.
    """
    days = whole_days(cases).where(F.col("_from") < F.col("_to"))
    top = F.least(F.lit(MAX_LEVEL), F.floor(F.log2(F.col("_to") - F.col("_from")))).cast("int")
    low = "-shiftright(-_from, k)"
    high = "shiftright(_to, k)"
    taken = F.expr(f"""flatten(transform(sequence(0, _top), k -> filter(array(
        named_struct('_level', k, '_block', {low}, '_in', {low} < {high} AND pmod({low}, 2) = 1),
        named_struct('_level', k, '_block', {high} - 1, '_in', {low} < {high} AND pmod({high}, 2) = 1)
    ), x -> x._in)))""")
    each = days.withColumn("_top", top).select(*CASE_KEY, F.explode(taken).alias("_at"))
    return each.select(*CASE_KEY, "_at._level", "_at._block")


def edge_days(cases: DataFrame) -> DataFrame:
    """``_day`` for each window: the days at its ends of which it has a part only, two at most."""
    days = whole_days(cases)
    first, last = _floor_day(F.col(START)), _floor_day(F.col(END))
    cut = F.array_distinct(
        F.filter(F.array(first, last), lambda d: (d < F.col("_from")) | (d >= F.col("_to")))
    )
    return days.select(*CASE_KEY, F.explode(cut).alias("_day"))


def value_range(value: str) -> Column:
    """Number of a value's range, larger for larger values."""
    x = F.col(value).cast("double")
    size = F.floor(F.least(F.log2(1 + F.abs(x)), F.lit(2048.0)) * RANGES).cast("int")
    signed = F.when(x < 0, -size).otherwise(size)
    return F.when(F.isnan(x), F.lit(NAN_RANGE)).otherwise(signed)


# Name of a partial -> how two of them are put together.
_TOGETHER = {
    "_n": F.sum, "_whole": F.sum, "_rest": F.sum, "_top": F.max, "_first": F.min, "_last": F.max,
    "_intl": F.sum, "_intl_n": F.sum,
}


def _figures(names: tuple[str, ...]) -> list[Column]:
    """Partials of transactions."""
    usd, whole = F.col("amount_usd"), F.rint("amount_usd")
    made = {
        "_n": F.count("*"),
        # Whole dollars and the rest apart, so that the total does not depend on the order of rows.
        "_whole": F.sum(whole),
        "_rest": F.sum(usd - whole),
        "_top": F.max("amount_usd"),
        "_first": F.min(TS),
        "_last": F.max(TS),
        "_intl": F.sum("is_international"),
        "_intl_n": F.count("is_international"),
    }
    return [made[name].alias(name) for name in names]


def _total() -> Column:
    return (F.col("_whole") + F.col("_rest")).alias("amount_total_usd")


class DayPartials:
    """Figures per case from partials per party and day.

    ``transactions`` have ``amount_usd``.  Those within the span of all windows are written once, without
    those of parties that have no window unless these are few; everything else is made from that table.  Results are those of the
    functions of the same names over the window join, whatever rows overlap.
    """

    def __init__(self, transactions: DataFrame, cases: DataFrame) -> None:
        self._cases = cases
        self._transactions = transactions

    @cached_property
    def facts(self) -> DataFrame:
        span = self._cases.where(F.col(START) <= F.col(END)).agg(F.min(START).alias("a"), F.max(END).alias("b")).first()
        near = self._transactions.where(F.col(TS).between(F.lit(span["a"]), F.lit(span["b"])))
        parties = stage(self._cases.select("party_id").distinct(), "window-parties")
        known = parties.count()
        if known <= FEW_PARTIES or 2 * known < near.select(F.approx_count_distinct("party_id")).first()[0]:
            near = near.join(parties, "party_id", "left_semi")
        kept = near.select(
            "party_id", TS, _floor_day(F.col(TS)).alias("_day"), "amount_usd", "is_international",
            "instrument_type", "counterparty_id", "merchant_id", value_range("amount_usd").alias("_range"),
        )
        return stage(kept, "day-facts")

    @cached_property
    def blocks(self) -> DataFrame:
        return stage(day_blocks(self._cases), "window-blocks")

    @cached_property
    def edges(self) -> DataFrame:
        """Transactions of cut days, once for each window that has a part of the day with them in it."""
        # Written, so that Spark knows how few they are: windows of whole days cut none.
        ends = stage(edge_days(self._cases), "cut-days").withColumnsRenamed({"party_id": "_party", "_day": "_cut"})
        at = F.col(TS)
        found = self.facts.join(
            ends,
            (F.col("party_id") == F.col("_party")) & (F.col("_day") == F.col("_cut"))
            & (at >= F.col(START)) & (at <= F.col(END)),
        ).drop("_party", "_cut")
        return stage(found, "edge-facts")

    def _placed(self, by_day: DataFrame, wanted: DataFrame, asked: list[str]) -> DataFrame:
        """Rows of days with ``_level, _block, _chunk`` of each ``wanted`` block that holds them.

        A day lies in a block of every level, most of which no window asks for, so these are left out
        before rows are shuffled by block: the wanted blocks of a stretch of 2^CHUNK_LEVEL days are a
        list of bounded length, whatever the windows.  Larger blocks are looked up by level, and have no
        ``_chunk``.  Rows of a block lie together by party, stretch and ``asked``, so grouping by these
        and the block needs no further shuffle.
        """
        stretch = ["party_id", "_chunk", *asked]
        small = wanted.where(F.col("_level") <= CHUNK_LEVEL).withColumn(
            "_chunk", F.expr(f"shiftright(_block, {CHUNK_LEVEL} - _level)")
        )
        lists = small.groupBy(*stretch).agg(F.collect_set(F.struct("_level", "_block")).alias("_wanted"))
        chunked = by_day.withColumn("_chunk", F.expr(f"shiftright(_day, {CHUNK_LEVEL})")).join(lists, stretch)
        holding = F.explode(F.expr("filter(_wanted, w -> w._block = shiftright(_day, w._level))"))
        found = chunked.select(*by_day.columns, "_chunk", holding.alias("_at")).select(*by_day.columns, "_chunk", "_at.*")
        if self._top_level <= CHUNK_LEVEL:
            return found
        large = wanted.where(F.col("_level") > CHUNK_LEVEL)
        # A party's own levels, 37 numbers at most.
        levels = large.groupBy("party_id").agg(F.collect_set("_level").alias("_levels"))
        place = ["party_id", "_level", "_block", *asked]
        above = (
            by_day.join(levels, "party_id")
            .withColumn("_level", F.explode("_levels"))
            .withColumns({"_block": F.expr("shiftright(_day, _level)"), "_chunk": F.lit(None).cast("bigint")})
            .join(large.select(*place).distinct(), place, "left_semi")
        )
        return found.unionByName(above.select(*found.columns))

    @cached_property
    def _top_level(self) -> int:
        """Highest level of any window's blocks."""
        return self.blocks.agg(F.max("_level").alias("top")).first()["top"] or 0

    def _merged(self, keys: list[str], names: tuple[str, ...], where: Column | None = None, only: DataFrame | None = None) -> DataFrame:
        """Partials ``names`` per case and ``keys``.  ``only`` (case key and first of ``keys``) leaves
        out what no row of it asks for."""
        facts = self.facts if where is None else self.facts.where(where)
        edges = self.edges if where is None else self.edges.where(where)
        add = [_TOGETHER[name](name).alias(name) for name in names]
        wanted, asked = self.blocks, []
        if only is not None:
            asked = keys[:1]
            wanted = wanted.join(only, CASE_KEY)
            edges = edges.join(only, [*CASE_KEY, *asked], "left_semi")
            facts = facts.join(only.select("party_id", *asked).distinct(), ["party_id", *asked], "left_semi")
        place = ["party_id", "_level", "_block", *asked]
        by_day = facts.groupBy("party_id", "_day", *keys).agg(*_figures(names))
        by_block = self._placed(by_day, wanted, asked).groupBy("party_id", "_chunk", "_level", "_block", *keys).agg(*add)
        inside = wanted.join(by_block, place).select(*CASE_KEY, *keys, *names)
        at_ends = edges.groupBy(*CASE_KEY, *keys).agg(*_figures(names))
        return inside.unionByName(at_ends).groupBy(*CASE_KEY, *keys).agg(*add)

    @cached_property
    def _by_instrument(self) -> DataFrame:
        return stage(self._merged(["instrument_type"], tuple(_TOGETHER)), "by-instrument")

    def medians(self) -> DataFrame:
        """Exact lower median of the dollars of each case that has any: ``median_amount_usd_case``."""
        some = F.col("amount_usd").isNotNull()
        ranges = self._merged(["_range"], ("_n",), some)
        order = Window.partitionBy(*CASE_KEY).orderBy("_range")
        before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        middle = F.floor((F.sum("_n").over(Window.partitionBy(*CASE_KEY)) - 1) / 2)
        placed = ranges.withColumns({"_before": before, "_middle": middle})
        held = (F.col("_before") <= F.col("_middle")) & (F.col("_middle") < F.col("_before") + F.col("_n"))
        asked = stage(placed.where(held).select(*CASE_KEY, "_range", (F.col("_middle") - F.col("_before")).alias("_place")), "median-ranges")
        values = self._merged(["_range", "amount_usd"], ("_n",), some, asked.drop("_place"))
        # A range of a large case has values for many tasks.
        numbered = with_position(values.drop("_range"), CASE_KEY, [F.col("amount_usd").asc()], "_low", "_n")
        found = numbered.join(asked, CASE_KEY).where(
            (F.col("_low") <= F.col("_place")) & (F.col("_place") < F.col("_low") + F.col("_n"))
        )
        return found.select(*CASE_KEY, F.col("amount_usd").alias("median_amount_usd_case"))

    def tx_summary(self) -> DataFrame:
        figures = self._by_instrument.groupBy(*CASE_KEY).agg(
            *[put(name).alias(name) for name, put in _TOGETHER.items()],
            F.sort_array(F.collect_set("instrument_type")).alias("_types"),
        )
        return figures.join(self.medians(), CASE_KEY, "left").select(
            *CASE_KEY,
            F.col("_n").alias("txn_count_case"),
            _total().alias("amount_total_usd_case"),
            "median_amount_usd_case",
            F.col("_top").alias("max_amount_usd_case"),
            F.col("_first").alias("first_txn_ms_utc_case"),
            F.col("_last").alias("last_txn_ms_utc_case"),
            F.try_divide("_intl", "_intl_n").alias("intl_ratio_case"),
            F.col("_types").alias("instrument_types_case"),
        )

    def instrument_breakdown(self) -> DataFrame:
        return self._by_instrument.select(*CASE_KEY, "instrument_type", F.col("_n").alias("txn_count"), _total())

    def counterparty_totals(self) -> DataFrame:
        names = ("_n", "_whole", "_rest", "_intl", "_intl_n", "_last")
        return self._merged(["counterparty_id"], names).select(
            *CASE_KEY, "counterparty_id", F.col("_n").alias("txn_count"), _total(),
            F.try_divide("_intl", "_intl_n").alias("intl_ratio"), F.col("_last").alias("last_txn_ms_utc"),
        )

    def merchant_totals(self) -> DataFrame:
        names = ("_n", "_whole", "_rest", "_last")
        return self._merged(["merchant_id"], names, F.col("merchant_id").isNotNull()).select(
            *CASE_KEY, "merchant_id", F.col("_n").alias("txn_count"), _total(), F.col("_last").alias("last_txn_ms_utc")
        )

    def timeline_daily(self) -> DataFrame:
        """Days of a case: whole ones from the partials of the party's day, cut ones from transactions."""
        names, keys = ("_n", "_whole", "_rest"), ["_day", "instrument_type"]
        by_day = self.facts.groupBy("party_id", *keys).agg(*_figures(names))
        # A block says which days of the party the window has.
        placed = self._placed(by_day, self.blocks, [])
        whole = self.blocks.join(placed, ["party_id", "_level", "_block"]).select(*CASE_KEY, *keys, *names)
        cut = self.edges.groupBy(*CASE_KEY, *keys).agg(*_figures(names))
        date = F.date_from_unix_date(F.col("_day").cast("int")).cast("string").alias("txn_date_utc")
        return whole.unionByName(cut).select(*CASE_KEY, date, "instrument_type", F.col("_n").alias("txn_count"), _total())
