"""Top rows and row positions that hold up when one group has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.session import stage


def top_n(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of every group, numbered from 1.

    Spark plans this filter as a group limit that runs before the shuffle, so a
    task sends at most ``n`` rows of a group however large the group is.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


# Rows of one group that an array, or an exact sketch of a median, may hold.
GROUP_BOUND = 10_000


def crowded_groups(df: DataFrame, group: Sequence[str], bound: int) -> DataFrame | None:
    """Keys of the groups with more than ``bound`` rows, or None if a count finds none.

    The count is one aggregation over the key columns.  Knowing the answer keeps the
    extra steps for large groups out of the usual plan.
    """
    keys = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > bound)
    return None if keys.isEmpty() else keys.select(*group)


def median_column(column: str) -> Column:
    """Lower median; exact for groups of up to ``GROUP_BOUND`` rows.

    The sketch keeps every value while 2 * rows / accuracy stays below one.
    """
    return F.percentile_approx(column, 0.5, 4 * GROUP_BOUND)


def exact_medians(
    summary: DataFrame, df: DataFrame, group: Sequence[str], column: str, median: str, rows: str
) -> DataFrame:
    """``summary`` with an exact ``median`` for groups too large for the sketch.

    ``rows`` is the summary's count of a group's rows, which says what groups are large: a
    staged summary costs no second pass over ``df`` for that, another one a count of its keys.
    Equal values of such a group become one
    row with their number before the shuffle, so a frequent value cannot fill a task.  The
    values are placed by these numbers across many tasks, and the middle one is found by its place.
    """
    large = summary.where(F.col(rows) > GROUP_BOUND).select(*group)
    if large.isEmpty():
        return summary
    values = df.where(F.col(column).isNotNull()).join(large, list(group), "left_semi")
    counted = values.groupBy(*group, column).agg(F.count("*").alias("_times"))
    placed = with_position(counted, group, [F.col(column).asc()], "_place", "_times", "_all")
    middle = F.floor((F.col("_all") - 1) / 2)
    found = placed.where((F.col("_place") <= middle) & (middle < F.col("_place") + F.col("_times")))
    found = found.select(*group, F.col(column).alias("_exact"))
    return summary.join(found, list(group), "left").select(
        *[F.coalesce("_exact", c).alias(c) if c == median else F.col(c) for c in summary.columns]
    )


def with_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    position: str = "position",
    weight: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Number the rows of every group from 0, also where a group fills many tasks.

    A plain window would send a whole group to one task.  Here a range sort on
    (group, order) cuts large groups into several partitions, and a row's number
    is its offset inside the partition plus the rows of its group in the
    partitions before.  The sorted rows are staged, so the partition numbers
    cannot change between the two uses.  An empty ``group`` numbers all rows.

    With ``weight`` a row stands for that many rows and gets the number of the first.
    ``total`` names a column for the group's number of rows.
    """
    tag = "_row_tag"
    keys = [F.col(c) for c in group]
    tagged = stage(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(tag, F.monotonically_increasing_id()),
        "positions",
    ).withColumn("_part", F.shiftright(tag, 33))

    # One row per group and partition: few, as only the groups at a partition's
    # edges can be in more than one.
    size = F.count("*") if weight is None else F.sum(weight)
    pieces = tagged.groupBy(*group, "_part").agg(F.min(tag).alias("_first"), size.alias("_rows"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col("_part").alias("_g_part"),
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *([F.sum("_rows").over(whole).alias(total)] if total else []),
    )
    match = F.col("_part") == F.col("_g_part")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = F.col(tag) - F.col("_first")
    if weight is not None:
        # A piece is one group's share of one partition.
        piece = Window.partitionBy(*group, "_part").orderBy(tag)
        above = F.sum(weight).over(piece.rowsBetween(Window.unboundedPreceding, -1))
        tagged = tagged.withColumn("_inside", F.coalesce(above, F.lit(0)))
        inside = F.col("_inside")
    # Without a group these are a row per partition, beside which the rows stay where they are.
    offsets = offsets if group else F.broadcast(offsets)
    return tagged.join(offsets, match).select(
        *df.columns, (inside + F.col("_before")).alias(position), *([total] if total else [])
    )
