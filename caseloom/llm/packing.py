"""Best-fit packing of token pieces after dominance reduction.

1. Each task encodes its texts, cuts what is longer than a sequence, and numbers its pieces among
   those of their length.  Pieces are staged without their tokens, unless these are asked for.
2. How to pack depends on lengths only, so the instance is a histogram with a count per length: it
   has as many entries as a sequence has tokens, however many documents there are.
3. Dominance reduction (Martello and Toth) looks at sets of a piece with at most two others.  A set
   that fills the sequence as well as any other set with that piece could (each other set's
   pieces fit into the places of its own) is in some best packing: it is fixed, for as many
   copies as there are, and leaves the histogram.  This goes on until no set dominates.
4. The rest is packed best-fit, longest first, again for all copies of a length together.
5. The plan says for each length which numbers go to which sequences and where.  It is broadcast
   (its size is bounded by the histogram's), and each piece finds its place by its number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import stage, text_or_empty
from caseloom.llm.seqfile import coder

LENGTH = 2048
RANKS = 44  # bits of a piece's number in a lookup key


class Histogram:
    """Counts of lengths, with the lengths that are there in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {size: n for size, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, items: tuple[int, ...], copies: int) -> None:
        for size in items:
            self.count[size] -= copies
            if not self.count[size]:
                del self.count[size]
                self.sizes.pop(bisect_left(self.sizes, size))

    def copies(self, items: tuple[int, ...]) -> int:
        """How often the whole set is there."""
        return min(self.count.get(size, 0) // items.count(size) for size in items)

    def without(self, size: int, above: int = 0) -> Iterator[int]:
        """Lengths beyond ``above``, rising, each as often as it is there, one ``size`` left out."""
        for at in range(bisect_right(self.sizes, above), len(self.sizes)):
            own = self.sizes[at]
            for _ in range(min(3, self.count[own] - (own == size))):
                yield own

    def largest(self, limit: int, size: int, other: int = 0) -> int:
        """The largest length up to ``limit``, one ``size`` and one ``other`` left out; 0 if there is none."""
        at = bisect_right(self.sizes, limit)
        while at:
            at -= 1
            own = self.sizes[at]
            if self.count[own] > (own == size) + (own == other):
                return own
        return 0

    def best_pair(self, limit: int, size: int) -> int:
        """The largest sum of two lengths up to ``limit``, one ``size`` left out; 0 if there is none."""
        best, low, high = 0, 0, bisect_right(self.sizes, limit) - 1
        while low <= high:
            a, b = self.sizes[low], self.sizes[high]
            there = self.count[b] - (b == size) > (a == b) and self.count[a] > (a == size)
            if a + b > limit:
                high -= 1
            else:
                if there:
                    best = max(best, a + b)
                elif low == high:
                    break
                elif self.count[b] <= (b == size):
                    high -= 1
                    continue
                low += 1
        return best


def _smallest(left: Histogram, size: int, k: int, above: int = 0) -> list[int]:
    out = []
    for own in left.without(size, above):
        out.append(own)
        if len(out) == k:
            break
    return out


def dominating(left: Histogram, size: int, length: int) -> tuple[int, ...]:
    """A set with ``size`` that dominates all sets with it that fit; empty if none of up to three
    pieces is found.  One set dominates another if the other's pieces can be shared out among its own
    so that none of these gets more than its own length."""
    rest = length - size
    low = _smallest(left, size, 3)
    if not low or low[0] > rest:
        return (size,)
    one = left.largest(rest, size)
    if one == rest or len(low) < 2 or low[0] + low[1] > rest:
        return (size, one)  # nothing longer fits, or no two pieces fit beside it
    if len(low) == 3 and sum(low) <= rest:
        return ()
    # Two pieces fit beside it, three do not.
    if one >= left.best_pair(rest, size):
        return (size, one)
    two = left.largest(rest - one, size, one)
    if two:
        # Pairs with both pieces longer than the second must not fit.
        longer = _smallest(left, size, 2, two)
        if len(longer) < 2 or sum(longer) > rest:
            return (size, one, two)
    return ()


def reduce(left: Histogram, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Sets that dominance fixes, with their copies; they are taken out of ``left``.

    A set that dominates while a piece is there still does when others have gone, as long as it
    is whole itself, so all its copies are fixed at once.
    """
    fixed, changed = [], True
    while changed:
        changed = False
        for size in reversed(left.sizes.copy()):
            while size in left.count:
                items = dominating(left, size, length)
                copies = left.copies(items) if items else 0
                if not copies:
                    break
                left.take(items, copies)
                fixed.append((items, copies))
                changed = True
    return fixed


@dataclass
class Group:
    """``copies`` equal sequences: (length, times, offset) of what is in each."""

    copies: int
    entries: list[tuple[int, int, int]]


def best_fit(left: Histogram, length: int) -> list[Group]:
    """Best-fit of the pieces, longest first; equal sequences are one group."""
    room: dict[int, list[Group]] = {}
    rooms: list[int] = []
    full: list[Group] = []

    def put(group: Group, free: int) -> None:
        if not free:
            full.append(group)
        elif free in room:
            room[free].append(group)
        else:
            room[free] = [group]
            insort(rooms, free)

    for size in reversed(left.sizes):
        n = left.count[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                free, group = length, Group(max(1, n // (length // size)), [])
            else:
                free = rooms[at]
                group = room[free].pop()
                if not room[free]:
                    del room[free]
                    rooms.pop(at)
            times = min(free // size, n)
            whole = min(group.copies, n // times)
            if whole < group.copies:
                put(Group(group.copies - whole, group.entries), free)
            put(Group(whole, [*group.entries, (size, times, length - free)]), free - times * size)
            n -= times * whole
    return full + [group for free in rooms for group in room[free]]


@dataclass
class Plan:
    """Where the pieces of each length go, by their number among those of that length."""

    key: np.ndarray  # length and first number of a stretch of equal treatment, rising
    first: np.ndarray  # that number
    sequence: np.ndarray  # its sequence
    times: np.ndarray  # pieces of the stretch in each sequence
    offset: np.ndarray  # place of the first of them
    sequences: int

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << RANKS) | number, side="right") - 1
        copy, own = np.divmod(number - self.first[at], self.times[at])
        return self.sequence[at] + copy, self.offset[at] + own * length


def plan(counts: dict[int, int], length: int = LENGTH) -> Plan:
    """Packing of ``counts`` pieces by length into sequences of ``length`` tokens."""
    left = Histogram(counts)
    if left.sizes and not 0 < left.sizes[0] <= left.sizes[-1] <= length:
        raise ValueError("pieces must have between one token and a whole sequence")
    groups = []
    for items, copies in reduce(left, length):
        starts = np.cumsum((0, *items))
        groups.append(Group(copies, [(size, 1, int(at)) for size, at in zip(items, starts, strict=False)]))
    groups += best_fit(left, length)
    used, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for group in groups:
        for size, times, offset in group.entries:
            rows.append(((size << RANKS) | used[size], used[size], sequence, times, offset))
            used[size] += times * group.copies
        sequence += group.copies
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequence)


def _pieces(docs: DataFrame, vocabulary: str, end_id: int, length: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Pieces of every row, numbered by their task among those of a length; without their tokens,
    unless ``keep_ids``."""
    rows = docs.select(F.col(id_col), text_or_empty(text_col).cast("binary").alias("t"))
    kinds = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType()}
    kinds |= {"task": T.IntegerType(), "number": T.LongType()} | ({"ids": T.ArrayType(T.IntegerType())} if keep_ids else {})
    schema = T.StructType([rows.schema[0], *(T.StructField(name, kind) for name, kind in kinds.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = coder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], own.kind).tobytes()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            row, piece, size, check, held = [], [], [], [], []
            for k, ids in enumerate(own.encode_steps(batch.column(1))):
                wide = np.frombuffer(ids + end, own.kind).astype("<u4")
                for number, at in enumerate(range(0, len(wide), length)):
                    part = wide[at : at + length]
                    row.append(k)
                    piece.append(number)
                    size.append(len(part))
                    check.append(zlib.crc32(part))
                    if keep_ids:
                        held.append(part.astype(np.int32))
            sizes = np.array(size, np.int64)
            order = np.argsort(sizes, kind="stable")
            run = np.flatnonzero(np.r_[True, np.diff(sizes[order]) > 0][: len(order)])
            within = np.empty(len(order), np.int64)
            within[order] = np.arange(len(order)) - np.repeat(run, np.diff(np.r_[run, len(order)]))
            pieces = np.array(piece, np.int32)
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(pieces), pa.array(pieces.astype(np.int64) * length),
                pa.array(sizes), pa.array(check, pa.int64()), pa.array(np.full(len(row), task, np.int32)),
                pa.array(within + seen[sizes]),
            ]
            if keep_ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
            seen += np.bincount(sizes, minlength=length + 1)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(work, schema)


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 0, length: int = LENGTH, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row,
    with ``keep_ids`` also ``ids``.

    Null and empty texts are the end id alone; very long ones are cut into pieces of ``length``
    tokens, the last with what is left.  Repeated rows and null ids are packed like others, pieces of
    equal length are interchangeable, no rows give no rows, and other columns are ignored.
    """
    pieces = stage(_pieces(docs, vocabulary, end_id, length, id_col, text_col, keep_ids), "pieces")
    numbers = ["task", "number", "length"]
    counts = stage(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row per length
    made = docs.sparkSession.sparkContext.broadcast(plan({r["length"]: r["n"] for r in total}, length))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    keep = [c for c in pieces.columns if c not in numbers[:2]]
    placed = pieces.join(base, ["task", "length"]).select(*keep, (F.col("base") + F.col("number")).alias("number"))
    schema = T.StructType([f for f in placed.schema if f.name != "number"])
    schema = schema.add("sequence_id", T.LongType()).add("offset", T.LongType())

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = made.value.places(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            kept = batch.drop_columns(["number"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return placed.mapInArrow(put, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, spans`` of pieces that :func:`pack` placed with ``keep_ids``: all tokens of a
    sequence, and where in it each piece lies (``offset, length, ids_crc32``).  A sequence is bounded."""
    each = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "ids_crc32", "ids"))).alias("found")
    )
    spans = F.transform("found", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p["ids_crc32"].alias("ids_crc32")))
    return each.select("sequence_id", F.flatten("found.ids").alias("ids"), spans.alias("spans"))
