"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits.  Its row of the pivot table holds the Hamming distances to 32
reference fingerprints.  By the triangle inequality two fingerprints whose rows differ by
more than ``limit`` in any coordinate are further apart than ``limit``, so such a pair is
discarded and only the survivors are verified.

Which pairs meet at all follows from exact block keys: the bits are cut into
``limit + 2`` blocks, of which two fingerprints within ``limit`` agree in two at least, so
each pair within the limit shares one of the keys (block, block, bits).  Equal fingerprints
are one row before that.  A key with many different fingerprints is cut into chunks, and
every pair of chunks is a cell of its own, so no task holds a whole hot key.  Inside a cell
a pair that earlier links connect already is not looked at again, so a cell gives links that
connect the same fingerprints as all its pairs would, and not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import stage, text_or_empty
from caseloom.llm.components import connected_components

BITS = 64
LIMIT = 4
SHINGLE = 4
PIVOTS = 32
CHUNK = 1024
ROWS = 65_536  # shingles or rows that one numpy step takes


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of one text in UTF-8: over all shingles of lower-cased (A-Z) words, bit i is
    set if it is set in over half of their XXH64 values."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), ROWS):
        cut = zip(starts[at : at + ROWS].tolist(), ends[at : at + ROWS].tolist(), strict=True)
        values = np.array([digest(joined[i:j], seed) for i, j in cut], "<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None
) -> DataFrame:
    """``node`` (the id as long) and ``fp`` (the fingerprint as signed long) per row, and
    ``carried``, if ``carry`` is given; a null text counts as empty, whose fingerprint is zero."""
    rows = docs.select(
        text_or_empty(text_col).cast("binary").alias("t"), F.col(id_col).cast("long").alias("node"),
        *([] if carry is None else [carry.alias("carried")]),
    )
    kept = rows.drop("t")
    schema = T.StructType([*kept.schema.fields, T.StructField("fp", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_buffer().to_pybytes()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(values, pa.int64())], names=[*batch.schema.names[1:], "fp"]
            )

    return rows.mapInArrow(work, schema)


def pivots(count: int = PIVOTS, seed: int = 20) -> np.ndarray:
    """Reference fingerprints, the same in every task."""
    return np.random.default_rng(seed).integers(0, 2**63, count, np.uint64) * np.uint64(2) + (
        np.arange(count) % 2
    ).astype(np.uint64)


def distance_table(fp: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances, one row per fingerprint, one column per reference."""
    return np.bitwise_count(fp[:, None] ^ references[None, :]).astype(np.int8)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows one label, the smallest."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while not np.array_equal(above := label[label], label):
            label[:] = above


def cell_links(cell, crossing, side, fp, references, limit=LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs that connect what all links of each cell connect.

    ``cell`` is sorted.  Rows of a crossing cell are compared with the other side only.
    Rows k apart are compared together, for k = 1, 2, ..., so memory is a few arrays.
    """
    n = len(fp)
    end = np.searchsorted(cell, cell, side="right")
    near = distance_table(fp, references)
    label = np.arange(n)
    first, second = [], []
    i, k = np.arange(n), 1
    while True:
        i = i[i + k < end[i]]
        if not len(i):
            break
        j = i + k
        open_ = (label[i] != label[j]) & ~(crossing[i] & (side[i] == side[j]))
        a, b = i[open_], j[open_]
        for p in range(near.shape[1]):
            if not len(a):
                break
            stay = np.abs(near[a, p] - near[b, p]) <= limit
            a, b = a[stay], b[stay]
        if len(a):
            stay = np.bitwise_count(fp[a] ^ fp[b]) <= limit
            a, b = a[stay], b[stay]
        if len(a):
            first.append(a)
            second.append(b)
            _unite(label, a, b)
        k += 1
    none = np.empty(0, np.int64)
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def _block_keys(limit: int) -> Column:
    blocks = limit + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, (x, y) in enumerate(combinations(range(blocks), 2)):
        mask = 0
        for block in (x, y):
            mask |= ((1 << (edges[block + 1] - edges[block])) - 1) << edges[block]
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).alias("blocks"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    return F.explode(F.array(*keys))


def links(classes: DataFrame, limit: int = LIMIT, chunk: int = CHUNK, references: int = PIVOTS) -> DataFrame:
    """Links ``a, b`` between the ``node``s of different fingerprints ``fp`` that are within
    ``limit`` bits, enough of them to connect all that are linked."""
    keyed = classes.select("node", "fp", _block_keys(limit).alias("key")).select("node", "fp", "key.*")
    hot = (
        keyed.groupBy("blocks", "bits")
        .count()
        .where(F.col("count") > chunk)
        .select("blocks", "bits", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    )
    placed = keyed.join(hot, ["blocks", "bits"], "left").withColumns(
        {"chunks": F.coalesce("chunks", F.lit(1))}
    ).withColumns({"side": F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")})
    cells = placed.select(
        "node", "fp", "blocks", "bits", "side",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"),
    ).select(
        "node", "fp", "blocks", "bits", "side",
        F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"),
    )
    place = ["blocks", "bits", "low", "high"]
    keys = pivots(references)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def found(rows):
            node, fp, side, crossing, cell = rows
            a, b = cell_links(cell, crossing, side, fp.view(np.uint64), keys, limit)
            return pa.RecordBatch.from_arrays(
                [pa.array(node[a]), pa.array(node[b])], names=["a", "b"]
            )

        for batch in batches:
            got = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
            if not batch.num_rows:
                continue
            key = np.stack([got[name].astype(np.int64) for name in place])
            new = [got["node"], got["fp"], got["side"], got["low"] != got["high"]]
            if held is not None:
                new = [np.concatenate(pair) for pair in zip(held[:4], new, strict=True)]
                key = np.concatenate([held[4], key], axis=1)
            cell = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut >= ROWS // 2:  # the last cell may go on in the next batch
                yield found([x[:cut] for x in new] + [cell[:cut]])
                held = [x[cut:] for x in new] + [key[:, cut:]]
            else:
                held = [*new, key]
        if held is not None:
            key = held[4]
            cell = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
            yield found([*held[:4], cell])

    return (
        cells.repartition(*place)
        .sortWithinPartitions(*place, "fp")
        .mapInArrow(work, "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
    carry: Column | None = None,
) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable
    by links of at most ``limit`` differing bits) per row of ``docs``; with ``carry`` also
    ``carried``, that column of the row.

    Null and empty texts have fingerprint zero and link like any other.  Equal rows are kept;
    very long texts are taken whole.
    Rows with a null id have a fingerprint and take the component of their fingerprint; if
    nothing but null ids is in reach, the component is null.  No rows give no rows; other
    columns are ignored.
    """
    marked = stage(fingerprints(docs, id_col, text_col, carry), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("node").alias("low"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    parts = connected_components(links(classes.select("node", "fp"), limit))
    placed = classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    whole = placed.join(lowest, "component").select("fp", "component_id")
    # A fingerprint of many rows is one row of the smaller side: the join is split where it is hot.
    return marked.join(whole, "fp").select(
        F.col("node").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        *([] if carry is None else ["carried"]),
    )
