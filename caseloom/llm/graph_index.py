"""Embedding near-duplicates over a robust-pruned flat graph.

1. Equal vectors become one class with a count.  Centres are fitted on a bounded sample
   (``SAMPLE`` classes with the smallest hash), and every class goes to its ``OVERLAP`` nearest
   cells and to every other that a point half-way to a partner in range may have as nearest (see
   :func:`reached`), so partners meet there.  A cell of more than ``SHARD`` classes is cut into chunks by hash; each pair of chunks
   is a shard, so no task holds a whole hot cell and no pair of a cell is lost.
2. Each shard builds a graph of the classes that have its cell among their ``OVERLAP`` nearest, so that a
   class is in as many graphs however many cells there are: classes are inserted in doubling batches; a greedy search on the
   graph so far and the batch itself give the candidates, robust pruning keeps at most ``DEGREE`` of them, and
   reverse edges are pruned alike.
3. The adjacency lists of all shards are united by class.
4. Each shard searches for all its classes, on the united lists: best-first from the shard's
   medoids and the class itself, then, range-expanding, from every class found in range until
   nothing in range is unexpanded.  Hits are verified by the cosine in double precision.
5. A pair that is in several cells counts in the smallest of them.  Shards give counts and
   links that connect what is linked, never all pairs of a group.

:func:`audit` measures the recall against brute force.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import stage
from caseloom.llm.components import connected_components

COSINE = 0.9
SAMPLE = 16_384
CELLS = 1_024  # at most
FILL = 1_024  # classes of a usual cell
SHARD = 4_096  # classes that one task compares: cells overlap, so a usual one has several times FILL
OVERLAP = 2  # at least
SIGMAS = 2.5
DEGREE = 24
POOL = 64  # candidates that pruning looks at
MATES = 16  # and those of the same batch
WIDTH = 32  # expansions of a search before only hits are expanded
MEDOIDS = 8
ALPHA = 1.2
QUERIES = 512  # searched side by side


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow."""
    vectors = np.asarray(vectors, np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _rows(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(column), 0))


def search(x, adjacency, entries, queries, width=WIDTH, reach=None, own=None) -> np.ndarray:
    """Cosines of each query with each visited row of ``x``; -2 where not visited.

    Every query expands its best visited row ``width`` times, then all visited rows with a
    cosine of ``reach`` at least.  ``own``: the queries are these rows of ``x``, and each starts
    from itself as well, so what it was linked to when it was inserted is always seen.
    """
    n, q = len(x), len(queries)
    rows = np.arange(q)
    cosine = np.full((q, n), -2.0)
    cosine[:, entries] = queries @ x[entries].T
    open_ = np.full((q, n), -2.0)  # cosine of visited rows that are not expanded
    open_[:, entries] = cosine[:, entries]
    if own is not None:
        cosine[rows, own] = open_[rows, own] = 1.0

    def expand(who: np.ndarray, what: np.ndarray) -> None:
        open_[who, what] = -2.0
        near = adjacency[what]
        at = np.repeat(who, near.shape[1])
        near = near.ravel()
        fresh = near >= 0
        at, near = at[fresh], near[fresh]
        fresh = cosine[at, near] < -1.5
        pair = np.unique(at[fresh] * np.int64(n) + near[fresh])
        at, near = pair // n, pair % n
        for cut in range(0, len(at), 65_536):
            a, b = at[cut : cut + 65_536], near[cut : cut + 65_536]
            value = np.einsum("ij,ij->i", queries[a], x[b])
            cosine[a, b] = value
            open_[a, b] = value

    for _ in range(min(width, n)):
        best = open_.argmax(axis=1)
        live = open_[rows, best] > -1.5
        if not live.any():
            break
        expand(rows[live], best[live])
    if reach is not None:
        while True:
            who, what = np.nonzero(open_ >= reach)
            if not len(who):
                break
            # Some of a query's hits at a time: their neighbours are mostly the same.
            first = np.r_[True, who[1:] != who[:-1]]
            turn = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
            expand(who[turn < 4], what[turn < 4])
    return cosine


def prune(x, points, pool, cosine, degree=DEGREE, alpha=ALPHA) -> np.ndarray:
    """Robust pruning: of each point's pool (-1: none) keep the nearest, drop what is ``alpha``
    times nearer to it than to the point, and go on."""
    order = np.argsort(-np.where(pool >= 0, cosine, -3.0), axis=1, kind="stable")
    pool = np.take_along_axis(pool, order, axis=1)
    cosine = np.take_along_axis(cosine, order, axis=1)
    live = (pool >= 0) & (pool != points[:, None])
    near = x[np.maximum(pool, 0)]
    own = np.sqrt(np.maximum(2 - 2 * cosine, 0))
    kept = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        first = live.argmax(axis=1)
        some = live[rows, first]
        if not some.any():
            break
        chosen = pool[rows, first]
        kept[some, k] = chosen[some]
        between = np.einsum("bd,bcd->bc", near[rows, first], near)
        live &= alpha * np.sqrt(np.maximum(2 - 2 * between, 0)) > own
        live[rows, first] = False
        live &= pool != chosen[:, None]
    return kept


def medoids(x: np.ndarray, count: int = MEDOIDS) -> np.ndarray:
    """The row nearest to the mean, then rows that are least like those before."""
    found = [int((x @ x.mean(axis=0)).argmax())]
    like = x @ x[found[0]]
    for _ in range(min(count, len(x)) - 1):
        found.append(int(like.argmin()))
        like = np.maximum(like, x @ x[found[-1]])
    return np.unique(found)


def build(x: np.ndarray, seed: int = 10) -> np.ndarray:
    """Adjacency of a graph over the rows of ``x``, -1 where a row has fewer neighbours."""
    n = len(x)
    adjacency = np.full((n, DEGREE), -1, np.int64)
    entries = medoids(x)
    rest = np.setdiff1d(np.random.default_rng(seed).permutation(n), entries, assume_unique=True)
    rest = np.random.default_rng(seed).permutation(rest)
    among = x[entries] @ x[entries].T
    adjacency[entries] = prune(x, entries, np.tile(entries, (len(entries), 1)), among, alpha=1.0)
    done = 0
    while done < len(rest):
        batch = rest[done : done + min(QUERIES, max(1, done + len(entries)))]
        done += len(batch)
        cosine = search(x, adjacency, entries, x[batch])
        size = min(POOL, n)
        pool = np.argpartition(-cosine, size - 1, axis=1)[:, :size]
        near = np.take_along_axis(cosine, pool, axis=1)
        pool = np.where(near > -1.5, pool, -1)
        # Rows of one batch are not in the graph yet, so they meet here.
        among = x[batch] @ x[batch].T
        np.fill_diagonal(among, -2.0)
        mates = np.argpartition(-among, min(MATES, len(batch)) - 1, axis=1)[:, :MATES]
        pool = np.concatenate([pool, np.where(len(batch) > 1, batch[mates], -1)], axis=1)
        near = np.concatenate([near, np.take_along_axis(among, mates, axis=1)], axis=1)
        adjacency[batch] = prune(x, batch, pool, near)
        # Reverse edges: a point's own list and its nearest new neighbours, pruned together.
        source = np.repeat(batch, DEGREE)
        target = adjacency[batch].ravel()
        some = target >= 0
        source, target = source[some], target[some]
        value = np.einsum("ij,ij->i", x[source], x[target])
        order = np.lexsort((-value, target))
        source, target = source[order], target[order]
        first = np.r_[True, target[1:] != target[:-1]]
        turn = np.arange(len(target)) - np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))
        points = target[first]
        new = np.full((len(points), POOL - DEGREE), -1, np.int64)
        fits = turn < POOL - DEGREE
        new[np.searchsorted(points, target[fits]), turn[fits]] = source[fits]
        pool = np.concatenate([adjacency[points], new], axis=1)
        full = (pool >= 0).sum(axis=1) > DEGREE
        roomy = -np.sort(-pool[~full], axis=1)[:, :DEGREE]
        adjacency[points[~full]] = roomy
        for cut in range(0, int(full.sum()), QUERIES):
            p, c = points[full][cut : cut + QUERIES], pool[full][cut : cut + QUERIES]
            near = np.einsum("bd,bcd->bc", x[p], x[np.maximum(c, 0)])
            adjacency[p] = prune(x, p, c, near)
    return adjacency


def fit_centres(x: np.ndarray, count: int, rounds: int = 6, seed: int = 10) -> np.ndarray:
    """Unit centres of spherical k-means."""
    count = max(1, min(count, len(x)))
    centres = x[np.sort(np.random.default_rng(seed).choice(len(x), count, replace=False))]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.where(length > 1e-12, length, 1), centres)
    return centres


def classes_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``node, low, many, vector`` of each different usable vector: a number of its own, its
    smallest id, its number of rows."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(_usable("vector"))
    found = rows.where("vec_id is not null").groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("many"))
    return stage(found.select(F.monotonically_increasing_id().alias("node"), "low", "many", "vector"), "vectors")


def _usable(name: str):
    finite = F.forall(name, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(name).isNotNull() & finite & F.exists(name, lambda v: v != 0)


def reached(x: np.ndarray, centres: np.ndarray, limit: float) -> np.ndarray:
    """Which cells (columns) each row of ``x`` goes to."""
    return placed(x, centres, limit)[0]


def placed(x: np.ndarray, centres: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Which cells (columns) each row of ``x`` goes to, and which of them are its ``OVERLAP`` nearest.

    Two vectors with a cosine of ``limit`` share the cell c of the point half-way, which is no
    nearer to the nearest centre of either.  So c is at most tan(half the angle) times the centres'
    distance across the direction of the step behind the nearest; of that the step takes a share
    that is 1 at most, and ``SIGMAS`` / sqrt(length) where it points anywhere.
    """
    like = x @ centres.T
    best = like.argmax(axis=1)
    gap = like[np.arange(len(x)), best][:, None] - like
    apart = np.maximum(2 - 2 * (centres @ centres.T), 0)[best]
    step = np.sqrt(max(0.0, 1 - limit) / max(1 + limit, 1e-12)) * min(1.0, SIGMAS / np.sqrt(x.shape[1]))
    member = gap <= step * np.sqrt(np.maximum(apart - gap**2, 0)) + 1e-12
    top = np.argsort(gap, axis=1, kind="stable")[:, :OVERLAP]
    home = np.zeros_like(member)
    home[np.arange(len(x))[:, None], top] = True
    return member | home, home


def shards_of(classes: DataFrame, limit: float = COSINE) -> DataFrame:
    """``cell, a, b, side, home, cells, node, many, vector``: the members of each shard (cell, a, b).

    ``cells`` are all of the member's cells, its ``OVERLAP`` nearest (``home``) before the others.
    Vectors of different lengths are in different cells.
    """
    total = classes.count()
    count = min(CELLS, max(1, -(-total * OVERLAP // FILL)))
    sample = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vector").toArrow()["vector"]
    by_length: dict[int, list] = {}
    for chunk in sample.chunks:
        for v in chunk:
            by_length.setdefault(len(v), []).append(v.values.to_numpy())
    centres, first = {}, 0
    for length, rows in sorted(by_length.items()):
        own = fit_centres(unit(np.stack(rows)), max(1, count * len(rows) // max(1, len(sample))))
        centres[length] = (first, own)
        first += len(own)
    shared = classes.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("array<int>")
    def cells(column: pa.Array) -> pa.Array:
        out: list = [None] * len(column)
        lengths = column.value_lengths().to_numpy()
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            base, own = shared.value.get(int(length), (-1 - int(length), np.zeros((1, int(length)))))
            for low in range(0, len(at), 1_024):
                cut = at[low : low + 1_024]
                member, home = placed(unit(_rows(column.take(pa.array(cut)))), own, limit)
                for i, row, near in zip(cut.tolist(), member, home, strict=True):
                    out[i] = base + np.r_[np.flatnonzero(near), np.flatnonzero(row & ~near)]
        return pa.array(out, pa.list_(pa.int32()))

    dealt = stage(classes.select("node", "many", "vector", cells("vector").alias("cells")), "cells")
    member = dealt.select("node", F.explode("cells").alias("cell"))
    sizes = member.groupBy("cell").count()
    parts = F.ceil(F.col("count") / SHARD).cast("int")
    sizes = sizes.select("cell", parts.alias("parts"))
    each = dealt.select("node", "many", "vector", "cells", F.posexplode("cells").alias("at", "cell"))
    # One row per cell: CELLS at most, and one for each length of vector that the sample missed.
    each = each.join(sizes, "cell").withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    each = each.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select(
        "cell", F.least("side", "with").alias("a"), F.greatest("side", "with").alias("b"), "side",
        (F.col("at") < OVERLAP).alias("home"), "cells", "node", "many", "vector",
    )


PLACE = ["cell", "a", "b"]


def _build_shard(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    x = unit(_rows(table["vector"].combine_chunks()))
    node = table["node"].to_numpy()
    found = build(x)
    lists = [node[r[r >= 0]] for r in found]
    return pa.table({"node": pa.array(node), "near": pa.array(lists, pa.list_(pa.int64()))})


def _local(node: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """United lists as positions in this shard; neighbours in other shards only are left out."""
    counts = lists.value_lengths().fill_null(0).to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(node)), counts)
    at = np.minimum(np.searchsorted(node, flat), len(node) - 1)
    here = node[at] == flat
    row, at = row[here], at[here]
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.empty(0, bool)
    turn = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else row
    out = np.full((len(node), int(turn.max()) + 1 if len(row) else 1), -1, np.int64)
    out[row, turn] = at
    return out


def _search_shard(table: pa.Table, limit: float) -> pa.Table:
    table = table.sort_by("node")
    node, many = table["node"].to_numpy(), table["many"].to_numpy()
    side = table["side"].to_numpy()
    cell, crossing = table["cell"][0].as_py(), table["a"][0] != table["b"][0]
    x = unit(_rows(table["vector"].combine_chunks()))
    adjacency = _local(node, table["near"].combine_chunks())
    entries, n = medoids(x), len(x)
    hit = np.zeros((n, n), bool)
    for cut in range(0, n, QUERIES):
        own = np.arange(cut, min(cut + QUERIES, n))
        hit[own] = search(x, adjacency, entries, x[own], WIDTH, limit, own) >= limit
    hit |= hit.T
    np.fill_diagonal(hit, False)
    if crossing:
        hit &= side[:, None] != side[None, :]
    counted = hit.copy()
    lists = table["cells"].combine_chunks()
    row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
    before = lists.flatten().to_numpy()
    row, before = row[before < cell], before[before < cell]
    if len(before):  # pairs that a smaller cell has too
        kinds, column = np.unique(before, return_inverse=True)
        inside = np.zeros((n, len(kinds)), np.float32)
        inside[row, column] = 1
        for cut in range(0, n, 256):
            counted[cut : cut + 256] &= inside[cut : cut + 256] @ inside.T < 0.5
    links = counted.astype(np.float64) @ many.astype(np.float64)
    label = np.arange(n)
    while True:
        low = label.copy()
        for cut in range(0, n, 256):
            near = np.where(hit[cut : cut + 256], label[None, :], n).min(axis=1)
            low[cut : cut + 256] = np.minimum(low[cut : cut + 256], near)
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    return pa.table(
        {"node": pa.array(node), "links": pa.array(links.astype(np.int64)), "low": pa.array(node[label])}
    )


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = COSINE
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` per row of ``vectors``.

    ``n_links`` counts the other rows found with a cosine of ``limit`` at least, copies
    included; ``component_id`` is the smallest id reachable by links; ``kept``: the row has
    that id.  Vectors that are null, empty or zero, or hold null or non-finite components, link
    with nothing, nor do vectors of different lengths, nor rows with a null id, whose component
    is null.  Repeated rows are links of each other.  No rows give no rows; other columns
    are ignored.
    """
    classes = classes_of(vectors, id_col, vector_col)
    found = _found(classes, limit)
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    usable = _usable("vector") & F.col("vec_id").isNotNull()
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    named = classes.join(found, "node").select("vector", "n_links", "component_id")
    # A vector of many rows is one row here: the join is split where it is hot.
    out = rows.join(named, "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _found(classes: DataFrame, limit: float) -> DataFrame:
    """``node, n_links, component_id`` per class."""
    shards = stage(shards_of(classes, limit), "shards")
    built = shards.where("home").groupBy(*PLACE).applyInArrow(_build_shard, "node long, near array<long>")
    # As many lists per class as it has graphs: OVERLAP, times the chunks of a hot cell.
    united = built.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    united = stage(united, "graph")

    def searched(table: pa.Table) -> pa.Table:
        return _search_shard(table, limit)

    hits = shards.join(united, "node").groupBy(*PLACE).applyInArrow(searched, "node long, links long, low long")
    hits = stage(hits, "hits")
    counts = hits.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(hits.select(F.col("node").alias("a"), F.col("low").alias("b")))
    joined = classes.select("node", "low", "many").join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    lows = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    return joined.join(lows, "component").join(counts, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id"
    )


def audit(
    vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    limit: float = COSINE, queries: int = 1_024,
) -> DataFrame:
    """One row ``queries, links, found, recall``: links of at most ``queries`` rows (smallest
    hashes of the id) by brute force against all rows, and those counted in ``result``."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(_usable("vector") & F.col("vec_id").isNotNull())
    asked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).toPandas()
    groups = {n: g for n, g in asked.groupby(asked["vector"].map(len))}
    known = {n: (g["vec_id"].to_numpy(), unit(np.stack(g["vector"]))) for n, g in groups.items()}

    def count(batches):
        for batch in batches:
            for n, own in batch.groupby(batch["vector"].map(len)):
                if n in known:
                    ids, x = known[n]
                    near = (x @ unit(np.stack(own["vector"])).T >= limit).sum(axis=1)
                    yield pd.DataFrame({"vec_id": ids, "links": near})

    brute = rows.mapInPandas(count, "vec_id long, links long").groupBy("vec_id").agg((F.sum("links") - 1).alias("links"))
    both = brute.join(result.select(F.col(id_col).alias("vec_id"), "n_links"), "vec_id")
    return both.agg(
        F.count("*").alias("queries"), F.sum("links").alias("links"), F.sum("n_links").alias("found"),
        F.coalesce(F.sum("n_links") / F.nullif(F.sum("links"), F.lit(0)), F.lit(1.0)).alias("recall"),
    )
