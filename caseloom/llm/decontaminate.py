"""Benchmark decontamination by latent semantic retrieval.

1. The matrix A has a row for each passage of the corpus (``WINDOW`` words, one after the
   other) and a column for each benchmark word, with TF-IDF weights.  A randomised SVD finds
   its leading term directions: tasks add up Y'Y and Y'T (T: counts, Y = T O, O: fixed random
   numbers) over their passages, Spark adds these up by term, and a small factorisation of the
   sums gives the directions.  As Y'T does not contain the weights, the same pass counts the
   documents of each term, so the corpus is read once.
2. Passages that overlap by half are projected into the latent space and compared by cosine
   with all passages of the benchmark items.  Before that, a passage and an item are left out
   only if the passage's neighbourhood does not have the words that step 3 asks for, so this
   screen loses nothing.
3. A document and an item that have a passage pair are verified on the words: the longest
   common subsequence with the neighbourhood of the passages must hold ``SHARE`` of the item,
   and its answer (a given one, else its last words) must be in it to ``ANSWER``.

Items shorter than a passage are looked up as whole word sequences.  Documents are never
shuffled; the benchmark goes to all tasks, and its size is checked.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import text_or_empty

WINDOW = 12
STEP = 6  # of document passages
ITEM_STEP = 3  # of item passages
RANK = 64
TERMS = 1 << 16  # columns; words beyond share columns
COSINE = 0.7
SHARE = 0.7
ANSWER = 0.5
ANSWER_WORDS = 8
BENCHMARK_BYTES = 64 << 20
STARTS = 8_192  # passages, and
ITEMS = 512  # items that one step of the screen takes
BLOCK = 8  # passages that it looks at together first
_PLAIN = bytes(
    (b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32) for b in range(256)
)


def split(text: str | bytes) -> list[bytes]:
    """Words: runs of ASCII letters (lower-cased), digits and other letters, as UTF-8."""
    data = text.encode() if isinstance(text, str) else text
    return data.translate(_PLAIN).split()


@dataclass
class Item:
    """A benchmark item as words, with the words of its answer."""

    item_id: int
    words: list[bytes]
    answer: list[bytes]


@dataclass
class Benchmark:
    """What every task needs to know of the benchmark."""

    items: list[Item]
    column: dict[bytes, int] = field(default_factory=dict)
    columns: int = 1

    @classmethod
    def of(cls, rows: list[tuple]) -> Benchmark:
        """From ``(item_id, text, answer)`` rows.  Null ids and items without words are left
        out, repeated rows count once."""
        items, seen = [], set()
        for item_id, text, answer in rows:
            words = split(text or "")
            if item_id is None or not words or (item_id, text, answer) in seen:
                continue
            seen.add((item_id, text, answer))
            own = split(answer or "") or words[-min(ANSWER_WORDS, -(-len(words) // 2)) :]
            items.append(Item(item_id, words, own))
        vocabulary = sorted({w for item in items for w in item.words})
        numbers = [i if i < TERMS else zlib.crc32(w) % TERMS for i, w in enumerate(vocabulary)]
        return cls(items, dict(zip(vocabulary, numbers, strict=True)), max(1, min(TERMS, len(vocabulary))))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Column of each word, -1 for words that the benchmark does not have."""
        get = self.column.get
        return np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))


def read_benchmark(benchmark: DataFrame, id_col="item_id", text_col="text", answer_col=None) -> Benchmark:
    """Collect the items after a check of their size."""
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), answer.alias("a"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; pass it in parts of {BENCHMARK_BYTES}")
    return Benchmark.of(sorted(map(tuple, rows.where("t is not null").collect()), key=str))


def _directions(columns: int, rank: int) -> np.ndarray:
    # Random signs do for the range of A as normal numbers do, in a quarter of the memory.
    return np.random.default_rng(8).choice(np.array([-1, 1], np.int8), (columns, rank))


def sketch(docs: DataFrame, known: Benchmark, text_col: str = "text", rank: int = RANK) -> DataFrame:
    """Sums ``term, texts, s0, s1, ...``: a row of (Y'T)' and the number of texts for each term;
    -1 - i: row i of Y'Y; ``columns``: the number of all texts."""
    width, names = known.columns, [f"s{i}" for i in range(rank)]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        omega = _directions(width, rank)
        yty, yt = np.zeros((rank, rank)), np.zeros((width, rank))
        texts, count = np.zeros(width, np.int64), 0

        def add(term: np.ndarray, at: np.ndarray) -> None:
            # term and passage of each known word, ordered by passage
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            y = np.add.reduceat(omega[term], first, axis=0, dtype=np.int8)  # WINDOW words at most
            dense = y.astype(np.float32)
            yty[:] += dense.T @ dense
            place = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(at)]))
            order = np.argsort(term, kind="stable")
            sorted_term = term[order]
            starts = np.flatnonzero(np.r_[True, sorted_term[1:] != sorted_term[:-1]])
            yt[sorted_term[starts]] += np.add.reduceat(y[place[order]], starts, axis=0, dtype=np.int32)

        for batch in batches:
            terms, ats, held, base = [], [], 0, 0
            for text in batch.column(0):
                number = own.numbers(split(text.as_py()))
                count += 1
                known_at = np.flatnonzero(number >= 0)
                terms.append(number[known_at])
                texts[np.unique(terms[-1])] += 1
                ats.append(base + known_at // WINDOW)
                base += len(number) // WINDOW + 1
                held += len(known_at)
                if held > 50_000:
                    add(np.concatenate(terms), np.concatenate(ats))
                    terms, ats, held = [], [], 0
            if held:
                add(np.concatenate(terms), np.concatenate(ats))
        some = np.flatnonzero(texts)
        sums = np.concatenate([yt[some], yty, np.zeros((1, rank))])
        keys = np.concatenate([some, -1 - np.arange(rank), [width]])
        seen = np.concatenate([texts[some], np.zeros(rank, np.int64), [count]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(seen, pa.int64()), *[pa.array(c) for c in sums.T]],
            names=["term", "texts", *names],
        )

    schema = "term long, texts long, " + ", ".join(f"{n} double" for n in names)
    each = docs.select(text_or_empty(text_col).cast("binary").alias("t")).mapInArrow(work, schema)
    return each.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("texts", *names)])


def term_vectors(sums: DataFrame, known: Benchmark, rank: int = RANK) -> np.ndarray:
    """IDF times the leading right singular vectors, one row per column of A.

    The collected sums are as many rows as the benchmark has words (``TERMS`` at most)."""
    rows = sums.toArrow().to_pydict()
    term = np.array(rows["term"], np.int64)
    values = np.stack([np.array(rows[f"s{i}"]) for i in range(rank)], axis=1)
    texts = np.array(rows["texts"], np.int64)
    width = known.columns
    total = int(texts[term == width].sum())
    idf = np.full(width, np.log(1.0 + total) + 1.0)
    yt, yty = np.zeros((width, rank)), np.zeros((rank, rank))
    inner = (term >= 0) & (term < width)
    yt[term[inner]] = values[inner]
    idf[term[inner]] = np.log((1.0 + total) / (1.0 + texts[inner])) + 1.0
    yty[-1 - term[term < 0]] = values[term < 0]
    value, vector = np.linalg.eigh(yty)
    good = value > max(1e-9, 1e-10 * value[-1])
    if not good.any():
        return np.zeros((width, 1), np.float32)
    # Rows of Q'A with Q = Y E L^-1/2, an orthonormal basis of the range of Y.
    b = (vector[:, good] / np.sqrt(value[good])).T @ yt.T * idf
    _, _, right = np.linalg.svd(b, full_matrices=False)
    return (idf[:, None] * right.T).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[bytes, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for word in b:
        hit = state & where.get(word, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


class Finder:
    """Finds the items of a benchmark in texts."""

    def __init__(self, known: Benchmark, vectors: np.ndarray):
        self.known = known
        self.vectors = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])  # -1: unknown
        owner, rows, self.short = [], [], []
        for k, item in enumerate(known.items):
            n = len(item.words)
            if n < WINDOW:
                self.short.append((k, b" " + b" ".join(item.words) + b" "))
                continue
            number = known.numbers(item.words)
            starts = [*range(0, n - WINDOW, ITEM_STEP), n - WINDOW]
            rows += [self.vectors[number[s : s + WINDOW]].sum(axis=0) for s in starts]
            owner += [k] * len(starts)
        shape = (0, vectors.shape[1])
        self.passages = _unit(np.array(rows, np.float32)) if rows else np.zeros(shape, np.float32)
        self.owner = np.array(owner, np.int64)
        self.first = np.flatnonzero(np.r_[True, self.owner[1:] != self.owner[:-1]][: len(owner)])
        self.often = [Counter(item.words) for item in known.items]
        # Groups of items of similar length: their largest length, numbers among the long items, words
        # that each needs, and by column the items that have it and how often.
        length = np.array([len(known.items[k].words) for k in self.owner[self.first]], np.int64)
        order, self.groups = np.argsort(length, kind="stable"), []
        while len(order):
            cut = min(int(np.searchsorted(length[order], 1.25 * length[order[0]], side="right")), ITEMS)
            part, order = order[:cut], order[cut:]
            columns = [known.numbers(known.items[k].words) for k in self.owner[self.first[part]]]
            item = np.repeat(np.arange(len(part)), length[part])
            pair, times = np.unique(np.concatenate(columns) * np.int64(len(part)) + item, return_counts=True)
            ends = np.searchsorted(pair // len(part), np.arange(known.columns + 1))
            self.groups.append((int(length[part].max()), part, SHARE * length[part], ends, pair % len(part), times))

    def screened(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a passage (position in the sorted ``starts``) and a long item (its number among
        these) whose neighbourhood has enough of the item's words, as in :meth:`verified`.  Looked at
        first are the neighbourhoods of ``BLOCK`` passages together, which have all the words of each."""
        at = np.flatnonzero(words >= 0)
        term = words[at]
        order = np.argsort(term, kind="stable")
        same = term[order[1:]] == term[order[:-1]]
        before = np.full(len(at), -(1 << 40))
        before[order[1:][same]] = at[order[:-1][same]]  # the same word's last place
        for low in range(0, len(starts), STARTS):
            own = starts[low : low + STARTS]
            head = np.arange(0, len(own), BLOCK)
            tail = np.minimum(head + BLOCK, len(own)) - 1
            for group in self.groups:
                n, part = group[:2]
                near = slice(*np.searchsorted(at, [own[0] - n, own[-1] + WINDOW + n]))
                there = at[near], term[near], before[near]
                block, _ = self._enough(*there, own[head] - n, own[tail] + WINDOW + n, group)
                if not len(block):
                    continue
                block = np.unique(block)
                fine = (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                fine = fine[fine < len(own)]
                passage, item = self._enough(*there, own[fine] - n, own[fine] + WINDOW + n, group)
                yield low + fine[passage], part[item]

    @staticmethod
    def _enough(at, term, before, left, right, group) -> tuple[np.ndarray, np.ndarray]:
        """Stretches from ``left`` to ``right`` (both sorted) and items of a group, of whose words
        the stretch has enough: a word counts in the stretches that it is the first of its kind in."""
        _, part, need, ends, items, times = group
        first = np.maximum(np.searchsorted(right, at, side="right"), np.searchsorted(left, before, side="right"))
        last = np.searchsorted(left, at, side="right")
        many = np.where(first < last, ends[term + 1] - ends[term], 0)
        turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(ends[term], many) + turn
        cells = (len(left) + 1) * len(part)
        count = np.zeros(cells)
        for edge, sign in ((first, 1), (last, -1)):
            cell = np.repeat(edge, many) * len(part) + items[entry]
            count += np.bincount(cell, sign * times[entry], cells)
        count = np.cumsum(count.reshape(-1, len(part))[:-1], axis=0)
        return np.nonzero(count >= need)

    def candidates(self, numbers: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """``(text, first word, item)`` of passage pairs with the cosine, for many texts."""
        of, at = [], []
        for i, number in enumerate(numbers):
            last = max(len(number) - WINDOW, 0)
            starts = np.unique(np.minimum(np.arange(0, last + STEP, STEP), last))
            of.append(np.full(len(starts), i))
            at.append(starts)
        if not of or not len(self.passages):
            return
        text, start = np.concatenate(of), np.concatenate(at)
        base = np.cumsum([0, *map(len, numbers)])
        # Passages at the end of a text, or shorter than WINDOW, look up unknown words behind it.
        words = np.concatenate([*numbers, np.full(WINDOW, -1, np.int32)])
        pairs = list(self.screened(words, base[text] + start))
        if not pairs:
            return
        passage, item = (np.concatenate(p) for p in zip(*pairs, strict=True))
        order = np.argsort(passage, kind="stable")
        passage, item = passage[order], item[order]
        asked = np.unique(passage)
        for low in range(0, len(asked), 256):
            cut = asked[low : low + 256]
            place = (base[text[cut]] + start[cut])[:, None] + np.arange(WINDOW)
            number = np.where(place < base[text[cut] + 1][:, None], words[place], -1)
            vector = _unit(self.vectors[number].sum(axis=1))
            best = np.maximum.reduceat(vector @ self.passages.T, self.first, axis=1)
            own = slice(*np.searchsorted(passage, [cut[0], cut[-1] + 1]))
            near = best[np.searchsorted(cut, passage[own]), item[own]] >= COSINE
            hit, found = passage[own][near], self.owner[self.first[item[own][near]]]
            yield from zip(text[hit].tolist(), start[hit].tolist(), found.tolist(), strict=True)

    def verified(self, words: list[bytes], item: int, starts: list[int]) -> tuple[float, float, int, int] | None:
        """Shares of the item and of its answer in the neighbourhood of passages, and the
        neighbourhood; the best, or None."""
        known, often = self.known.items[item], self.often[item]
        n, best = len(known.words), None
        for start in starts:
            low, high = max(0, start - n), start + WINDOW + n
            part = words[low:high]
            # A subsequence holds no more than the item's words that are there at all.
            if sum(map(often.__getitem__, often.keys() & part)) < SHARE * n:
                continue
            share = subsequence(known.words, part) / n
            if share < SHARE or (best and share <= best[0]):
                continue
            answer = subsequence(known.answer, part) / len(known.answer)
            if answer >= ANSWER:
                best = (share, answer, low, min(high, len(words)))
                if share == 1.0:
                    break
        return best

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, float, float, int, int]]:
        """``(text, item, share, answer, first word, end)`` of all items in all texts."""
        split_texts = [split(t) for t in texts]
        pairs: dict[tuple[int, int], list[int]] = {}
        for text, start, item in self.candidates([self.known.numbers(w) for w in split_texts]):
            pairs.setdefault((text, item), []).append(start)
        for (text, item), starts in sorted(pairs.items()):
            best = self.verified(split_texts[text], item, starts)
            if best:
                yield (text, item, *best)
        for text, words in enumerate(split_texts if self.short else []):
            joined = b" " + b" ".join(words) + b" "
            for item, sought in self.short:
                at = joined.find(sought)
                if at >= 0:
                    first = joined.count(b" ", 0, at)
                    yield text, item, 1.0, 1.0, first, first + len(self.known.items[item].words)


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", answer_col: str | None = None,
) -> DataFrame:
    """``id_col, item_id, lcs_share, answer_share, first_word, end_word`` per document row and
    item found in it.

    Null and empty texts and items match nothing; a text or item of blanks and signs has no
    words and matches nothing.  Repeated document rows each match; repeated items count once.
    An empty benchmark or corpus gives no rows.  Other columns are ignored.
    """
    found, kind = _finder(docs, benchmark, text_col, item_id, item_text, answer_col), dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, item_id long, lcs_share double, answer_share double, first_word long, end_word long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*found.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = list(finder.find([t.as_py() for t in part.column(1)]))
                text, item, *rest = zip(*rows, strict=True) if rows else ([],) * 6
                ids = [finder.known.items[k].item_id for k in item]
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip([ids, *rest], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text, pa.int64())), *columns],
                    names=[id_col, "item_id", "lcs_share", "answer_share", "first_word", "end_word"],
                )

    rows = docs.select(F.col(id_col), text_or_empty(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(work, schema)


def _finder(docs, benchmark, text_col, item_id, item_text, answer_col):
    known = read_benchmark(benchmark, item_id, item_text, answer_col)
    vectors = term_vectors(sketch(docs, known, text_col), known)
    return docs.sparkSession.sparkContext.broadcast((known, vectors))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **columns: str) -> DataFrame:
    """Rows of ``docs`` in which no item is found, with all their columns, without a shuffle."""
    names = {"item_id": "item_id", "item_text": "text", "answer_col": None, **columns}
    found = _finder(docs, benchmark, text_col, **names)

    @F.arrow_udf("boolean")
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(*found.value)
        for batch in batches:
            flags = np.zeros(len(batch), bool)
            for at in range(0, len(batch), 128):
                texts = [t.as_py() for t in batch.slice(at, 128)]
                for text, *_ in finder.find(texts):
                    flags[at + text] = True
            yield pa.array(flags)

    return docs.where(~leaks(text_or_empty(text_col).cast("binary")))
