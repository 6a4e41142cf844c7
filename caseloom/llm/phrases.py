"""Collocations by Rabin-Karp fingerprints.

1. Texts are lower-cased, stops become line ends, and numpy prefix polynomials (modulo 2^64, two
   bases) over the bytes give a hash of every word; prefix polynomials over the word hashes give
   one of every n-gram.  A fingerprint is the mixed hash of language, length and words (64 bits),
   told apart further by 32 bits of the second base.
2. Level by level (one word, two words, ...) each task adds up its n-grams by fingerprint, with a
   pointer to one occurrence: hash of the text, byte of the first word.  The sums are shuffled in
   blocks of fingerprints.  An n-gram can be frequent only if both its parts of n-1 words are, so
   n-grams whose parts are not in a bitmap of frequent fingerprints are not shuffled.  The bitmap
   has a fixed largest size; where it is too small, more is shuffled and nothing else changes.
3. Only frequent phrases are read back from the text that their pointer names.  Each is hashed
   again there, and fingerprint and second hash must be the same: phrases that share a fingerprint
   are different rows with texts of their own.
4. Counts of the parts are joined by fingerprint, and phrases are scored and ranked.

Fingerprints are spread evenly and each task sends one once, so no word, however common, makes a
large group.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import stage, text_or_empty
from caseloom.llm.rolling import cut, mix, prefix

LONGEST = 3  # words of a phrase
LEAST = 10  # occurrences
COVERED = 50  # per cent of a phrase's occurrences that lie in one longer phrase
TOP = 2000  # phrases of a language
SCALE = 1_000_000
NO_LANGUAGE = "und"
WINDOW = 1 << 18  # bytes that one numpy step takes
COMPACT = 1 << 19  # fingerprints that a task holds before it adds them up
SEND = 3 << 17  # and those that it sends then
READ = 128  # texts whose phrases are read together
PIECE = 1 << 16  # of which so many travel together
BLOCK_BYTES = 2 << 20  # text bytes for each block of fingerprints
MAP_BITS = 28  # a bitmap has 2^28 bits (32 MB) at most
MAP_ROW = 16  # and is put together from rows of 2^16 bits

_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n"
)
_SEPARATOR = re.compile(rb"[ \n]")
_BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_GRAMS = "n int, fp long, mark int, a long, doc long, at int"


def seed(lang: str) -> int:
    """Number of a language."""
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """Words of some normalised bytes: places, pieces, and hashes of all their n-grams."""

    def __init__(self, data: bytes):
        held = np.frombuffer(data, np.uint8)
        stop = held == 10
        gap = np.ones(len(held) + 2, bool)
        np.logical_or(stop, held == 32, out=gap[1:-1])
        self.start = np.flatnonzero(gap[:-1] & ~gap[1:])
        self.end = np.flatnonzero(~gap[:-1] & gap[1:])
        self.piece = np.cumsum(stop, dtype=np.int32)[self.start] if len(self.start) else np.empty(0, np.int32)
        values = held.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for byte_base, word_base in zip(_BYTE_BASES, _WORD_BASES, strict=True):
            one = mix(cut(prefix(values, byte_base), self.start, self.end, byte_base))
            self.sums.append(prefix(one, word_base))

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, first: np.ndarray, n: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and mark of the ``n`` words from ``first`` on, in the languages ``seeds``."""
        own = mix(seeds + np.uint64(n))
        a, b = (mix(cut(p, first, first + n, base) ^ own) for p, base in zip(self.sums, _WORD_BASES, strict=True))
        return a, (b >> np.uint64(32)).astype(np.uint32).view(np.int32)


def added(fp: np.ndarray, mark: np.ndarray, count: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple:
    """Equal (fp, mark) as one: counts added, the pointer with the smallest text hash; sorted by fp."""
    order = np.argsort(fp, kind="stable")
    same = fp[order][1:] == fp[order][:-1]
    if (mark[order][1:] != mark[order][:-1])[same].any():  # different phrases with one fingerprint
        order = np.lexsort((mark, fp))
    fp, mark, count, doc, at = (x[order] for x in (fp, mark, count, doc, at))
    new = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (mark[1:] != mark[:-1])][: len(fp)])
    if not len(new):
        return fp, mark, count, doc, at
    lowest = np.minimum.reduceat(doc, new)
    at_lowest = np.flatnonzero(doc == np.repeat(lowest, np.diff(np.r_[new, len(fp)])))
    one = at_lowest[np.searchsorted(at_lowest, new)]
    return fp[new], mark[new], np.add.reduceat(count, new), doc[one], at[one]


class Chunk:
    """Normalised bytes with the texts that they come from.  The words before ``fresh`` were counted
    with an earlier chunk and are only the beginnings of n-grams."""

    def __init__(self, data: bytes, begin: list[int], row: list[int], shift: int = 0, fresh: int = 0):
        self.words, self.fresh = Words(data), fresh
        place = np.searchsorted(np.array(begin), self.words.start, side="right") - 1
        self.row = np.array(row, np.int64)[place]
        self.at = self.words.start - np.array(begin)[place] + shift


def chunks(texts: Iterator[bytes], longest: int) -> Iterator[Chunk]:
    """All texts in steps of about ``WINDOW`` bytes, long ones cut between words."""
    parts, begin, row, size = [], [], [], 0
    for number, text in enumerate(texts):
        text = text.translate(_TABLE)
        if len(text) > WINDOW:
            low = fresh = end = 0
            while end < len(text):
                found = _SEPARATOR.search(text, max(end, low) + WINDOW)
                end = found.start() if found else len(text)
                chunk = Chunk(text[low:end], [0], [number], low, fresh)
                yield chunk
                fresh = min(longest - 1, len(chunk.words))
                low = low + int(chunk.words.start[-fresh]) if fresh else end
            continue
        parts.append(text)
        begin.append(size)
        row.append(number)
        size += len(text) + 1
        if size > WINDOW:
            yield Chunk(b"\n".join(parts), begin, row)
            parts, begin, row, size = [], [], [], 0
    if parts:
        yield Chunk(b"\n".join(parts), begin, row)


def _known(bitmap: np.ndarray, fp: np.ndarray) -> np.ndarray:
    bits = int(len(bitmap) * 8).bit_length() - 1
    place = fp >> np.uint64(64 - bits)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(chunk: Chunk, n: int, seeds: np.ndarray, docs: np.ndarray, bitmap: np.ndarray | None) -> tuple:
    """Fingerprints of a chunk's n-grams that can be frequent, each once."""
    words, row = chunk.words, chunk.row
    first = np.arange(max(0, chunk.fresh - n + 1), max(0, len(words) - n + 1))
    first = first[words.piece[first] == words.piece[first + n - 1]]
    if n > 1 and bitmap is not None:
        parts = _known(bitmap, words.grams(np.arange(len(words) - n + 2), n - 1, seeds[row[: len(words) - n + 2]])[0]) if len(first) else np.empty(0, bool)
        first = first[parts[first] & parts[first + 1]]
    fp, mark = words.grams(first, n, seeds[row[first]])
    out = [fp, mark, np.ones(len(first), np.int64), docs[row[first]], chunk.at[first]]
    if n == 1:  # the empty phrase of a language occurs as often as the language has words
        rows, times = np.unique(row[chunk.fresh :], return_counts=True)
        zero, zero_mark = words.grams(np.zeros(len(rows), np.int64), 0, seeds[rows])
        out = [np.concatenate(x) for x in zip(out, (zero, zero_mark, times, docs[rows], np.full(len(rows), -1)), strict=True)]
    return added(*out)


def _sent(held: tuple, blocks: int) -> Iterator[pa.RecordBatch]:
    """One row of arrays per block of fingerprints, or several where a block has very many."""
    for low in range(0, len(held[0]), PIECE):
        fp, mark, count, doc, at = (x[low : low + PIECE] for x in held)
        block = ((fp >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        offsets = pa.array(np.r_[start, len(block)].astype(np.int32))
        columns = (fp.view(np.int64), mark, count, doc, at.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[start]), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns)],
            names=["block", "fp", "mark", "a", "doc", "at"],
        )


def _level(texts: DataFrame, n: int, longest: int, least: int, blocks: int, bitmap: Broadcast | None) -> DataFrame:
    """``n, fp, mark, a, doc, at`` of the frequent phrases of ``n`` words; with n = 1 also the empty
    phrase of each language (n = 0), however few its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bitmap is None else bitmap.value
        held, size = [], 0

        def together() -> tuple:
            return added(*map(np.concatenate, zip(*held, strict=True)))

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            seeds = np.array([seed(s.as_py()) for s in langs.dictionary], np.uint64)[langs.indices.to_numpy()]
            docs = batch.column("doc").to_numpy()
            for chunk in chunks((t.as_buffer().to_pybytes() for t in batch.column("t")), longest):
                held.append(_counted(chunk, n, seeds, docs, known))
                size += len(held[-1][0])
                if size > COMPACT:
                    held = [together()]
                    size = len(held[0][0])
                    if size > SEND:
                        yield from _sent(held[0], blocks)
                        held, size = [], 0
        if held:
            yield from _sent(together(), blocks)

    def add(group: pa.Table) -> pa.Table:
        flat = [group[c].combine_chunks().flatten().to_numpy() for c in ("fp", "mark", "a", "doc", "at")]
        fp, mark, a, doc, at = added(flat[0].view(np.uint64), *flat[1:])
        empty = at < 0
        keep = (a >= least) | empty
        size = np.where(empty, 0, n).astype(np.int32)
        columns = (size, fp.view(np.int64), mark, a, doc, at)
        return pa.table({name: pa.array(c[keep]) for name, c in zip(("n", "fp", "mark", "a", "doc", "at"), columns, strict=True)})

    sums = texts.select("lang", "doc", "t").mapInArrow(
        count, "block long, fp array<long>, mark array<int>, a array<long>, doc array<long>, at array<int>"
    )
    return sums.groupBy("block").applyInArrow(add, _GRAMS)


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Bitmap over the leading bits of all fingerprints; 32 MB at most reach the driver."""
    bits = min(MAP_BITS, max(MAP_ROW, (16 * grams.count()).bit_length()))

    def put(group: pa.Table) -> pa.Table:
        place = np.unique(group["place"].to_numpy())
        own = np.zeros(1 << MAP_ROW, np.uint8)
        own[place & ((1 << MAP_ROW) - 1)] = 1
        return pa.table({"at": [int(place[0] >> MAP_ROW)], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    place = F.shiftrightunsigned("fp", 64 - bits)
    places = grams.select(place.alias("place")).distinct().withColumn("at", F.shiftright("place", MAP_ROW))
    rows = places.groupBy("at").applyInArrow(put, "at long, bits binary").toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (MAP_ROW - 3)
    for at, own in zip(rows["at"].to_pylist(), rows["bits"], strict=True):
        out[at * width : (at + 1) * width] = np.frombuffer(own.as_buffer(), np.uint8)
    return out


def _pointed(texts: DataFrame, pointers: DataFrame) -> DataFrame:
    """``lang, t, found`` of the texts that pointers name, with the pointers of each.  Copies of a text
    are sent once by a task, and texts that the bitmap of pointers rules out not at all."""
    known = texts.sparkSession.sparkContext.broadcast(_bitmap(pointers.select(F.col("spread").alias("fp"))))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            keep = np.flatnonzero(_known(known.value, batch.column("spread").to_numpy().view(np.uint64)))
            lang, doc = (batch.column(c).take(pa.array(keep)).to_pylist() for c in ("lang", "doc"))
            fresh = []
            for k, key in zip(keep.tolist(), zip(lang, doc, strict=True), strict=True):
                if key not in seen:
                    seen.add(key)
                    fresh.append(k)
            yield batch.take(pa.array(fresh, pa.int64()))

    some = texts.select("lang", "doc", "t", "spread").mapInArrow(named, "lang string, doc long, t binary, spread long")
    lists = pointers.groupBy("doc").agg(F.collect_list(F.struct("n", "fp", "mark", "a", "at")).alias("found"))
    return some.join(lists, "doc").select("lang", "t", "found")


def _totals(words: Words, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and mark of the empty phrase of each language."""
    fp, mark = words.grams(np.zeros(len(seeds), np.int64), 0, seeds)
    return fp.view(np.int64), mark


def _read(pointed: DataFrame, longest: int) -> DataFrame:
    """Frequent phrases as texts, each as often as texts of its pointer's hash hold it: ``lang, n, fp,
    mark, a, phrase``, ``cuts``, ``inner`` (fingerprint and mark of each shorter phrase of two or more
    words in it) and ``total`` (those of the language's empty phrase).  A pointer whose words hash to something else gives no row."""
    part = "struct<fp:bigint,mark:int>"
    cuts = f"array<struct<k:int,first:{part},rest:{part}>>"
    schema = f"lang string, n int, fp long, mark int, a long, phrase string, cuts {cuts}, inner array<{part}>, total {part}"
    kind = pa.struct([("fp", pa.int64()), ("mark", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, READ) for b in batches for low in range(0, b.num_rows, READ)):
            langs, phrases, rows = [], [], []
            for lang, text, found in zip(*(batch.column(c) for c in ("lang", "t", "found")), strict=True):
                data = text.as_buffer().to_pybytes().translate(_TABLE)
                for p in found.as_py():
                    at, own = p["at"], []
                    for _ in range(p["n"]):
                        end = _SEPARATOR.search(data, at)
                        stop = end.start() if end else len(data)
                        own.append(data[at:stop])
                        at = stop
                        while data[at : at + 1] == b" ":
                            at += 1
                    langs.append(lang.as_py())
                    phrases.append(b" ".join(own))
                    rows.append(p)
            if not rows:
                continue
            words = Words(b"\n".join(phrases))
            n = np.array([p["n"] for p in rows])
            first = np.r_[0, np.cumsum(n)[:-1]]
            seeds = np.array([seed(s) for s in langs], np.uint64)
            if len(words) != n.sum():  # a pointer to another text of the same hash
                n_real = np.array([len(p.split(b" ")) if p and b"" not in p.split(b" ") else 0 for p in phrases])
                whole = np.flatnonzero(n_real == n)
                words = Words(b"\n".join(phrases[k] for k in whole))
                rows, phrases, langs = ([x[k] for k in whole] for x in (rows, phrases, langs))
                n, seeds = n[whole], seeds[whole]
                first = np.r_[0, np.cumsum(n)[:-1]] if len(n) else np.empty(0, np.int64)
            hashes = {}  # (start in the phrase, length): of all phrases that are long enough
            for length in range(1, longest + 1):
                for low in range(longest - length + 1):
                    has = np.flatnonzero(n >= low + length)
                    fp, mark = words.grams(first[has] + low, length, seeds[has])
                    hashes[low, length] = dict(zip(has.tolist(), zip(fp.view(np.int64).tolist(), mark.tolist(), strict=True), strict=True))
            total = dict(enumerate(zip(*(x.tolist() for x in _totals(words, seeds)), strict=True)))
            out = []
            for k, p in enumerate(rows):
                size = p["n"]
                if hashes[0, size][k] != (p["fp"], p["mark"]):
                    continue
                pairs = [(c, hashes[0, c][k], hashes[c, size - c][k]) for c in range(1, size)]
                inner = [hashes[low, m][k] for m in range(2, size) for low in range(size - m + 1)]
                out.append((langs[k], size, p["fp"], p["mark"], p["a"], phrases[k].decode(), pairs, inner, total[k]))
            lang, size, fp, mark, a, phrase, pairs, inner, zero = zip(*out, strict=True) if out else ((),) * 9

            def dicts(many):
                return [{"fp": f, "mark": m} for f, m in many]

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(fp, pa.int64()),
                    pa.array(mark, pa.int32()), pa.array(a, pa.int64()), pa.array(phrase, pa.string()),
                    pa.array(
                        [[{"k": c, "first": {"fp": x[0], "mark": x[1]}, "rest": {"fp": y[0], "mark": y[1]}} for c, x, y in one] for one in pairs],
                        pa.list_(pa.struct([("k", pa.int32()), ("first", kind), ("rest", kind)])),
                    ),
                    pa.array([dicts(one) for one in inner], pa.list_(kind)), pa.array(dicts(zero), kind),
                ],
                names=["lang", "n", "fp", "mark", "a", "phrase", "cuts", "inner", "total"],
            )

    return pointed.mapInArrow(read, schema).dropDuplicates(["fp", "mark"])


def frequent(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST
) -> tuple[DataFrame, DataFrame]:
    """All phrases of two to ``longest`` words that occur ``least`` times in a language, and all counts.

    The first frame has ``lang, n, fp, mark, a, phrase, cuts, inner, total``; the second ``n, fp, mark, a`` of
    all frequent phrases, single words and languages (n = 0).  See :func:`collocations` for odd rows.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.xxhash64(text_or_empty(text_col)).alias("doc"),
        text_or_empty(text_col).cast("binary").alias("t"),
    ).where(F.length("t") > 0)
    texts = texts.withColumn("spread", F.xxhash64("doc"))
    size = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    levels, bitmap = [], None
    for n in range(1, longest + 1):
        grams = stage(_level(texts, n, longest, least, blocks, bitmap), f"grams-{n}")
        levels.append(grams)
        if n < longest:
            bitmap = spark.sparkContext.broadcast(_bitmap(grams.where(F.col("n") == n)))
    counts = levels[0]
    for grams in levels[1:]:
        counts = counts.unionByName(grams)
    pointers = counts.where("n > 1").withColumn("spread", F.xxhash64("doc"))
    phrases = stage(_read(_pointed(texts, pointers), longest), "phrases")
    return phrases, counts.select("n", "fp", "mark", "a")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases`` with ``l, r, score`` of the lowest-scoring cut, the first of equal ones."""
    count = counts.select("fp", "mark", F.col("a").alias("f"))
    cuts = phrases.select("fp", "mark", "a", F.explode("cuts").alias("cut"))
    for side, name in (("first", "l"), ("rest", "r")):
        own = count.select(F.col("fp").alias("part"), F.col("mark").alias("part_mark"), F.col("f").alias(name))
        cuts = cuts.join(own, (F.col(f"cut.{side}.fp") == F.col("part")) & (F.col(f"cut.{side}.mark") == F.col("part_mark")))
        cuts = cuts.drop("part", "part_mark")
    # Decimals of 38 digits hold the products, and div cuts them to whole numbers.
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.groupBy("fp", "mark").agg(F.min(F.struct(score.alias("score"), "cut.k", "l", "r")).alias("best"))
    return phrases.join(best, ["fp", "mark"]).select("*", "best.l", "best.r", "best.score").drop("best")


def uncovered(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """``phrases`` without those of which ``covered`` per cent or more lie in one longer frequent phrase."""
    longer = (
        phrases.select(F.explode("inner").alias("part"), F.col("a").alias("f"))
        .groupBy("part.fp", "part.mark").agg(F.max("f").alias("f"))
    )
    over = phrases.select("fp", "mark", "a").join(longer, ["fp", "mark"]).where(100 * F.col("f") >= covered * F.col("a"))
    return phrases.join(over.select("fp", "mark"), ["fp", "mark"], "left_anti")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
    covered: int = COVERED, top: int = TOP,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of each language.

    A null text has no words, nor has one of blanks and stops; a null language is ``und``.  Very long
    texts are counted whole, repeated rows each time.  Ties in score and count go by the phrase's
    bytes.  No rows, or no frequent phrase, give no rows; other columns are ignored.
    """
    phrases, counts = frequent(docs, text_col, lang_col, longest, least)
    kept = uncovered(scored(phrases, counts), covered)

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.select("lang", "total", F.row_number().over(order).alias("rank"), "phrase", "a", "l", "r", "score").where(F.col("rank") <= top)
    total = counts.where("n = 0").select(F.col("fp").alias("zero"), F.col("mark").alias("zero_mark"), F.col("a").alias("n"))
    own = (F.col("total.fp") == F.col("zero")) & (F.col("total.mark") == F.col("zero_mark"))
    return best.join(total, own).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
