"""Token ids as equal-length sequences in Arrow files.

Documents in ascending id order are cut into parts by a range sort.  A part is two Arrow
IPC files in a shared folder:

* ``part-N.arrow``: batches of ``ids fixed_size_list<uint16 or uint32>[length]`` and
  ``mask fixed_size_list<bool>[length]`` (true: a token, false: padding at the end of the
  part).  All batches but the last have the same number of rows, so sequence k is row
  ``k % rows`` of batch ``k // rows`` and its ids are a view into the mapped file.
* ``part-N.docs.arrow``: ``doc_id``, ``start`` (ids of earlier documents of the part) and
  ``n_tokens`` (with the end id).

A file is written under another name and renamed, so a repeated or lost task leaves a whole
file or none.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm import rolling
from caseloom.llm.common import Memo, kept, stage, text_or_empty

LENGTH = 2048
BATCH = 64  # sequences in a record batch
PART_BYTES = 8 << 20  # text bytes of a part, about
PART_ROWS = 1 << 17  # and rows
REMEMBERED = 300_000
STEP_BYTES = 4 << 20  # text bytes that are coded together
BLOCK = 1 << 18  # and of these, bytes that are hashed or compared at once: a number of eight bytes for each
ASKED = 8_192  # runs that the library gets at once: it takes some hundred bytes for each of their letters
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SIGNS = np.zeros(256, bool)  # ASCII that is neither letter, digit, blank nor control
_SIGNS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_BASE = 0x9E3779B97F4A7C15


def _runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between blanks and line ends.  Signs at the end of a run whose last
    other letter is one of a-z or of Latin-1 are a run of their own."""
    held = np.frombuffer(data, np.uint8)
    gap = np.ones(len(held) + 2, bool)
    np.logical_or(held == 32, held == 10, out=gap[1:-1])
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    if not len(start):
        return start, end
    place = np.arange(len(held), dtype=np.int32 if len(held) < 1 << 31 else np.int64)
    place[_SIGNS[held]] = -1
    last = np.maximum.accumulate(place, out=place)[end - 1].astype(np.int64)
    tail = (last >= start) & (last < end - 1)
    at = last[tail]
    letter, before = held[at], held[np.maximum(at - 1, 0)]
    plain = (letter >= 97) & (letter <= 122)
    latin = (before == 0xC3) & (letter >= 0x80) & (letter <= 0xBF) & (letter != 0x97) & (letter != 0xB7)
    cuts = at[plain | latin] + 1
    return np.sort(np.r_[start, cuts]), np.sort(np.r_[end, cuts])


def _stretches(values: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after the other."""
    begin = np.cumsum(length) - length
    return values[np.repeat(offset - begin, length) + np.arange(length.sum())]


def _blocks(start: np.ndarray) -> list[slice]:
    """Runs by the block of bytes that they start in."""
    if not len(start):
        return []
    edges = np.unique(np.r_[np.searchsorted(start, np.arange(0, start[-1] + 1, BLOCK)), len(start)]).tolist()
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _different(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the different runs, and for each run its place among them."""
    held, length = np.frombuffer(data, np.uint8), end - start
    key, blocks = np.empty(len(start), np.uint64), _blocks(start)
    for own in blocks:
        low = start[own.start]
        letters = held[low : end[own.stop - 1]].astype(np.uint64) + np.uint64(1)
        key[own] = rolling.mix(rolling.cut(rolling.prefix(letters, _BASE), start[own] - low, end[own] - low, _BASE))
    first, same = np.unique(key, return_index=True, return_inverse=True)[1:]
    one = first[same]
    if (length[one] == length).all() and all(
        np.array_equal(_stretches(held, start[one[own]], length[own]), _stretches(held, start[own], length[own]))
        for own in blocks
    ):
        return first, same
    place: dict[bytes, int] = {}  # two runs with one hash
    runs = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    same = np.array([place.setdefault(run, len(place)) for run in runs], np.int64)
    return np.unique(same, return_index=True)[1], same


class WordCoder:
    """The tokenizers library, asked once per remembered run of non-blank characters.

    Only for vocabularies whose pre-tokenizer drops white space and never looks across it, and
    whose normalizer lower-cases: then the ids of a text are those of its runs one after the
    other.  Others are refused.  ASCII signs behind a letter are a run of their own, and A-Z are
    asked for as a-z.  Unknown runs of many texts go to the library together, with an added token
    between them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._check(json.loads(self.library.to_str()))
        self.library.no_padding()
        self.library.no_truncation()
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.cores = Memo(self._ask, REMEMBERED)

    def _check(self, about: dict) -> None:
        steps = [step["type"] for step in (about["normalizer"] or {}).get("normalizers", [])]
        splits = (about["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        marks = [t for t in about["added_tokens"] if not t["lstrip"] and not t["rstrip"] and not t["single_word"]]
        dropped = splits[0].get("behavior") == "Removed" and splits[0].get("invert")
        if steps != ["NFC", "Replace", "Lowercase"] or not dropped or not marks or len(marks) < len(about["added_tokens"]):
            raise ValueError("the vocabulary does not code runs of non-blank characters one by one")
        if not all("<|" in t["content"] for t in marks):
            raise ValueError("added tokens without <| would be missed")
        self.between, self.mark = marks[0]["content"], marks[0]["id"]

    def _ask(self, runs: list[bytes]) -> Iterator[bytes]:
        """Ids of each run, asked for in lots."""
        for at in range(0, len(runs), ASKED):
            yield from self._ask_lot(runs[at : at + ASKED])

    def _ask_lot(self, runs: list[bytes]) -> list[bytes]:
        """Ids of each run; those with the beginning of an added token are asked for alone."""
        texts = [r.decode() for r in runs]
        plain = [t for t in texts if "<|" not in t]
        alone = [t for t in texts if "<|" in t]
        joined = self.library.encode_batch_fast([self.between.join(plain), *alone], add_special_tokens=False)
        ids = np.array(joined[0].ids, np.uint32)
        ends = np.r_[np.flatnonzero(ids == self.mark), len(ids)].tolist()
        held, width = ids.astype(self.kind).tobytes(), self.kind.itemsize
        starts = [0, *(e + 1 for e in ends[:-1])]
        cut = iter([held[a * width : b * width] for a, b in zip(starts, ends, strict=True)])
        others = iter(joined[1:])
        return [next(cut) if "<|" not in t else np.array(next(others).ids, self.kind).tobytes() for t in texts]

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as little-endian numbers of ``kind``."""
        return self.encode_all([text])[0]

    def _alone(self, text: bytes) -> bytes:
        """Ids of a text that may hold an added token, run by run and in its own letters."""
        runs = text.replace(b"\n", b" ").split(b" ")
        return b"".join(self._ask(runs))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text.  Different runs are looked up once for all texts, and what is not known
        of them is asked for at once."""
        special = {k: self._alone(t) for k, t in enumerate(texts) if b"<|" in t}
        data = b"\n".join(b"" if k in special else t for k, t in enumerate(texts)).translate(_LOWER)
        start, end = _runs(data)
        size = np.fromiter((0 if k in special else len(t) for k, t in enumerate(texts)), np.int64, len(texts))
        begin = np.cumsum(size + 1) - size - 1
        first, same = _different(data, start, end)
        known = [data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        self.cores.learn(known)
        coded = list(map(self.cores.__getitem__, known))
        width = self.kind.itemsize
        length = np.fromiter(map(len, coded), np.int64, len(coded)) // width
        offset = np.cumsum(length) - length
        values = np.frombuffer(b"".join(coded), self.kind)
        ids = b"".join(_stretches(values, offset[same[own]], length[same[own]]).tobytes() for own in _blocks(start))
        ends = np.r_[0, np.cumsum(length[same])][np.searchsorted(start, np.r_[begin, len(data) + 1])] * width
        cuts = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        return [special[k] if k in special else ids[a:b] for k, (a, b) in enumerate(cuts)]

    def encode_steps(self, texts: pa.Array, step: int = STEP_BYTES) -> Iterator[bytes]:
        """Ids of a column of binary texts, coded in steps of about ``step`` bytes."""
        held, size = [], 0
        for text in texts:
            held.append(text.as_buffer().to_pybytes())
            size += len(held[-1])
            if size > step:
                yield from self.encode_all(held)
                held, size = [], 0
        yield from self.encode_all(held)


def coder(path: str) -> WordCoder:
    """The coder of a vocabulary file, loaded once per worker."""
    return kept("words", path, WordCoder)


def _open(path: str):
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        pa.fs.LocalFileSystem(), path
    )


def part_files(folder: str, part: int) -> tuple[str, str]:
    """Names of the two files of a part."""
    return f"{folder}/part-{part:07d}.arrow", f"{folder}/part-{part:07d}.docs.arrow"


class PartWriter:
    """Packs the ids of one part; holds one batch at most besides the list of documents."""

    def __init__(self, folder: str, part: int, kind: np.dtype, length: int, rows: int):
        self.system, root = _open(folder)
        self.system.create_dir(root, recursive=True)
        self.names = part_files(root, part)
        self.own = f"{root}/.{part}-{uuid.uuid4().hex}"
        self.length, self.kind, self.full = length, kind, rows * length * kind.itemsize
        value = pa.uint32() if kind.itemsize == 4 else pa.uint16()
        self.schema = pa.schema({"ids": pa.list_(value, length), "mask": pa.list_(pa.bool_(), length)})
        self.sink = self.system.open_output_stream(self.own)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[bytes] = []
        self.bytes = self.total = 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        count = len(ids) // self.kind.itemsize
        self.docs.append((doc_id, self.total, count))
        self.total += count
        self.waiting.append(ids)
        self.bytes += len(ids)
        full = self.full
        if self.bytes >= full:
            data = b"".join(self.waiting)
            whole = len(data) // full * full
            for at in range(0, whole, full):
                self._batch(np.frombuffer(data, self.kind, full // self.kind.itemsize, at))
            self.waiting, self.bytes = [data[whole:]], len(data) - whole

    def _batch(self, values: np.ndarray) -> None:
        rows = -(-len(values) // self.length)
        ids = np.zeros(rows * self.length, self.kind)
        ids[: len(values)] = values
        mask = np.arange(rows * self.length) < len(values)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.waiting), self.kind)
        if len(rest):
            self._batch(rest)
        self.file.close()
        self.sink.close()
        ids, starts, counts = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        table = pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "start": pa.array(starts, pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
            }
        )
        with self.system.open_output_stream(f"{self.own}.docs") as sink:
            with pa.ipc.new_file(sink, table.schema) as file:
                file.write_table(table, max_chunksize=65_536)
        self.system.move(self.own, self.names[0])
        self.system.move(f"{self.own}.docs", self.names[1])


class PartReader:
    """Random access to the sequences and documents of a part."""

    def __init__(self, folder: str, part: int):
        system, root = _open(folder)
        names = part_files(root, part)
        local = isinstance(system, pa.fs.LocalFileSystem)
        opened = [pa.memory_map(n) if local else system.open_input_file(n) for n in names]
        self.file, self.doc_file = (pa.ipc.open_file(f) for f in opened)
        self.length = self.file.schema.field("ids").type.list_size
        self.kind = np.dtype(self.file.schema.field("ids").type.value_type.to_pandas_dtype())
        self.at, self.batch = -1, None
        # All batches but the last have as many rows as the first.
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def _values(self, number: int) -> np.ndarray:
        if number != self.at:
            self.at, self.batch = number, self.file.get_batch(number)
        return np.asarray(self.batch.column("ids").flatten())

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view, not a copy, if the file is mapped) and mask of sequence k."""
        ids = self._values(k // self.rows)
        row = k % self.rows
        mask = self.batch.column("mask").slice(row, 1).flatten()
        cut = slice(row * self.length, (row + 1) * self.length)
        return ids[cut], mask.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Ids from a position on, in pieces of one batch at most."""
        size = self.rows * self.length
        while count:
            values = self._values(start // size)[start % size :][:count]
            yield values
            start, count = start + len(values), count - len(values)

    def docs(self) -> Iterator[tuple[int | None, int, int]]:
        for number in range(self.doc_file.num_record_batches):
            batch = self.doc_file.get_batch(number)
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def write(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, length: int = LENGTH,
    id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, rows: int = BATCH,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Write all texts; returns ``part, n_tokens, n_docs`` per part.

    Null texts count as empty and hold the end id only; very long ones are written whole.  Rows
    without an id come first; rows of equal ids follow each other in the order of their texts' hashes,
    over as many parts as they fill.  Other columns are ignored; no rows, no parts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    about = texts.agg(F.sum(F.length("text")).alias("size"), F.count("*").alias("n")).first()
    parts = max(1, -(-(about["size"] or 0) // part_bytes), -(-about["n"] // part_rows))
    # The row's number only cuts rows of one id and one text, which are all the same.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = texts.select("doc_id", "text", order[1].alias("hash"), order[2].alias("row"))
    keys = [order[0], "hash", "row"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = coder(vocabulary), TaskContext.get().partitionId()
        end, out = np.array([end_id], own.kind).tobytes(), None
        for batch in batches:
            if batch.num_rows and out is None:
                out = PartWriter(folder, at, own.kind, length, rows)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode_steps(batch.column("text")), strict=True):
                out.add(doc_id, ids + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([out.total], pa.int64()), pa.array([len(out.docs)], pa.int64())],
                names=["part", "n_tokens", "n_docs"],
            )

    sorted_ = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return stage(sorted_.mapInArrow(pack, "part int, n_tokens long, n_docs long"), "parts")


def placed(parts: DataFrame, block: int = 4_096) -> DataFrame:
    """``part, base`` (ids in all earlier parts) by sums inside blocks of parts and over the blocks."""
    each = parts.select("part", "n_tokens", F.expr(f"part div {block}").alias("block"))
    earlier = (Window.unboundedPreceding, -1)
    inside = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("part").rowsBetween(*earlier))
    sums = each.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    # One row per block of parts.
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(*earlier))
    bases = sums.select("block", F.coalesce(before, F.lit(0)).alias("before"))
    return each.select("part", "block", F.coalesce(inside, F.lit(0)).alias("inside")).join(bases, "block").select(
        "part", (F.col("inside") + F.col("before")).alias("base")
    )


def read_documents(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; ``start`` counts
    all ids before the document in ascending order of ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = PartReader(folder, part)
                found: list[tuple] = []
                for doc_id, start, count in reader.docs():
                    check = 0
                    for values in reader.tokens(start, count):
                        check = zlib.crc32(values.astype("<u4").tobytes(), check)
                    found.append((doc_id, before + start, count, check))
                columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    listed = placed(parts).repartition(max(1, parts.count()))
    return listed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
