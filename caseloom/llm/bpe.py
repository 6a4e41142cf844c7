"""Byte-level BPE over a contiguous rank array.

A word is held as the list of its parts and the list of the ranks of adjacent parts.  The
smallest rank is searched by scanning, the boundary behind it is deleted, and the two ranks
beside it are refreshed.  Scanning costs the square of the word's length, so a word of more
than ``SHORT`` bytes takes its minima from a heap over linked parts; both give the same
parts.  Words come from the public pre-tokenizer pattern; each worker remembers a bounded
number of words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import Memo, kept, text_or_empty

# Fixed value: the public pattern of byte-level words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 60
SHORT = 96
REMEMBERED = 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    spare = iter(range(256, 512))
    return [letters.get(b) or chr(next(spare)) for b in range(256)]


class BytePairs:
    """Encoder and decoder for a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        ids = model["vocab"]
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.single = [ids[letter] for letter in letters]
        # Ranks of pairs by the left part and then the right one, and by rank the part made.
        none: dict[int, int] = {}
        self.ranks = [none] * (max(ids.values()) + 1)
        for rank, (left, right) in enumerate(model["merges"]):
            if self.ranks[ids[left]] is none:
                self.ranks[ids[left]] = {}
            self.ranks[ids[left]][ids[right]] = rank
        self.made = [ids[left + right] for left, right in model["merges"]]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.added = {}
        for token in data["added_tokens"]:
            self.added[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        import regex

        self.words = regex.compile(WORD).findall
        held = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, held)) + ")").split if held else None
        self.memo = Memo(lambda words: map(self.word, words), REMEMBERED)
        self.lengths = Memo(lambda words: [len(self.parts(word)) for word in words], REMEMBERED)

    def word(self, word: str) -> tuple[list[int], str]:
        """Ids of one pre-token, and the same joined by commas."""
        ids = self.parts(word)
        return ids, ",".join(map(str, ids))

    def parts(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        parts = [self.single[b] for b in word.encode()]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        made, after = self.made, self.ranks
        ranks = [after[a].get(b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            new = parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = after[parts[i - 1]].get(new, NONE)
            if i < len(ranks):
                ranks[i] = after[new].get(parts[i + 1], NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        ranks, made, n = self.ranks, self.made, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (ranks[a][b], i, a, b)
            for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
            if b in ranks[a]
        ]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] < n:
                    a, b = parts[at], parts[after[at]]
                    if b in ranks[a]:
                        heapq.heappush(heap, (ranks[a][b], at, a, b))
        return [p for p in parts if p >= 0]

    def _pieces(self, text: str) -> list[str]:
        """The text, cut at the strings of added tokens."""
        return self.cut(text) if self.cut and any(s in text for s in self.added) else [text]

    def encode_each(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Ids of each text, and the same joined by commas.  The strings of added tokens
        are tokens of their own, as the tokenizers library has it."""
        for text in texts:
            ids: list[int] = []
            names: list[str] = []
            for piece in self._pieces(text):
                if piece in self.added:
                    ids.append(self.added[piece])
                    names.append(str(self.added[piece]))
                elif piece:
                    words = self.words(piece)
                    self.memo.learn(words)
                    memo = self.memo
                    for word in words:
                        part, name = memo[word]
                        ids += part
                        names.append(name)
            yield ids, ",".join(names)

    def count_each(self, texts: list[str]) -> Iterator[int]:
        """How many ids :meth:`encode_each` gives for each text.  Only the number of ids of a
        word is remembered, and no ids are put together."""
        length = self.lengths.__getitem__
        for text in texts:
            yield sum(
                1 if piece in self.added else sum(map(length, self.words(piece))) for piece in self._pieces(text)
            )

    def decode(self, ids: list[int]) -> str:
        """The text; special tokens are kept, broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def load(path: str) -> BytePairs:
    """The coder of a vocabulary file, loaded once per worker."""
    return kept("byte pairs", path, BytePairs)


def encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``ids array<int>``, ``n_tokens``, ``ids_sha256``, ``decoded``,
    ``decoded_sha256`` per row, in one pass without a shuffle.

    Null texts count as empty and give no ids.  Rows with equal or null ids are kept as they
    are.  No rows give no rows; other columns are ignored.
    """
    return _coded(docs, vocabulary, id_col, text_col, True)


def digests(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of :func:`encode`, with neither ids
    nor texts travelling back from the workers."""
    return _coded(docs, vocabulary, id_col, text_col, False)


def _coded(docs, vocabulary, id_col, text_col, whole) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if whole else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary)
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: 2 * whole]]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a few texts' ids at a time
                part = batch.slice(at, 256)
                count, by_ids, by_text, ids_out, text_out = [], [], [], [], []
                for ids, name in coder.encode_each(part.column(1).to_pylist()):
                    text = coder.decode(ids)
                    count.append(len(ids))
                    by_ids.append(hashlib.sha256(name.encode()).hexdigest())
                    by_text.append(hashlib.sha256(text.encode()).hexdigest())
                    if whole:
                        ids_out.append(ids)
                        text_out.append(text)
                columns = [part.column(0), pa.array(count, pa.int64()), pa.array(by_ids, pa.string())]
                columns.append(pa.array(by_text, pa.string()))
                if whole:
                    columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text_to_code"))
    return rows.mapInArrow(work, schema)
