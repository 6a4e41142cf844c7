import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm import bpe, queries, seqfile, token_counts
from caseloom.llm.common import Memo

SF = "/root/testdata/sf0.01"
BYTES, WORDS = path("byte_bpe_50k.json"), path("word_bpe_49k.json")
ODD = [
    "", " ", "\n\n", "a", "Hello, World!!  it's  we'll I'D", "x" * 5000, "ab" * 400 + " " + "é" * 300, "  lead and trail  ",
    "<|endoftext|> in <|endoftext|>text", "a<|startoftext|>b<|endoftext|>.", "naïve Ünïcode ΣΑΣ ΟΔΟΣ. İstanbul ﬁ", "日本語テキスト。です",
    "é ë́ ́x", "tab\tand\x0bvt\x0cff\x85nel nb ls　", "\x1c\x1d\x1e\x1f", "don't! ... ?!? a.b,c;d. 12,345.67",
    "🙂🙃👩‍👩‍👧 flags 🇩🇪", "�￾\x00\x01", "1" * 500, "!" * 300 + "." * 40, "word. word, word; Word. WORD!", "a.\nb,\r\nc", "'s 'S x's",
]


def noise(seed):
    rng = random.Random(seed)
    alphabet = "aAbBzZ'’.,;:!? \n\t<|>endoftextäÄßéİΣ́  日9٣\x1c🙂"
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(400)))


TEXTS = ODD + [noise(i) for i in range(300)]


def test_byte_pairs_as_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.load(BYTES)
    for text, (ids, names) in zip(TEXTS, own.encode_each(TEXTS), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == expected, text
        assert names == ",".join(map(str, expected))
        assert own.decode(ids) == library.decode(expected, skip_special_tokens=False) == text


def test_scan_and_heap_agree():
    own = bpe.load(BYTES)
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("theingaos ") for _ in range(rng.randrange(1, 60)))
        parts = [own.single[b] for b in word.encode()]
        assert own._scan(list(parts)) == own._heap(list(parts))


def test_counts_are_those_of_the_library_and_build_no_ids(spark, documents, monkeypatch):
    library = Tokenizer.from_file(BYTES)
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    own = bpe.BytePairs(BYTES)
    own.word = own.encode_each = None  # ids of whole texts are not asked for
    wanted = [len(library.encode(text, add_special_tokens=False).ids) for text in TEXTS]
    assert list(own.count_each(TEXTS)) == wanted
    assert len(own.memo) == 0 and len(own.lengths) <= 41
    rows = token_counts.counted(documents(list(enumerate([*TEXTS, None]))), BYTES, "v1").collect()
    assert [r.tokens for r in sorted(rows, key=lambda r: r.doc_id)] == [*wanted, 0]


def test_broken_ids_decode_as_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.load(BYTES)
    for ids in ([162], [228, 50256, 162, 121], [162, 122], [50256]):
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_byte_pairs_of_the_test_table(spark):
    library = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_byte_pairs(spark, SF).collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert tuple(got.pop(r.doc_id)) == (r.doc_id, len(ids), digest, text)
    assert not got


def test_byte_pairs_edges(documents):
    docs = documents([(1, None), (1, ""), (None, "a b"), (None, "a b"), (2, "x" * 100_000)])
    docs = docs.withColumns({"n_tokens": F.lit("clash"), "ids": F.lit(1), "text_to_code": F.lit("y")})
    got = bpe.encode(docs, BYTES).collect()
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in got)[:4] == [(0, 2), (0, 2), (1, 0), (1, 0)]
    assert {r.decoded for r in got if r.doc_id is None} == {"a b"}
    assert bpe.encode(documents([]), BYTES).collect() == []


def test_memo_forgets_without_harm():
    memo = Memo(lambda keys: [k * 2 for k in keys], 3)
    for i in range(50):
        keys = [i % 7, i % 5, i]
        memo.learn(keys)
        assert [memo[k] for k in keys] == [k * 2 for k in keys]
        assert len(memo) <= 3 + 3


def test_words_as_the_library(monkeypatch):
    monkeypatch.setattr(seqfile, "REMEMBERED", 50)
    library, own = Tokenizer.from_file(WORDS), seqfile.WordCoder(WORDS)
    for text in TEXTS:
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text.encode()), own.kind).tolist() == expected, text


def expected_rows(rows):
    library, start, out = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_sequences_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op2_sequences(spark, SF).collect())) == expected_rows([tuple(r) for r in docs])


@pytest.mark.parametrize("length", [8, 64])
def test_files_hold_the_stream(spark, documents, tmp_path, length):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS[:40])] + [(None, "first"), (500, None)]
    folder = f"file://{tmp_path}/out"
    parts = seqfile.write(documents(rows), folder, WORDS, 2, length, part_bytes=2_000, rows=4)
    sizes = {r.part: r.n_tokens for r in parts.collect()}
    assert len(sizes) > 2
    library, stream = Tokenizer.from_file(WORDS), []
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        stream += library.encode(text or "", add_special_tokens=False).ids + [2]
    read = []
    for part in sorted(sizes):
        reader = seqfile.PartReader(folder, part)
        count = -(-sizes[part] // length)
        ids, masks = zip(*[reader.sequence(k) for k in range(count)], strict=True)
        assert all(len(i) == length for i in ids)
        mask = np.concatenate(masks)
        assert mask.sum() == sizes[part] and mask[: sizes[part]].all()
        assert (np.concatenate(ids)[~mask] == 0).all()
        read += np.concatenate(ids)[mask].tolist()
    assert read == stream
    got = seqfile.read_documents(spark, folder, parts).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0)) == expected_rows(rows)


def test_sequences_are_views_of_the_file(spark, documents, tmp_path):
    folder = str(tmp_path / "out")
    parts = seqfile.write(documents([(1, "some words " * 500)]), folder, WORDS, 2, 16)
    before = pa.total_allocated_bytes()
    ids, _ = seqfile.PartReader(folder, parts.first().part).sequence(3)
    assert not ids.flags.owndata and ids.dtype == np.uint16
    assert pa.total_allocated_bytes() - before < 4096


def test_rows_of_one_id_and_empty_texts_fill_several_parts(spark, documents, tmp_path):
    library = Tokenizer.from_file(WORDS)
    rows = [(7, "the same words again") if k % 3 == 0 else (7, f"words {k}") if k % 3 == 1 else (None if k % 2 else k, None) for k in range(300)]
    folder = str(tmp_path / "hot")
    parts = seqfile.write(documents(rows), folder, WORDS, 2, 16, part_bytes=400, rows=4, part_rows=20)
    sizes = [r.n_docs for r in parts.collect()]
    assert sum(sizes) == 300 and max(sizes) < 60
    bases = {r.part: r.base for r in seqfile.placed(parts, block=3).collect()}
    before = 0
    for r in sorted(parts.collect()):
        assert bases[r.part] == before
        before += r.n_tokens
    got = sorted(seqfile.read_documents(spark, folder, parts).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    expected = Counter((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == expected


def test_no_documents_no_parts(spark, documents, tmp_path):
    docs = documents([]).withColumn("part", F.lit(1))
    parts = seqfile.write(docs, str(tmp_path / "none"), WORDS, 2)
    assert seqfile.read_documents(spark, str(tmp_path / "none"), parts).collect() == []


def recount(rows):
    library, out = Tokenizer.from_file(BYTES), {}
    for text, lang, source in rows:
        sums = out.setdefault((source, lang), [0, 0, 0])
        ids = library.encode(text or "", add_special_tokens=False).ids
        for i, n in enumerate((1, len(ids), len(text or ""))):
            sums[i] += n
    return {(*k, "v1", *v) for k, v in out.items()}


def test_ledger_equals_a_recount(spark, documents, tmp_path):
    first = [(1, "one two", "en", "a", 0), (2, "three", "en", "a", 0), (3, None, None, "b", 0), (4, "vier", "de", None, 0),
             (5, "five", "fr", "c", 0), (None, "no name", "en", "a", 0), (6, "twice", "en", "d", 0), (6, "twice", "en", "d", 0)]
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().collect() == []

    def count(rows, version="v1"):
        docs = documents(rows).withColumns({"tokens": F.lit("clash"), "docs": F.lit(9)})
        return token_counts.counted(docs, BYTES, version)

    def held():
        return {tuple(r) for r in ledger.totals().collect()}

    assert ledger.apply("1", count(first))
    assert held() == recount([r[1:4] for r in first])
    # 2 moves to another source, 6 is revised to one row, 4 and 5 go, 99 was never there
    revised = [(2, "three more", "en", "z", 0), (6, "once", "en", "d", 0)]
    gone = spark.createDataFrame([(4,), (5,), (99,), (None,), (4,)], "doc_id long")
    assert ledger.apply("2", count(revised), gone)
    now = [r for r in first if r[0] in (1, 3, None)] + revised
    assert held() == recount([r[1:4] for r in now])
    assert not ledger.apply("2", count(revised), gone)  # delivered again
    assert held() == recount([r[1:4] for r in now])
    # a job that died leaves files without a marker; they do not count, and the batch can run
    count(first).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/ledger/rows/part=b-3")
    assert held() == recount([r[1:4] for r in now])
    assert ledger.apply("3", count([(1, "one two", "en", "a", 0)], "v2"))
    totals = held()
    assert ("a", "en", "v2", 1, 2, 7) in totals
    assert {t for t in totals if t[2] == "v1"} == recount([r[1:4] for r in now])
    assert ledger.apply("4") and ledger.committed() == ["1", "2", "3", "4"]
    # totals read sums only; put together, nothing changes, and batches go on
    assert all("/sums/" in file for file in ledger.totals().inputFiles())
    ledger.compact()
    assert held() == totals and ledger.committed() == ["1", "2", "3", "4"]
    assert not ledger.apply("2", count(revised), gone) and held() == totals
    assert ledger.apply("5", deletes=spark.createDataFrame([(1,)], "doc_id long"))
    assert held() == recount([r[1:4] for r in now if r[0] != 1])
    # one id falls in one bucket, and no other is read
    assert len({r.bucket for r in ledger.rows().where("doc_id = 2").select("bucket").distinct().collect()}) == 1
    ledger.compact()
    assert held() == recount([r[1:4] for r in now if r[0] != 1])
    assert {file.split("/rows/")[1].split("/")[0] for file in ledger.rows().inputFiles()} == {"part=c-2"}


def test_an_id_with_very_many_rows_is_one_row_of_the_ledger(spark, documents, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"), buckets=4)
    rows = [(7, "same words", "en", "s", 0)] * 300 + [(None, "no name", "en", "s", 0)] * 300
    ledger.apply("1", token_counts.counted(documents(rows), BYTES, "v1"))
    assert ledger.rows().count() == 2 and {tuple(r) for r in ledger.totals().collect()} == recount([r[1:4] for r in rows])
    ledger.apply("2", deletes=spark.createDataFrame([(7,), (None,)], "doc_id long"))
    assert {tuple(r) for r in ledger.totals().collect()} == recount([r[1:4] for r in rows[300:]])


def test_token_totals_of_the_test_table(spark):
    import re

    low = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    rows = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r.doc_id not in low:
            rows.append((re.sub(r"[ \t\n\x0b\f\r]+", " ", r.text) if re.search(r"[ \t\n\x0b\f\r]{2}", r.text) else r.text, r.lang, r.source))
    got = {(r.source, r.lang, "v1", r.docs, r.tokens, r.chars) for r in queries.op6_token_totals(spark, SF).collect()}
    assert got == recount(rows)
