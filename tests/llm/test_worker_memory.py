import gc
import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
from public_tokenizers import path

from caseloom.llm import bpe, seqfile, toxicity


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def invented(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghiklmnoprstu", k=9)) for _ in range(n)]


def test_words_of_a_step_are_hashed_in_blocks(monkeypatch):
    own, rng = seqfile.WordCoder(path("word_bpe_49k.json")), random.Random(1)
    words = invented(2_000, 1)
    text = " ".join(rng.choices(words, k=400_000)).encode()  # 4 MB
    found = []
    assert peak_mb(lambda: found.append(own.encode(text))) < 120
    monkeypatch.setattr(seqfile, "BLOCK", 1 << 30)
    monkeypatch.setattr(seqfile, "ASKED", 1 << 30)
    assert seqfile.WordCoder(path("word_bpe_49k.json")).encode(text) == found[0]


def test_features_are_found_a_few_texts_at_a_time():
    rng, words = random.Random(2), invented(3_000, 2)
    texts = [" ".join(rng.choices(words, k=150)) for _ in range(2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0] * len(texts))], names=["text", "label"])
    rows = []

    def work():
        for label, found in toxicity._feature_rows(iter([batch]), None):
            rows.append(len(label))
            assert all((np.diff(f) > 0).all() for f in found)

    assert peak_mb(work) < 40 and sum(rows) == len(texts)
    (label, (found,)), = toxicity._feature_rows(iter([batch.slice(0, 1)]), None)
    plain = sorted(set().union(*map(toxicity.word_features, toxicity.words(texts[0]))))
    assert found.tolist() == plain


def test_a_worker_keeps_one_coder_and_none_beside_the_classifier():
    files = path("byte_bpe_50k.json"), path("word_bpe_49k.json")
    pairs = bpe.load(files[0])
    assert bpe.load(files[0]) is pairs
    gone = weakref.ref(pairs)
    del pairs
    words = seqfile.coder(files[1])
    gc.collect()
    assert gone() is None and seqfile.coder(files[1]) is words
    gone = weakref.ref(words)
    del words
    list(toxicity._feature_rows(iter([]), None))
    gc.collect()
    assert gone() is None
