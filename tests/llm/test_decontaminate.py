import random

import numpy as np
import pytest

from caseloom.llm import decontaminate
from caseloom.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("kind", "least"), [("inserted", 0.99), ("replaced", 0.93)])
def test_edited_items_are_found(spark, documents, kind, least):
    """A foreign word after every second word, or for 25 to 30 % of the words."""
    rng = random.Random(6)
    foreign = lambda: f"zq{rng.randrange(9999)}"
    texts = [r.text for r in table(spark, SF, "documents").where("text is not null").orderBy("doc_id").limit(200).collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").orderBy("item_id").limit(150).collect()]
    rows = []
    for item_id, text in items:
        words = [w.decode() for w in decontaminate.split(text)]
        if kind == "inserted":
            words = [x for i, w in enumerate(words) for x in ([w, foreign()] if i % 2 else [w])]
        else:
            for i in rng.sample(range(len(words)), int(len(words) * rng.uniform(0.25, 0.3))):
                words[i] = foreign()
        around = rng.choice(texts).split()
        at = rng.randrange(len(around) + 1)
        rows.append((item_id, " ".join(around[:at] + words + around[at:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(documents(rows), bench).collect()}
    assert len({(i, i) for i, _ in rows} & got) >= least * len(rows)


@pytest.mark.parametrize("starts", [16, 8192])
def test_the_screen_drops_only_what_verification_drops(monkeypatch, starts):
    monkeypatch.setattr(decontaminate, "STARTS", starts)
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    rng = random.Random(7)
    rows = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(12, 60))), None) for k in range(9)]
    known = decontaminate.Benchmark.of(rows)
    finder = decontaminate.Finder(known, np.ones((known.columns, 1), np.float32))
    words = [f"w{rng.randrange(70)}".encode() for _ in range(900)]
    at = np.arange(0, 888, 6)
    found = [np.stack(pair) for pair in finder.screened(known.numbers(words), at)]
    got = set(map(tuple, np.concatenate(found, axis=1).T.tolist()))
    for passage, start in enumerate(at.tolist()):
        for j, k in enumerate(finder.owner[finder.first].tolist()):
            n = len(known.items[k].words)
            part = set(words[max(0, start - n) : start + decontaminate.WINDOW + n])
            enough = sum(m for w, m in finder.often[k].items() if w in part) >= decontaminate.SHARE * n
            assert not enough or (passage, j) in got
    assert len(got) < len(at) * 9
