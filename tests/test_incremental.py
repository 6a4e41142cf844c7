"""Runs that follow a change against a run over everything."""

import glob
import hashlib
import random

import pytest
from caseloom.operators import triage
from caseloom.operators.packet import Limits
from caseloom.plans import incremental
from tests.rows import DAY, alert, inputs, txn

LIMITS = Limits(top_counterparties=2, top_merchants=2, supporting_transactions=3, alert_page=2)


def content(spark, root):
    return {
        name: sorted((r.asDict(recursive=True) for r in incremental.read(spark, root, name).collect()), key=repr)
        for name in incremental.DATASETS
    }


def files(root):
    paths = glob.glob(f"{root}/*/run=*/slice=*/*.parquet")
    return {path: hashlib.md5(open(path, "rb").read()).hexdigest() for path in paths}


@pytest.fixture
def tables():
    rng = random.Random(5)
    parties = [f"P{k}" for k in range(30)]
    txns = [
        txn(f"T{k}", party=rng.choice(parties), ts=rng.randrange(0, 30 * DAY), amount=float(rng.randrange(1, 900)),
            counterparty_id=f"C{rng.randrange(6)}", merchant_id=rng.choice([None, "M1", "M2", "M3"]))
        for k in range(400)
    ]
    alerts = []
    for k in range(60):
        start = rng.randrange(0, 3) * 5 * DAY
        alerts.append(alert(f"A{k}", party=rng.choice(parties[:-2]), start=start, end=start + 10 * DAY - 1, supporting_txn_ids=f"T{k}|T{k + 100}", risk_score=rng.choice([None, 12.5, 12.75, 99.0, 250.0, -3.0, float(k)])))
    alerts += [alert(f"B{k}", party="P0") for k in range(5)]  # several pages
    return {
        "transactions": txns, "alerts": alerts,
        "parties": [{"party_id": p, "party_name": f"name {p}"} for p in parties],
        "counterparties": [{"counterparty_id": f"C{k}", "country": "DE"} for k in range(6)],
        "merchants": [{"merchant_id": f"M{k}", "merchant_name": f"m{k}"} for k in range(4)],
    }


CHANGES = {
    "transactions and alerts, in a window and in none": (
        {"transactions": [txn("N", party="P3", ts=7 * DAY), txn("O", party="P3", ts=900 * DAY)],
         "alerts": [alert("N1", party="P4", start=0, end=10 * DAY - 1), alert("N2", party="P29", start=1, end=2), alert("N3", party="P0")]},
        {"alerts": ["A7"]},
    ),
    "a profile, a listed merchant and counterparty": (
        {"parties": [{"party_id": "P5", "party_name": "new"}], "merchants": [{"merchant_id": "M1", "merchant_name": "new"}],
         "counterparties": [{"counterparty_id": "C2", "country": "FR"}]},
        {"parties": ["P5"], "merchants": ["M1"], "counterparties": ["C2"]},
    ),
}
KEYS = {"transactions": "txn_id", "alerts": "alert_id", "parties": "party_id", "counterparties": "counterparty_id", "merchants": "merchant_id"}


@pytest.mark.parametrize("change", CHANGES)
def test_a_change_gives_what_a_full_run_gives(spark, tables, tmp_path, change):
    new, gone = CHANGES[change]
    after = {
        name: [r for r in rows if r[KEYS[name]] not in gone.get(name, [])] + new.get(name, []) for name, rows in tables.items()
    }
    changed = {
        name: [r for r in tables[name] if r[KEYS[name]] in gone.get(name, [])] + new.get(name, []) for name in {*new, *gone}
    }
    root, full = f"{tmp_path}/kept", f"{tmp_path}/full"
    incremental.first_run(spark, inputs(spark, **tables), root, "1", slices=8, limits=LIMITS)
    before = files(root)
    delta = {name: df for name, df in inputs(spark, **changed).items() if name in changed}
    incremental.apply(spark, inputs(spark, **after), delta, root, "2", LIMITS)
    incremental.first_run(spark, inputs(spark, **after), full, "1", slices=3, limits=LIMITS)
    assert content(spark, root) == content(spark, full)
    now = files(root)
    assert all(now[path] == own for path, own in before.items())  # nothing is written over
    again = {p.split("slice=")[1].split("/")[0] for p in now if p not in before and "/case_packet/" in p}
    assert again
    wanted = triage.numbered_queue(incremental.read(spark, full, "case_packet")).orderBy("position").collect()
    pages = []
    for offset in (0, 7, 30):
        page = incremental.queue_page(spark, root, 7, offset).collect()
        assert {r.total for r in page} <= {len(wanted)}
        assert [r.asDict() | {"total": None} for r in page] == [r.asDict() | {"total": None} for r in wanted[offset : offset + 7]]
        pages += page
    assert len(pages) >= 14
    incremental.apply(spark, inputs(spark, **after), delta, root, "2", LIMITS)  # delivered again
    assert files(root) == now
    gone_paths = incremental.vacuum(spark, root)
    assert len(gone_paths) >= len(again) and content(spark, root) == content(spark, full)


def test_a_failed_run_changes_nothing_and_can_be_repeated(spark, tables, tmp_path, monkeypatch):
    root = f"{tmp_path}/kept"
    incremental.first_run(spark, inputs(spark, **tables), root, "1", slices=4, limits=LIMITS)
    before = content(spark, root)
    more = {**tables, "transactions": [*tables["transactions"], txn("N", party="P3", ts=7 * DAY, amount=5000.0)]}
    delta = {"transactions": inputs(spark, transactions=more["transactions"][-1:])["transactions"]}
    write = incremental._write

    def fails(df, root, name, run, slices):
        if name == "case_packet_json":
            raise RuntimeError("lost")
        write(df, root, name, run, slices)

    monkeypatch.setattr(incremental, "_write", fails)
    with pytest.raises(RuntimeError):
        incremental.apply(spark, inputs(spark, **more), delta, root, "2", LIMITS)
    assert content(spark, root) == before
    monkeypatch.setattr(incremental, "_write", write)
    incremental.apply(spark, inputs(spark, **more), delta, root, "2", LIMITS)
    assert content(spark, root) != before
    with pytest.raises(ValueError):
        incremental.apply(spark, inputs(spark, **more), delta, root, "1", LIMITS)
    with pytest.raises(FileNotFoundError):
        incremental.read(spark, f"{tmp_path}/none", "case_packet")


def test_only_cases_of_the_change_are_computed(spark, tables):
    given = inputs(spark, **tables)
    cases = incremental.C.case_index(given["alerts"])
    moved = [t for t in tables["transactions"] if t["txn_id"] in ("T5", "T6", "T7", "T8", "T9", "T10", "T11")]
    found = incremental.touched_cases(inputs(spark, transactions=moved), cases, None).collect()
    windows = {(a["party_id"], a["window_start_ms_utc"], a["window_end_ms_utc"]) for a in tables["alerts"]}
    assert {tuple(r) for r in found} == {
        w for w in windows for t in moved if t["party_id"] == w[0] and w[1] <= t["txn_timestamp_ms_utc"] <= w[2]
    }
    assert incremental.touched_cases({}, cases, None).count() == 0
    outside = inputs(spark, transactions=[txn("N", party="P3", ts=900 * DAY)])
    assert incremental.touched_cases(outside, cases, None).count() == 0
