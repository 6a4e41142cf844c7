"""Files that are dropped over time, again, or into a failing run."""

import os
import shutil
import tempfile

import pytest

from caseloom import schemas
from caseloom.sources import datasets, drops
from tests.rows import alert, table



@pytest.fixture
def schema(spark):
    return schemas.schema("alerts")


def drop(spark, folder, name, ids):
    """One CSV file with the given alerts."""
    os.makedirs(folder, exist_ok=True)
    made = f"{tempfile.mkdtemp()}/made"
    datasets.write_csv(table(spark, "alerts", [alert(i) for i in ids]).coalesce(1), made)
    part = next(f for f in os.listdir(made) if f.endswith(".csv"))
    shutil.copy(f"{made}/{part}", f"{folder}/{name}")


def taken(spark, store):
    return sorted((r.source_file, r.alert_id) for r in drops.read_drops(spark, schemas.schema("alerts"), store).collect())


def test_each_file_is_taken_once(spark, schema, tmp_path):
    store, day = str(tmp_path / "store"), str(tmp_path / "in" / "day1")
    files = str(tmp_path / "in" / "*")
    assert taken(spark, store) == []
    drop(spark, day, "alerts_cash.csv", ["A1", "A2"])
    drop(spark, day, "alerts wires.csv", ["B1"])
    assert drops.take_drops(spark, files, schema, store, files_per_batch=1) == 2
    first = [("alerts wires.csv", "B1"), ("alerts_cash.csv", "A1"), ("alerts_cash.csv", "A2")]
    assert taken(spark, store) == first
    assert drops.take_drops(spark, files, schema, store) == 0
    # The next drop holds a new file and an old one again.
    drop(spark, str(tmp_path / "in" / "day2"), "alerts_cash.csv", ["A1", "A2"])
    drop(spark, str(tmp_path / "in" / "day2"), "alerts_loans.csv", ["C1"])
    assert drops.take_drops(spark, files, schema, store) == 1
    assert taken(spark, store) == sorted([*first, ("alerts_loans.csv", "C1")])


def test_a_failed_run_is_repeated_without_repeated_rows(spark, schema, tmp_path):
    store, files = str(tmp_path / "store"), str(tmp_path / "in")
    drop(spark, files, "a.csv", ["A1"])
    assert drops.take_drops(spark, files, schema, store) == 1
    drop(spark, files, "b.csv", ["B1", "B2"])
    with open(f"{files}/c.csv", "w") as broken:
        broken.write(open(f"{files}/b.csv").readline() + "x,y\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|stream"):
        drops.take_drops(spark, files, schema, store)
    assert taken(spark, store) == [("a.csv", "A1")]
    drop(spark, files, "c.csv", ["C1"])  # mended in place
    drops.take_drops(spark, files, schema, store)
    assert taken(spark, store) == [("a.csv", "A1"), ("b.csv", "B1"), ("b.csv", "B2"), ("c.csv", "C1")]
