"""What the operators share: reading, staging, and a bounded per-worker memo."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import scratch_path
from caseloom.session import stage as _stage

__all__ = ["Memo", "delete", "free_name", "kept", "let_go", "scratch_path", "stage", "table", "text_or_empty"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Staged as the session writes files: the operators' memory and CPU limits were measured so."""
    return _stage(df, name, lean=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores behind it until no column of ``taken`` has that name."""
    own = {name.lower() for name in taken}
    while wanted.lower() in own:
        wanted += "_"
    return wanted


def delete(spark: SparkSession, path: str) -> None:
    """Remove a staged folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_KEPT: dict[tuple[str, str], object] = {}


def kept(use: str, path: str, make: Callable[[str], object]):
    """``make(path)``, kept by the worker for its later tasks of this use; what it keeps for other uses goes.

    Spark gives a worker tasks of one stage after the other, and what a coder remembers is several hundred MB.
    """
    if (use, path) not in _KEPT:
        _KEPT.clear()
        _KEPT[use, path] = make(path)
    return _KEPT[use, path]


def let_go() -> None:
    """Drop what the worker keeps: for tasks that need memory of their own."""
    _KEPT.clear()


class Memo(dict):
    """Answers of ``work`` by key, computed for all missing keys of a batch at once.

    Two generations bound the memory of a worker: when the young one is full it becomes
    the old one, and entries of the old one are taken over as they are asked for again.
    Results never depend on what is remembered.
    """

    def __init__(self, work: Callable[[list], Iterable], entries: int):
        super().__init__()
        self.work = work
        self.entries = entries
        self.old: dict = {}

    def __missing__(self, key):
        """A key that nobody had it learn is learned when it is asked for."""
        self.learn((key,))
        return self[key]

    def learn(self, keys: Iterable) -> None:
        """Make every key present."""
        missing = [key for key in set(keys) if key not in self]
        if not missing:
            return
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()
            missing = list(set(keys))
        fresh = []
        for key in missing:
            found = self.old.get(key)
            if found is None:
                fresh.append(key)
            else:
                self[key] = found
        if fresh:
            self.update(zip(fresh, self.work(fresh), strict=True))
