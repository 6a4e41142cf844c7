"""Session defaults and the shared folder that staged tables are written to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
# Folders staged so far, oldest first.
_STAGED: list[str] = []

# How tables are written: they are read a few times at most, so size counts for more than speed.
COMPRESSED = {"compression": "zstd"}
# After a table of so many bytes the shuffle files behind it are given back at once.
LARGE = 32 << 20


def build_session(app_name: str = "caseloom", **conf: str) -> SparkSession:
    """A session with UTC days and adaptive execution (skew splitting included)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Of repeated keys in a JSON object the last counts.
        "spark.sql.variant.allowDuplicateKeys": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a folder of its own; on a cluster a machine-local folder would
    lose rows with the machine, so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="caseloom-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/caseloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, lean: bool = True) -> DataFrame:
    """Write ``df`` once and read it back.

    Several consumers then share one computation, each reads only its own
    columns, and a lost executor costs a file read instead of the lineage.  Without ``lean``
    files are as the session writes them, and nothing is given back.
    """
    path = scratch_path(df.sparkSession, name)
    _STAGED.append(path)
    df.write.options(**(COMPRESSED if lean else {})).parquet(path)
    if lean:
        give_back(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession, path: str) -> None:
    """Free the disk of the shuffles that a large table below ``path`` was made with.

    Spark deletes the shuffle files of a finished query when the driver's collector finds that nothing
    refers to it, which on a driver with little to do can be long after the disks are full.
    """
    if stored_bytes(spark, path) >= LARGE:
        spark._jvm.System.gc()


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[[], list[str]]]:
    """Delete what the block stages when it ends; gives a function that lists the folders.

    Frames made from them must not be read after it.
    """
    start = len(_STAGED)
    try:
        yield lambda: _STAGED[start:]
    finally:
        own = _STAGED[start:]
        del _STAGED[start:]
        for path in own:
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder; false if it was not there."""
    folder, system = _folder(spark, path)
    return system.delete(folder, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files below a folder."""
    folder, system = _folder(spark, path)
    return system.getContentSummary(folder).getLength()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for a plain scan of fewer splits than there are cores.

    A file of one row group is one task, however many cores wait.  Scans with
    enough splits are returned as they are.  Only for scans: counting the splits
    of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
