"""Intermediate tables in the folder that all machines of the cluster share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: the files survive lost
executors, keep column pruning and compress.  Where the setting is missing, a local master
(tests, a laptop) uses a folder of this library's own; on a cluster that is an error, as
each executor would write to a disk of its own.

Folders are deleted when what they hold has been written on (:class:`Scratch`), by
:func:`clean`, or when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local master where spark.checkpoint.dir is unset.
OWN_DIR = "file:///tmp/checkpoints/pagemill"
#: Folders that exist, in the order in which they were made.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder (a path or URL, not yet made) below the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share: the master is {master!r}")
        base = OWN_DIR
    path = f"{base.rstrip('/')}/pagemill-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clean, spark)
    _made.append(path)
    return path


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written once and read back; nothing above it is computed again."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["stored_in"] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # Spark has no other way to delete
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders; what is read from them can't be computed any more."""
    for path in paths:
        if path in _made:
            _made.remove(path)
            _delete(spark, path)


def release(df: DataFrame) -> None:
    """Deletes the folder of a table made by :func:`stored` that nothing will be read from any more."""
    drop(df.sparkSession, [df.__dict__.get("stored_in", "")])


def clean(spark: SparkSession) -> None:
    """Deletes all folders of this driver.  Results that still read from them are lost."""
    try:
        drop(spark, list(_made))
    except Exception:  # noqa: BLE001: the session may have ended; the folders are then left to whoever clears spark.checkpoint.dir
        _made.clear()


class Scratch:
    """``with Scratch(spark) as s``: folders made inside are deleted at the end, but for what was given to ``s.keep``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scratch:
        self._before = set(_made)
        self._kept: set[str] = set()
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and keeps that table, which needs nothing else that was made inside."""
        out = stored(df)
        self._kept.add(out.__dict__["stored_in"])
        return out

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            drop(self.spark, [p for p in _made if p not in self._before and p not in self._kept])
