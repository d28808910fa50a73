"""Tables that cut lineage, in the folder that all machines of a cluster share.

The folder is the session's ``spark.checkpoint.dir``.  Where that setting is
absent a session on one machine uses its warehouse, which it shares with
itself; a session on a cluster is asked to name a folder.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that goes to a Python worker while a table is written.
BATCH_BYTES = 4 << 20
#: Of local folders: no checksum file beside each part.  Making one starts a
#: process of its own, to set its permissions, from an executor's JVM.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_open: list["Scratch"] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return found.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a plan runs, Arrow batches hold some ``BATCH_BYTES``, so that long
    texts do not fill a worker's memory."""
    before = spark.conf.get(_BATCH_SETTING, None)
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_SETTING)
        else:
            spark.conf.set(_BATCH_SETTING, before)


def _held(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, or a huge number if that is unknown."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, small: int = 64 << 20) -> DataFrame:
    """A small table, whose file may be one piece, dealt to all cores; a larger
    one is read by its pieces, without a shuffle."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if _held(df) <= small else df


def partitions_for(df: DataFrame, size: int = 128 << 20) -> int:
    """Partitions for a shuffle of whole rows of ``df``: the session's number,
    or one for each ``size`` bytes that its files hold, if these are more."""
    held = _held(df)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-held // size)) if held < 1 << 60 else usual  # unknown sizes are given as huge


def files_for(df: DataFrame, size: int = 128 << 20) -> int | None:
    """Files that a table made of ``df`` needs at most, if its rows are small:
    one for each core, or one for each ``size`` bytes that the files of ``df``
    hold, if these are more; None if that is unknown.  In local folders each
    file costs two processes that an executor's JVM starts to set permissions,
    and each shares the JVM's memory until it has become another program."""
    held = _held(df)
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-held // size)) if held < 1 << 60 else None


def in_files(df: DataFrame, most: int | None) -> DataFrame:
    """``df`` in so many partitions at most, without a shuffle."""
    return df.coalesce(most) if most else df


class Scratch:
    """A set of tables under one fresh folder of the shared directory.

    ``keep`` writes a DataFrame once and returns it as a scan of the written
    files, so a lost executor costs a re-read, not a re-run.  ``drop`` frees a
    table that no later plan reads; the rest goes when the interpreter ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _open.append(self)

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        with small_batches(self.spark):
            df.write.mode("overwrite").options(**_PLAIN, compression=compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clear() -> None:
    for s in _open:
        with contextlib.suppress(Exception):  # the session may be gone already
            s.drop()
