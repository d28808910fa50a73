"""Incremental indexing as a stream: each new file batch is an upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def run_available(source: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Works through all that is there and stops.  ``apply`` must be a keyed
    replacement, so that a batch which is tried again changes nothing."""
    query = source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(apply).start()
    query.awaitTermination()
    return query


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or one file, read as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


class Progress(StreamingQueryListener):
    """Keeps rows in and batches of each query, for progress displays."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(str(event.id), 0)  # a query that goes on keeps its id

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows[str(event.progress.id)] = self.rows.get(str(event.progress.id), 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.failed[str(event.id)] = event.exception
