import time

from pyspark.sql import functions as F

from leafmill.operators import index, retrieval
from leafmill.scratch import Scratch
from leafmill.streaming import index as stream


def test_batches_are_upserts_and_are_counted(spark, tmp_path):
    """New files replace the rows of their documents; a run without new files
    does nothing; a listener counts rows and keeps failures."""
    folder, at = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    docs = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string").coalesce(1).write.mode("append").parquet(folder)
    scratch, held, progress = Scratch(spark, "t"), {"n": 0}, stream.Progress()
    spark.streams.addListener(progress)

    def apply(batch, number):
        fresh = retrieval.postings(batch)
        rows = fresh if "rows" not in held else index.replace_documents(held["rows"], fresh, "chunk_id")
        held["rows"] = scratch.keep(rows, f"batch-{held['n']}")
        held["n"] += 1

    try:
        docs([("a", "x y x"), ("b", "z")])
        stream.run_available(stream.table_stream(spark, folder), at, apply)
        docs([("a", "only")])
        stream.run_available(stream.table_stream(spark, folder), at, apply)
        assert sorted((r.chunk_id, r.term, r.tf) for r in held["rows"].collect()) == [("a", "only", 1), ("b", "z", 1)]
        before = held["n"]
        stream.run_available(stream.table_stream(spark, folder), at, apply)
        assert held["n"] == before

        def fail(batch, number):
            raise ValueError("no room")

        try:
            stream.run_available(stream.table_stream(spark, folder).withColumn("x", F.lit(1)), str(tmp_path / "other"), fail)
        except Exception as e:  # noqa: BLE001
            assert "no room" in str(e)
        for _ in range(100):
            if sum(progress.rows.values()) >= 3 and progress.failed:
                break
            time.sleep(0.1)
        assert sum(progress.rows.values()) >= 3 and any("no room" in x for x in progress.failed.values())
    finally:
        spark.streams.removeListener(progress)
