"""Streams against the batch definitions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators.progress import watermark_history
from lectern.streaming.state import shelf_stream, watermark_stream

EVENT = "reader_id long, book_id long, ts timestamp, event_id long, action string, seq long"


def test_watermark_over_batches(spark, tmp_path):
    rng, begin = random.Random(1), datetime(2024, 1, 1)
    rows = [(k % 4, k % 2, begin + timedelta(seconds=k), k, "reset" if rng.random() < 0.15 else "set", rng.randrange(1000)) for k in range(120)]
    source = str(tmp_path / "in")
    for b in range(3):
        part = rows[b * 40 : (b + 1) * 40]
        spark.createDataFrame(part + part[:5], EVENT).coalesce(1).write.mode("append").parquet(source)  # some events come twice
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    q = watermark_stream(stream).writeStream.format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["event_id"]: r["ceiling_seq"] for r in spark.table("marks").collect()}
    want = {r["event_id"]: r["ceiling_seq"] for r in watermark_history(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == want


def test_shelf_capture(spark, tmp_path):
    cols = "review_id long, shelf_book_id string, title string, author string, shelf string, num_pages long, published_year long, user_rating long, date_read string, date_added string"
    held = {"df": spark.createDataFrame([(1, "b", "old", "a", "read", 1, 1, 1, None, "2000"), (9, "b", "gone", "a", "read", 1, 1, 1, None, "2000")], cols)}
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "b", "new", "a", "read", 2, 1, 1, None, "2024", 1), (1, "b", "newer", "a", "read", 3, 1, 1, None, "2024", 2)], cols + ", fetched_at long").coalesce(1).write.parquet(source)

    def save(df, batch_id):
        held["df"] = spark.createDataFrame(df.collect(), df.schema)

    stream = spark.readStream.schema(cols + ", fetched_at long").parquet(source)
    q = shelf_stream(stream, lambda: held["df"], save, "read", truncated=False).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["review_id"], r["title"], r["date_added"]) for r in held["df"].orderBy("review_id").collect()] == [(1, "newer", "2000")]
    assert held["df"].where(F.col("review_id") == 9).count() == 0
