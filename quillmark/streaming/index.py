"""Incremental full-text index: new lines arrive as a stream, the postings follow batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.functions import text
from quillmark.operators import lexical


def follow(lines: DataFrame, index: str, checkpoint: str) -> StreamingQuery:
    """Appends marked postings of streamed lines (line_id, text) to the Parquet folder ``index``.

    Each micro-batch writes its own ``batch=<id>`` folder, overwriting what a
    lost attempt left, so a restart repeats nothing and loses nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = text.compose(batch, "text").withColumn("normalized", text.normalize(F.col("text")))
        lexical.marked_postings(rows).write.mode("overwrite").parquet(f"{index}/batch={number}")

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frequencies(spark: SparkSession, index: str) -> DataFrame:
    """token, lines, n of the postings in ``index``; a line that came several times counts once in lines.

    A line with tokens has one in its text, so its first place there tells that it came.
    """
    held = spark.read.parquet(index)
    return lexical.frequencies(held, held.where("col = 0 and pos = 0").select("line_id"))


def job_states(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events of jobs counted by status in event-time windows; late events within ``delay`` still count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n"))
