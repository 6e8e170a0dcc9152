"""The life of jobs as a stream: events in order of their time, and failures of jobs that fall silent.

State is kept for each job, in RocksDB on the executors: what it last said, and the
events the watermark has not passed yet. Events that arrive late, but within the
watermark's delay, are put in their place before anything is said about the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The states between which silence counts, and what silence makes of a job.
RUNNING, FAILED = "läuft", "fehlgeschlagen"
SILENT = "keine Meldung"

TOLD = "job_id string, at timestamp, seq long, status string, message string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs(spark: SparkSession) -> None:
    """The session setting without which Spark refuses such operators."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Life(StatefulProcessor):
    """Events of one job, each told once the watermark has passed it; ``idle`` milliseconds of silence end a running job."""

    def __init__(self, idle: int):
        self.idle = idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, running boolean")
        self.waiting = handle.getListState("waiting", "at long, seq long, status string, message string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for part in rows for r in part[["at", "seq", "status", "message"]].itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        due = [r for r in held if r[0] // 1000 <= now]
        at, running = self.last.get() if self.last.exists() else (0, False)
        out = []

        def silence(until: int) -> None:
            nonlocal running
            if running and at + self.idle < until:
                out.append((key[0], at + self.idle, None, FAILED, SILENT))
                running = False

        for time, seq, status, message in due:
            silence(time)
            out.append((key[0], time, seq, status, message))
            at, running = time, status == RUNNING
        silence((now + 1) * 1000)
        if due or out:
            self.last.update((at, running))
            self.waiting.put(held[len(due) :]) if len(due) < len(held) else self.waiting.clear()
        if len(due) < len(held):
            self.handle.registerTimer(held[len(due)][0] // 1000)
        if running:
            self.handle.registerTimer((at + self.idle) // 1000 + 1)
        if out:
            told = pd.DataFrame(out, columns=["job_id", "at", "seq", "status", "message"])
            yield told.assign(at=pd.to_datetime(told["at"], unit="us", utc=True), seq=told["seq"].astype("Int64"))

    def close(self) -> None:
        pass


def _milliseconds(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"select unix_millis(timestamp_micros(0) + interval {interval})").collect()[0][0]


def lives(events: DataFrame, idle: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """job_id, at, seq, status, message of streamed ``events`` with these columns, in order for each job.

    Events of one time go by ``seq``. A running job of which nothing is heard for
    longer than ``idle`` is told to have failed, at the end of that time and with a
    null ``seq``; what it says afterwards counts again. Nothing is told before the
    watermark, ``delay`` behind the newest event, has passed it, and events older
    than the watermark are lost. Events without a time or job are left out.
    """
    spark = events.sparkSession
    needs(spark)
    timed = events.where("job_id is not null and at is not null").withWatermark("at", delay)
    rows = timed.select("job_id", F.col("at").alias("event_time"), F.unix_micros("at").alias("at"), "seq", "status", "message")
    return rows.groupBy("job_id").transformWithStateInPandas(Life(_milliseconds(spark, idle)), TOLD, "Append", "EventTime")
