"""Edits of indexed lines as a stream: the postings follow, and never hold two states of one line.

State holds the number of each line's latest edit, so repeated and overtaken edits
change nothing. What changes is committed batch by batch: the new state's postings and a
mark on the state that they replace, in one commit, and once only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillmark.functions import text
from quillmark.operators import commits, lexical
from quillmark.streaming.jobs import needs

#: Tables of the index in its archive.
POSTINGS, REPLACED, APPLIED = "postings", "replaced", "applied"

CHANGE = "line_id string, seq long, text string, before long"


class Lines(StatefulProcessor):
    """The latest ``seq`` of each line of a bucket; says what replaces what."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lines", "line_ids array<string>, seqs array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, tuple[int, str | None]] = {}
        for part in rows:  # of many states of one line in a batch only the last is kept
            for line, seq, said in zip(part["line_id"].tolist(), part["seq"].tolist(), part["text"].tolist(), strict=True):
                if line not in new or (seq, said or "") > (new[line][0], new[line][1] or ""):
                    new[line] = seq, said
        old = self.state.get()
        held = dict(zip(old[0], old[1], strict=True)) if old is not None else {}
        changed = [(line, seq, said, held.get(line)) for line, (seq, said) in new.items() if line not in held or seq > held[line]]
        if changed:
            held.update((line, seq) for line, seq, _, _ in changed)
            self.state.update((list(held), list(held.values())))
            told = pd.DataFrame(changed, columns=["line_id", "seq", "text", "before"])
            yield told.assign(before=told["before"].astype("Int64"))

    def close(self) -> None:
        pass


#: Keys of the state. A key holds a line's number and id for each of its lines, so some thousand lines a key are enough.
BUCKETS = 4096


def follow(edits: DataFrame, archive: commits.Snapshots, checkpoint: str, name: str = "edits", buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the postings in ``archive`` to the latest of each line's streamed states (line_id, seq, text).

    The greatest ``seq`` holds, whenever it comes; of several equal ones the first
    batch's. A null text has no tokens, so it takes a line out of the index. States
    without a line_id or seq are left out. ``name`` tells streams into one archive
    apart; ``buckets``, the number of the state's keys, stays as the first run had it.
    """
    needs(edits.sparkSession)
    rows = edits.where("line_id is not null and seq is not null").select("line_id", F.col("seq").cast("long").alias("seq"), "text")
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("line_id"), F.lit(buckets)).cast("int"))
    changes = keyed.groupBy("bucket").transformWithStateInPandas(Lines(), CHANGE, "Append", "None")

    def apply(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            archive.update(lambda t: _commit(t, kept, name, number))
        finally:
            kept.unpersist()

    return changes.writeStream.foreachBatch(apply).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _commit(transaction: commits.Transaction, batch: DataFrame, name: str, number: int) -> None:
    spark = batch.sparkSession
    if transaction.has(APPLIED) and not transaction.read(APPLIED).where((F.col("stream") == name) & (F.col("batch") == number)).isEmpty():
        return  # a lost attempt of this batch got as far as its commit
    lines = text.compose(batch.select("line_id", "seq", F.coalesce("text", F.lit("")).alias("text")), "text").withColumn("normalized", text.normalize(F.col("text")))
    states = lexical.postings(lines.withColumn("line_id", F.struct("line_id", "seq")))
    transaction.append(POSTINGS, states.select("token", "line_id.line_id", "col", "pos", "line_id.seq"))
    transaction.append(REPLACED, batch.where("before is not null").select("line_id", F.col("before").alias("seq")))
    transaction.append(APPLIED, spark.createDataFrame([(name, number)], "stream string, batch long").coalesce(1))


def current(source: commits.Snapshots | commits.Snapshot) -> DataFrame:
    """token, line_id, col, pos of every line's latest state."""
    snapshot = source.snapshot() if isinstance(source, commits.Snapshots) else source
    return snapshot.read(POSTINGS).join(snapshot.read(REPLACED), ["line_id", "seq"], "left_anti").select("token", "line_id", "col", "pos")


def compact(archive: commits.Snapshots) -> int:
    """Rewrites the postings without replaced ones, sorted by token; the commit's number."""

    def change(t: commits.Transaction) -> None:
        live = t.read(POSTINGS).join(t.read(REPLACED), ["line_id", "seq"], "left_anti").select("token", "line_id", "col", "pos", "seq")
        t.write(POSTINGS, live.repartitionByRange("token").sortWithinPartitions("token"))
        t.write(REPLACED, t.read(REPLACED).limit(0))

    return archive.update(change)
