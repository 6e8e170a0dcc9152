"""Shards of nearly equal bytes, by longest-processing-time scheduling of groups that must stay together.

Groups, largest first, go to the least loaded shard, taken from a heap. Groups of
one size are alike to the schedule, so the driver sees how many groups there are of
each size and says how many go to which shard; Spark deals the groups out by their
rank within their size. Sizes are told apart by their leading ``BITS`` binary
digits: no more than ``2 ** (BITS - 1)`` classes for each doubling, whatever the
corpus. A class counts with its mean size, so the loads stay true.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import _shared as S

#: Digits by which sizes are told apart; rows ranked in one go; groups that may be broadcast as hot.
BITS = 12
RANKED = 50_000
HOT_GROUPS = 10_000
RESULTS = ("size", "shard", "slot")


def schedule(sizes: list[tuple[float, int]], shards: int) -> np.ndarray:
    """How many groups of each size go to each shard; ``sizes`` are (size, number of groups), the largest first.

    Equal groups go to the shards of smallest load plus those already got. All
    that lie safely under the level which they fill up to go at once, the rest one by one.
    """
    heap = [(0, j) for j in range(shards)]
    out = np.zeros((len(sizes), shards), np.int64)
    for k, (size, n) in enumerate(sizes):
        if n > 2 * shards:
            heap.sort()
            below, used = 0, 0
            for used, (load, _) in enumerate(heap, 1):
                below += load
                if used == shards or (n * size + below) / used <= heap[used][0]:
                    break
            level = (n * size + below) / used - size
            filled = []
            for load, j in heap:
                whole = int(-(-(level - load) // size)) if load < level else 0
                out[k, j] += whole
                n -= whole
                filled.append((load + whole * size, j))
            heap = filled
            heapq.heapify(heap)
        for _ in range(n):
            load, j = heap[0]
            out[k, j] += 1
            heapq.heapreplace(heap, (load + size, j))
    return out


def _ranked(rows: DataFrame, by: str, order: Column, total: int, name: str) -> DataFrame:
    """Adds ``name``: the row's rank from 0 among those of its ``by``, with no ``by`` in one task.

    Rows are hashed to buckets; ranks within a bucket follow those of the buckets before.
    """
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(order), F.lit(max(1, total // RANKED))))
    sums = dealt.groupBy(by, "bucket").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(by, "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("first"))
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy(by, "bucket").orderBy(order)))
    return own.join(first, [by, "bucket"]).select(*rows.columns, (F.col("own") - 1 + F.col("first")).alias(name))


def place(rows: DataFrame, together: Column, size: Column, shards: int = 16, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all, if none are named) with ``size``, ``shard`` and the row's ``slot``, gapless from 0 in its shard.

    Rows whose ``together`` hashes alike stay together, null with null; a null
    ``size`` is 0. A group's size is the sum of its rows'. Repeated rows are rows
    of one group. An empty table gives no rows. Kept columns called ``size``,
    ``shard`` or ``slot`` give way to the results; other names do not matter.
    """
    names = [c for c in keep or rows.columns if c not in RESULTS]
    kept = F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.struct(F.lit(0))
    sized = S.materialize(rows.select(kept.alias("kept"), F.xxhash64(together).alias("key"), F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"), F.monotonically_increasing_id().alias("row")), "sized")
    groups = S.materialize(sized.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "groups")
    shift = F.greatest(F.length(F.bin("bytes")) - BITS, F.lit(0))
    classed = groups.withColumn("class", F.call_function("shiftleft", F.call_function("shiftright", F.col("bytes"), shift), shift))
    found = classed.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("n").alias("rows")).toArrow().to_pydict()
    order = sorted(range(len(found["class"])), key=lambda k: -found["class"][k])
    mean = [b // n if b % n == 0 else b / n for b, n in zip(found["bytes"], found["n"], strict=True)]
    counts = schedule([(mean[k], found["n"][k]) for k in order], shards)[::-1]
    classes = np.array([found["class"][k] for k in reversed(order)], np.int64)
    table = rows.sparkSession.sparkContext.broadcast((classes, np.cumsum(counts, axis=1)))
    total = sum(found["rows"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, ends = table.value
        for batch in batches:
            end = ends[np.searchsorted(classes, batch.column("class").to_numpy())]
            shard = (end <= batch.column("rank").to_numpy()[:, None]).sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(shard)], ["key", "n", "shard"])

    ranked = _ranked(classed, "class", F.col("key"), sum(found["n"]), "rank").select("key", "n", "class", "rank")
    dealt = S.materialize(ranked.mapInArrow(deal, "key long, n long, shard int"), "dealt")
    # no more groups than HOT_GROUPS can hold so many rows each; what is left is small for every key
    many = max(HOT_GROUPS, total // HOT_GROUPS)
    told = sized.join(F.broadcast(dealt.where(F.col("n") > many).select("key", F.col("shard").alias("hot"))), "key", "left")
    hot = told.where("hot is not null").select("kept", "bytes", "row", F.col("hot").alias("shard"))
    rest = told.where("hot is null").join(dealt.where(F.col("n") <= many), "key").select("kept", "bytes", "row", "shard")
    placed = _ranked(hot.unionByName(rest), "shard", F.col("row"), total, "place")
    return placed.select(*(F.col("kept").getField(c).alias(c) for c in names), F.col("bytes").alias("size"), "shard", F.col("place").alias("slot"))


def write(placed: DataFrame, path: str, rows: int = 1_000_000) -> None:
    """A folder of files for each shard, each file with about ``rows`` rows that follow each other by slot."""
    part = placed.withColumn("part", F.expr(f"slot div {rows}"))
    parts = part.select("shard", "part").distinct().count()
    part.repartition(max(parts, 1), "shard", "part").sortWithinPartitions("shard", "slot").drop("part").write.partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = place(told, F.col("text"), F.octet_length("text") + 1, keep=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
