"""Sharding, against plain longest-processing-time scheduling of all groups."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import sharding


def plain(sizes, shards):
    heap = [(0, j) for j in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, j = heap[0]
        heapq.heapreplace(heap, (load + size, j))
    return sorted(load for load, _ in heap)


@pytest.mark.parametrize("seed", range(40))
def test_schedule_equals_one_group_after_the_other(seed):
    rng = random.Random(seed)
    shards = rng.choice((1, 2, 5, 16))
    sizes = [(s, rng.choice((1, 2, 7, 100, 5000))) for s in sorted(rng.sample(range(1, rng.choice((30, 5000))), rng.randint(0, 25)), reverse=True)]
    counts = sharding.schedule(sizes, shards)
    assert counts.sum(1).tolist() == [n for _, n in sizes]
    assert sorted((counts * np.array([[s] for s, _ in sizes] or [[0]])).sum(0).tolist()) == plain([s for s, n in sizes for _ in range(n)], shards)


def checked(rows, found):
    """Every row once, slots gapless, equal texts together."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(r.size, r.text_crc32, r.shard) for r in found}) == len({(r.size, r.text_crc32) for r in found})


def test_query_equals_plain_scheduling(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "RANKED", 40)
    monkeypatch.setattr(sharding, "HOT_GROUPS", 30)
    rng = random.Random(7)
    texts = ["é" * rng.choice((1, 2, 3, 40, rng.randint(1, 150))) + str(rng.randint(0, 300)) for _ in range(900)]
    rows = [*enumerate(texts), *((1000 + k, "said again and again") for k in range(600)), (3, texts[3]), (3, texts[3]), (None, texts[4]), (None, None), (7, None), (8, ""), (9, "x" * 3000)]
    rng.shuffle(rows)
    spark.createDataFrame([(k, t, "k", 5, 6) for k, t in rows], "doc_id long, text string, key string, size int, shard int").write.parquet(f"{tmp_path}/documents.parquet")
    found = sharding.op13_sharding(spark, str(tmp_path)).collect()
    checked(rows, found)
    loads, groups = Counter(), Counter()
    for r in found:
        loads[r.shard] += r.size
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    assert all(n < 4096 or t == "said again and again" for t, n in groups.items())
    assert sorted(loads.values()) == plain(groups.values(), 16)


def test_sizes_beyond_the_digits_stay_near_equal(spark):
    rng = random.Random(8)
    sizes = [rng.randint(100_000, 900_000) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(sizes)), "id long, b long")
    loads = [r.n for r in sharding.place(docs, F.col("id"), F.col("b"), 16).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(loads) == 16 and max(loads) - min(loads) < 0.0005 * sum(loads) / 16 + 2 * (max(plain(sizes, 16)) - min(plain(sizes, 16)))


def test_empty_table_and_clashing_names(spark, tmp_path):
    assert sharding.place(spark.createDataFrame([], "a long, b long"), F.col("a"), F.col("b")).collect() == []
    rows = [(k, None if k == 2 else 10 * k, "s", "own", "row", "z") for k in range(8)]
    docs = spark.createDataFrame(rows, "key long, bytes long, slot string, kept string, row string, _ string")
    found = sharding.place(docs, F.col("key"), F.col("bytes"), 3)
    assert found.columns == ["key", "bytes", "kept", "row", "_", "size", "shard", "slot"]
    assert {(r.key, r.bytes, r.size, r.kept) for r in found.collect()} == {(k, b, b or 0, "own") for k, b, *_ in rows}
    sharding.write(found, f"{tmp_path}/out", rows=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 8 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}
