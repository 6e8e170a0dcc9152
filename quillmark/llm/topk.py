"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each block of vectors has, for every component, a list sorted by value. A query
reads the lists from their best end: from the top where its own component is
positive, from the bottom where it is negative. What was read gives every
vector a lower and an upper bound; reading goes deeper until no outsider's
upper bound reaches the k-th lower bound, and the rest are resolved exactly.
Lists are read in stages and bounds kept for a block of queries at once, as
matrix products. Queries and vectors meet block by block, in cells of a grid
over which both are dealt, so that none is sent whole to any machine and each
cell gives only its k best; the first queries of
a block go through all stages, the others only through those at which one of
the first could stop, as bounds that never decide would only cost time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import _shared as S

#: Vectors and queries in a block.
BLOCK, QUERY_BLOCK = 4096, 512
#: Most blocks of vectors, and of queries, that meet in one task; bounds its memory.
SIDE = 16
#: Shares of the lists read before the bounds are compared.
STAGES = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 1.0)
#: Queries of a block that go through every stage.
PILOT = 16


def search(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query the rows of all vectors that may be among its k best (at least those, with every
    tie), and the share of the lists that was read.

    Integers throughout; float64 products of them are exact below 2^53.
    """
    n = len(vectors)
    out: list[np.ndarray] = [np.arange(n)] * len(queries)
    share = np.ones(len(queries))
    if n <= k:
        return out, share
    lists = np.sort(vectors, axis=0)
    _read(queries[:PILOT], vectors, lists, k, STAGES, out, share, 0)
    useful = tuple(s for s in STAGES if s == STAGES[-1] or (share[: len(queries[:PILOT])] == s).any())
    _read(queries[PILOT:], vectors, lists, k, useful, out, share, PILOT)
    return out, share


def _read(queries: np.ndarray, vectors: np.ndarray, lists: np.ndarray, k: int, stages: tuple[float, ...], out: list[np.ndarray], share: np.ndarray, first: int) -> None:
    n, active = len(vectors), np.arange(len(queries))
    for stage in stages:
        if not len(active):
            return
        depth = min(n, max(k, int(np.ceil(n * stage))))
        asked = queries[active]
        if depth == n:  # read to the end: both bounds are the score
            lower = upper = asked @ vectors.T
        else:
            p, m = np.maximum(asked, 0), np.minimum(asked, 0)
            top, bottom = lists[n - depth], lists[depth - 1]  # the last value read from either end
            lower = p @ np.where(vectors >= top, vectors, lists[0]).T + m @ np.where(vectors <= bottom, vectors, lists[-1]).T
            upper = p @ np.where(vectors >= top, vectors, top).T + m @ np.where(vectors <= bottom, vectors, bottom).T
        reached = np.partition(lower, n - k, axis=1)[:, n - k]
        may = upper >= reached[:, None]
        done = (may.sum(1) <= 4 * k) | (depth == n)
        for row in np.flatnonzero(done):
            out[first + active[row]] = np.flatnonzero(may[row])
            share[first + active[row]] = stage
        active = active[~done]


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """query id, vector id and score of each query's k best, ties to the smaller id, its own id left out."""
    a, b, c = [], [], []
    spare = int(np.unique(ids, return_counts=True)[1].max(initial=0))  # rows that a query's own id may hold
    for query, q, rows in zip(queries, query_ids, search(queries, vectors, k + spare)[0], strict=True):
        rows = rows[ids[rows] != q]
        score = (vectors[rows] @ query).astype(np.int64)
        first = np.lexsort((ids[rows], -score))[:k]
        a += [q] * len(first)
        b += ids[rows][first].tolist()
        c += score[first].tolist()
    return a, b, c


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    """One row for each of ``count`` even blocks: its number, dimension, ids and integers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        by_size: dict[int, tuple[list, list]] = {}
        for batch in batches:
            values = batch.column("ints")
            lengths = np.diff(values.offsets.to_numpy())
            flat = values.flatten().to_numpy()
            ends = np.cumsum(lengths)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                ids, parts = by_size.setdefault(int(d), ([], []))
                ids.append(batch.column("vec_id").to_numpy()[at])
                parts.append(flat[(ends[at] - d)[:, None] + np.arange(d)].reshape(len(at), d))
        part = TaskContext.get().partitionId()
        for d, (ids, parts) in by_size.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([d], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(parts).tobytes()], pa.binary())],
                ["block", "dim", "ids", "ints"],
            )

    return rows.repartition(count).mapInArrow(run, "block int, dim int, ids binary, ints binary")


def _grid(count: int, asking: int, cores: int) -> tuple[int, int]:
    """Into how many stripes the blocks of vectors go, and into how many groups those of queries: each stripe meets each
    group in a cell of at most SIDE x SIDE blocks, and there are cells enough for the cores."""
    cells = min(count * asking, 3 * cores)
    stripes = max(-(-count // SIDE), min(count, math.ceil(math.sqrt(cells * count / asking))))
    return stripes, max(-(-asking // SIDE), min(asking, -(-cells // stripes)))


def _arrays(batches: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of one block after the other."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids = np.frombuffer(batch.column("ids")[k].as_py(), np.int64)
            yield ids, np.frombuffer(batch.column("ints")[k].as_py(), np.int64).reshape(len(ids), -1).astype(float)


def _cell(queries: np.ndarray, query_ids: np.ndarray, held: list[pa.RecordBatch], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, vector id and score of the k best in all blocks of a cell, at most k for each query id after each block."""
    kept = tuple(np.zeros(0, np.int64) for _ in range(3))
    for ids, vectors in _arrays(held):
        more = best(queries, query_ids, vectors, ids, k)
        asked, found, score = (np.concatenate([x, np.asarray(y, np.int64)]) for x, y in zip(kept, more, strict=True))
        order = np.lexsort((found, -score, asked))
        asked, found, score = asked[order], found[order], score[order]
        place = np.arange(len(asked)) - np.searchsorted(asked, asked)
        kept = tuple(x[place < k] for x in (asked, found, score))
    return kept


def integers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * x) of every vector without null or non-finite components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    ints = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("ints"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best among all vectors (fewer, if there are fewer).

    Both have ``vec_id, ints``. A query's own vec_id never counts; repeated
    queries count once, repeated vectors each time. Vectors of another
    dimension than the query's take no part. Null ids take no part.
    """
    vectors = S.materialize(vectors, "vectors")
    queries = S.materialize(queries.dropDuplicates(["vec_id", "ints"]), "queries")
    count, asking = max(1, -(-vectors.count() // BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    stripes, groups = _grid(count, asking, vectors.sparkSession.sparkContext.defaultParallelism)
    held = S.materialize(_blocks(vectors, count), "blocks")
    asked = S.materialize(_blocks(queries, asking), "asked")
    held = held.select("dim", (F.col("block") % stripes).alias("stripe"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "ids", "ints")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), (F.col("block") % groups).alias("group"), "ids", "ints")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = [_cell(queries, ids, held.to_batches(), k) for ids, queries in _arrays(asked.to_batches())]
        columns = [np.concatenate([np.zeros(0, np.int64), *parts]) for parts in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 3
        return pa.table(columns, ["query_id", "vec_id", "score"])

    cell = ["dim", "stripe", "group"]
    found = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integers(S.read(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


ORACLE = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, cast(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
