"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import _shared as S


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
    return row[0], row[1]


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``node, root`` for every node with an edge; ``root`` is the component's smallest node.

    ``edges`` has long columns ``u, v``, in any direction, with repeats and
    loops. Each step is a minimum per node with map-side combining and a join,
    written to the shared folder; only two numbers reach the driver. Steps go on
    until nothing changes; after ``most_rounds``, if given, that is an error.
    """
    edges = S.materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    rounds = 0
    while state[0]:
        if rounds == most_rounds:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
        rounds += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, S.materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        S.discard(last)
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
