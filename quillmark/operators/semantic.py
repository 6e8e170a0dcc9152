"""Vector search over stored embeddings, and the lines that still need one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Encoder(Protocol):
    """An embedding model: texts to vectors. None is bundled; callers bring their own."""

    revision: str

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def dot(vector: str, query: list[float]):
    """Inner product of an array column with the query, in double precision."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, query: list[float], cap: int) -> DataFrame:
    """line_id, raw, rank of the ``cap`` vectors of the query's dimension with the largest inner product."""
    scored = vectors.where(F.size("embedding") == len(query)).select("line_id", dot("embedding", query).alias("raw"))
    top = scored.orderBy(F.desc("raw"), "line_id").limit(cap)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("raw"), "line_id")) - 1)  # over cap rows


def missing(lines: DataFrame, vectors: DataFrame, revision: str) -> DataFrame:
    """Lines of over two characters without a vector of the revision."""
    done = vectors.where(F.col("revision") == revision).select("line_id")
    return lines.where(F.length("text") > 2).join(done, "line_id", "left_anti")


def encode(lines: DataFrame, load: Callable[[], Encoder], revision: str) -> DataFrame:
    """line_id, revision, embedding (unit length); the model loads once in each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for rows in batches:
            v = np.asarray(model(rows["text"].tolist()), np.float32)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"line_id": rows["line_id"], "revision": revision, "embedding": list(v)})

    return lines.select("line_id", "text").mapInPandas(run, "line_id string, revision string, embedding array<float>")
