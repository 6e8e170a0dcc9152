"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is its weighted set of five-word shingles, a weight being how often the
shingle occurs. Each unit of weight is a region of height one into which darts
fall as a Poisson process along the rank axis, placed by hashing alone, so
that equal regions get equal darts in every document. A signature keeps for
each coordinate the dart of least rank: two documents agree in a coordinate
with the probability of their weighted Jaccard similarity.

Equal multisets collapse first. Bands of the signatures connect what may be
similar, and inside each connected group exact similarities decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import _shared as S
from quillmark.llm import graph

#: Signature coordinates, and rows in a band: 24 bands miss a pair of similarity 0.8 three times in a million.
COORDINATES, ROWS = 96, 4
#: Distinct texts of a connected group that are compared at once.
BLOCK = 512

_U = S.U64
_STEP, _DART = _U(0xD1342543DE82EF95), _U(0x2545F4914F6CDD1D)


def _cells(limit: float) -> list[tuple[float, float]]:
    """Rank intervals up to ``limit``: dyadic below one, then of width one."""
    out = [(0.0, 1 / 64)] + [(2.0**-e, 2.0 ** (1 - e)) for e in range(6, 0, -1)]
    out += [(float(k), k + 1.0) for k in range(1, int(np.ceil(limit)) + 1)]
    return [c for c in out if c[0] < limit]


_CDF: dict[float, np.ndarray] = {}


def _poisson(width: float) -> np.ndarray:
    if width not in _CDF:
        p = np.cumprod([1.0, *(width / k for k in range(1, 24))]) * np.exp(-width)
        _CDF[width] = np.cumsum(p)
    return _CDF[width]


def units(shingles: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight of sorted shingles: the shingle and its occurrence."""
    new = np.concatenate(([True], shingles[1:] != shingles[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(shingles)), 0))
    return S.mix(shingles + (np.arange(len(shingles)) - first).astype(_U) * _STEP)


def signatures(unit: np.ndarray, owner: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """(n, k) dart identities for n owners, each of whom has units."""
    weight = np.bincount(owner, minlength=n).astype(float)
    reach = k * (np.log(k) + 3.0) / np.maximum(weight, 1)
    out, have = np.zeros((n, k), _U), np.zeros((n, k), bool)
    pending = np.flatnonzero(weight > 0)
    while len(pending):
        wanted = np.zeros(n, bool)
        wanted[pending] = True
        inside = wanted[owner]
        u, o = unit[inside], owner[inside]
        limit = reach[o]
        darts, ranks, owners = [], [], []
        for low, high in _cells(float(reach[pending].max())):
            at = np.flatnonzero(limit > low)
            base = S.mix(u[at] ^ S.mix(np.array([low], np.float64).view(_U)))
            count = np.searchsorted(_poisson(high - low), (base >> _U(11)).astype(np.float64) / 2**53, side="right")
            for i in range(int(count.max(initial=0))):
                hit = count > i
                dart = S.mix(base[hit] + _U((i + 1) * int(_DART) % (1 << 64)))
                rank = low + (high - low) * ((S.mix(dart ^ _STEP) >> _U(11)).astype(np.float64) / 2**53)
                near = rank < limit[at][hit]
                darts.append(dart[near])
                ranks.append(rank[near])
                owners.append(o[at][hit][near])
        dart, rank, own = np.concatenate(darts), np.concatenate(ranks), np.concatenate(owners)
        cell = own * k + (S.mix(dart ^ _DART) % _U(k)).astype(np.int64)
        order = np.lexsort((dart, rank, cell))
        cell, dart = cell[order], dart[order]
        first = np.concatenate(([True], cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, bool)
        out.reshape(-1)[cell[first]] = dart[first]
        have.reshape(-1)[cell[first]] = True
        pending = pending[~have[pending].all(1)]
        reach[pending] *= 2.0  # a coordinate without a dart: throw farther
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, k / rows) band keys."""
    n, k = signature.shape
    out = np.zeros((n, k // rows), _U)
    for r in range(rows):
        out = S.mix(out * _STEP + signature[:, r::rows])
    return S.mix(out + np.arange(k // rows, dtype=_U) * _DART)


def shingles_of(texts: list[str]) -> list[np.ndarray]:
    """Sorted shingle hashes, with repeats, of each text."""
    hashes, offsets = S.words(texts)
    return [np.sort(S.shingle_hashes(hashes[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the weighted shingle set (of the text, if it has none), and the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                sets = shingles_of(texts)
                digest = [hashlib.md5(s.tobytes() if len(s) else b"text:" + t.encode("utf-8", "surrogatepass")).digest() for s, t in zip(sets, texts, strict=True)]
                size = np.array([len(s) for s in sets])
                found = bands(signatures(units_of(sets), np.repeat(np.arange(len(sets)), size), len(sets))).astype(np.int64)
                keys = [row if n else [] for row, n in zip(found.tolist(), size, strict=True)]
                halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "d0", "d1", "bands"],
                )

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, d0 long, d1 long, bands array<long>")


def units_of(sets: list[np.ndarray]) -> np.ndarray:
    found = [units(s) for s in sets if len(s)]
    return np.concatenate(found) if found else np.zeros(0, _U)


# ------------------------------------------------------------ exact links


def links(sets: list[np.ndarray], similar: float = S.SIMILAR) -> list[tuple[int, int]]:
    """Pairs of at least ``similar`` weighted Jaccard that connect all such pairs.

    A spanning set: after the members of a component are known to be linked,
    pairs within it are skipped. Members of the component that is largest at
    their turn wait. In the end those of one component may go without being
    compared, as every other text has been compared with all; the others that
    wait are compared too, since another component may have led when they came.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    flat = units_of(sets)
    distinct, where = np.unique(flat, return_inverse=True)
    order = np.argsort(where, kind="stable")
    holders, begin = owner[order], np.searchsorted(where[order], np.arange(len(distinct) + 1))
    spread = np.diff(begin)
    first = np.concatenate(([0], np.cumsum(sizes)))
    central = np.array([spread[where[first[i] : first[i + 1]]].mean() if sizes[i] else 0 for i in range(n)])
    label, found = np.arange(n), []

    def compare(i: int) -> None:
        mine = where[first[i] : first[i + 1]]
        size = spread[mine]
        at = np.repeat(begin[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(holders[at], minlength=n)
        near = np.flatnonzero(common >= similar * (sizes + sizes[i] - common) - 1e-9)
        for j in near[near != i]:
            if label[j] != label[i]:
                found.append((int(i), int(j)))
                label[label == label[j]] = label[i]

    waiting = []
    for i in np.argsort(-central, kind="stable"):
        count = np.bincount(label, minlength=n)
        if count.max() == n:
            return found
        if count[label[i]] > 1 and count[label[i]] == count.max() and np.argmax(count) == label[i] and len(found) >= 8:
            waiting.append(i)
        else:
            compare(i)
    if waiting:
        pinned = waiting[int(np.argmax(np.bincount(label[waiting], minlength=n)[label[waiting]]))]
        for i in waiting:
            if label[i] != label[pinned]:
                compare(i)
    return found


def verified(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges u, v between similar distinct texts of each group in ``members`` (node, root).

    Groups over ``BLOCK`` texts are dealt into blocks, and each pair of blocks is
    one task's work, so that no group meets in one task and no pairs are written.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    dealt = members.join(sizes, "root").withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    dealt = S.materialize(dealt.select("node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "dealt")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, "text"):
                sets = [s.tobytes() for s in shingles_of([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "root", "blocks", "block")), pa.array(sets, pa.binary())], ["node", "root", "blocks", "block", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(dealt, "node").select("node", "root", "blocks", "block", "text")
    sets = texts.mapInArrow(shingle, "node long, root long, blocks int, block int, shingles binary")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "node", "shingles")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        node = group["node"].to_numpy()
        found = links([np.frombuffer(s, _U) for s in group["shingles"]])
        return pd.DataFrame({"u": [node[i] for i, _ in found], "v": [node[j] for _, j in found]}, dtype="int64")

    return pairs.groupBy("root", "a", "b").applyInPandas(compare, "u long, v long")


# ------------------------------------------------------------ operator


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` for every row; class_id is the smallest doc_id of the near-duplicate class.

    Classes are the connected components of similarity 0.8 or more (weighted
    Jaccard of five-word shingles). Null text counts as empty; texts without
    words are alike only if equal; texts of under five words are one shingle.
    Rows that share a doc_id count as one document. Rows with a null doc_id
    take no part and get a null class_id. Very long texts count with all their
    shingles; an empty table gives no rows. Other columns are left out.
    """
    sketch = S.materialize(sketches(docs), "sketches")
    copies = S.materialize(sketch.groupBy("d0", "d1").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "copies")
    keys = copies.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("top")).where("u <> top").select("key", "u")
    stars = keys.join(buckets, "key").where("node <> u").select("u", F.col("node").alias("v"))
    same_id = sketch.join(copies.select("d0", "d1", "node"), ["d0", "d1"]).select("doc_id", "node")
    edges = verified(graph.components(stars), docs)
    roots = S.materialize(graph.components(edges), "roots")
    found = same_id.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_id"))
    nulls = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return found.unionByName(nulls)


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the document of smallest doc_id of each class, all columns unchanged.

    Of several rows with its doc_id one stays. Rows with a null doc_id stay.
    """
    found = classes(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = S.materialize(found, "gone")
    kept = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    if docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").limit(1).count():
        nulls = kept.where(F.col("doc_id").isNull())
        kept = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(nulls)
    return kept


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return classes(S.read(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))
