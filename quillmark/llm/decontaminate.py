"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification.

A document leaks an item if one of its windows of as many words as the item has
a weighted Jaccard similarity of 0.8 or more to it, on five-word shingles
weighted by their counts. Such a window shares a shingle with the item, so only
windows around shared shingles are fingerprinted; which of them are candidates
is decided by their fingerprints, and the exact similarity verifies those. A
text of fewer words than the item is one window of its whole length, compared
exactly with every item of which it shares enough shingles.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import _shared as S

BITS, BLOCKS, FLIPS = 64, 6, 3
#: Largest Hamming distance of which some block differs in at most ``FLIPS`` bits.
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Items looked up at once; a larger benchmark takes several passes, one after the other.
ITEMS = 1000

_CUTS = [round(k * BITS / BLOCKS) for k in range(BLOCKS + 1)]
_SHIFT = np.arange(BITS, dtype=S.U64)


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes; a repeated shingle counts as often as it stands there."""
    bits = ((shingles[:, :, None] >> _SHIFT) & S.U64(1)).sum(1, dtype=np.int64)
    return ((2 * bits > shingles.shape[1]).astype(S.U64) << _SHIFT).sum(1, dtype=S.U64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two arrays of shingles with repeats."""
    keys, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(keys)), np.bincount(where[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Items:
    """Benchmark items of one width (words in an item) with their Hamming blocks and shingle postings."""

    def __init__(self, width: int, ids: list, shingles: np.ndarray):
        self.width, self.ids, self.shingles = width, ids, shingles
        self.size = min(S.SHINGLE, width)
        self.prints = fingerprints(shingles)
        self.vocabulary = np.unique(shingles)
        self.near = []
        for a, b in itertools.pairwise(_CUTS):
            table = np.zeros((1 << (b - a), len(ids)), bool)
            own = self._block(self.prints, a, b)
            for n in range(FLIPS + 1):
                for flips in itertools.combinations(range(b - a), n):
                    table[own ^ sum(1 << f for f in flips), np.arange(len(ids))] = True
            self.near.append(table)

    @staticmethod
    def _block(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((prints >> S.U64(a)) & S.U64((1 << (b - a)) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) within the radius: all of them, found through equal or nearly equal blocks."""
        hit = np.zeros((len(prints), len(self.ids)), bool)
        for (a, b), table in zip(itertools.pairwise(_CUTS), self.near, strict=True):
            hit |= table[self._block(prints, a, b)]
        w, i = np.nonzero(hit)
        close = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        return w[close], i[close]


def items(rows: list[tuple]) -> list[Items]:
    """Items by width from (item_id, text); null texts and texts without words take no part."""
    by_width: dict[int, tuple[list, list]] = {}
    hashes, offsets = S.words([t or "" for _, t in rows])
    for (key, _), a, b in zip(rows, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b > a:
            ids, sets = by_width.setdefault(b - a, ([], []))
            ids.append(key)
            sets.append(S.shingle_hashes(hashes[a:b]))
    return [Items(w, ids, np.array(sets)) for w, (ids, sets) in sorted(by_width.items())]


def leaks(texts: list[str], benchmark: list[Items], similar: float = S.SIMILAR) -> list[tuple]:
    """(text number, item_id, first word of the window, similarity), the best window of each pair."""
    hashes, offsets = S.words(texts)
    best: dict[tuple, tuple[float, int]] = {}
    by_size = {}
    for size in {g.size for g in benchmark}:
        if len(hashes) >= size:
            found = S.shingle_hashes(hashes, size)
            known = np.unique(np.concatenate([g.vocabulary for g in benchmark if g.size == size]))
            table = np.zeros(1 << 20, bool)
            table[(known >> S.U64(44)).astype(np.int64)] = True
            at = np.flatnonzero(table[(found >> S.U64(44)).astype(np.int64)])
            by_size[size] = found, at[np.isin(found[at], known)]
    for group in benchmark:
        if group.size not in by_size:
            continue
        found, hits = by_size[group.size]
        hits = hits[np.isin(found[hits], group.vocabulary)]
        if not len(hits):
            continue
        span = group.width - group.size + 1  # shingles in a window
        for t in np.unique(np.searchsorted(offsets, hits, side="right") - 1).tolist():
            words = int(offsets[t + 1] - offsets[t])
            count = words - group.size + 1  # shingles in the text
            if not group.size <= words < group.width or count < similar * span - 1e-9:
                continue
            own = found[offsets[t] : offsets[t] + count]
            common = np.isin(group.shingles, own).sum(1)  # at least what both share, repeats counted
            for i in np.flatnonzero(common >= similar * (count + span - common) - 1e-9).tolist():
                value = similarity(own, group.shingles[i])
                key = t, group.ids[i]
                if value >= similar and (-value, int(offsets[t])) < best.get(key, (0.0, 0)):
                    best[key] = -value, int(offsets[t])
        start = np.unique(hits[:, None] - np.arange(span))
        start = start[start >= 0]
        text = np.searchsorted(offsets, start, side="right") - 1
        inside = start + group.width <= offsets[text + 1]
        start, text = start[inside], text[inside]
        for part in range(0, len(start), 20_000):
            window = found[start[part : part + 20_000, None] + np.arange(span)]
            for w, i in zip(*group.candidates(fingerprints(window)), strict=True):
                value = similarity(window[w], group.shingles[i])
                key = int(text[part + w]), group.ids[i]
                if value >= similar and (-value, int(start[part + w])) < best.get(key, (0.0, 0)):
                    best[key] = -value, int(start[part + w])
    return [(t, item, at - int(offsets[t]), -value) for (t, item), (value, at) in best.items()]


def _passes(benchmark: DataFrame) -> Iterator[tuple[list[Items], bool]]:
    """The benchmark in parts of about ``ITEMS`` items, each small enough for every task, and whether another follows."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = max(1, -(-rows.count() // ITEMS))
    for k in range(parts):
        yield items([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]), k + 1 < parts


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, similarity``: each row's leaked items, ``start`` counting words from 0.

    Null and empty texts leak nothing; repeated rows each report; an empty
    table on either side gives no rows. Of windows with the same similarity the
    first counts. Texts are read whole, and only doc_id and text are read. Each
    part of a benchmark of more than ``ITEMS`` items is written out before the
    next, so that no plan holds more than one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, start long, similarity double"
    out = None
    for part, more in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in S.slices(batch, "text"):
                    keys = piece.column("doc_id").to_pylist()
                    found = leaks([t or "" for t in piece.column("text").to_pylist()], part)
                    columns = list(zip(*((keys[t], *rest) for t, *rest in found), strict=True)) or [[], [], [], []]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "similarity"])

        found = rows.mapInArrow(run, schema)
        if more or out is not None:
            found = S.materialize(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: rows that leak no item, all columns, whatever their names, unchanged.

    Null and empty texts stay, as do rows with a null doc_id that leak nothing;
    repeated rows go or stay together. An empty benchmark drops nothing, an
    empty table stays empty.
    """
    for part, more in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in S.slices(batch, "text"):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[t for t, *_ in leaks([t or "" for t in piece.column("text").to_pylist()], part)]] = False
                    yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if more:
            docs = S.materialize(docs, "not_leaking")
    return docs


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find(S.read(spark, sf_dir, "documents"), S.read(spark, sf_dir, "benchmark"))
