"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, a gated attention
decides how much it counts, and the weighted sum of encodings is scored. Only
documents have labels; which passages matter is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import _shared as S

#: Characters in a passage at most (lines are passages, longer ones are cut).
PASSAGE = 400
#: Labelled rows of each label that the model is fitted on, about: the only bound in this operator.
SAMPLE_PER_LABEL = 2500
BUCKETS, STATISTICS = 64, 13
FEATURES = BUCKETS + STATISTICS
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE = 24, 12, 25, 64, 0.01


# ------------------------------------------------------------ passages


def _case() -> np.ndarray:
    """1 for upper-case and title-case letters."""
    if "upper" not in S._TABLES:
        table = np.zeros(0x110000, bool)
        for c in range(0x110000):
            table[c] = chr(c).isupper()
        S._TABLES["upper"] = table
    return S._TABLES["upper"]


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages and the text each belongs to; a text without any has one row of zeros."""
    points, offsets = S.code_points(texts)
    breaks = np.flatnonzero(points == 10)
    start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    end = np.append(start[1:], len(points))
    pieces = np.maximum(1, -(-(end - start) // PASSAGE))
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(start, pieces) + nth * PASSAGE
    start = start[start < len(points)]
    end = np.append(start[1:], len(points))
    text = np.searchsorted(offsets, start, side="right") - 1
    rows = np.zeros((len(start), FEATURES), np.float32)
    if len(start):
        _fill(rows, points, start, end, text)
    empty = np.setdiff1d(np.arange(len(texts)), text)
    rows, text = np.vstack((rows, np.zeros((len(empty), FEATURES), np.float32))), np.concatenate((text, empty))
    order = np.argsort(text, kind="stable")
    return rows[order], text[order]


def _fill(rows: np.ndarray, points: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> None:
    size = (end - start).astype(np.float32)
    kind, upper = S.classes()[points], _case()[points]
    count = lambda mask: np.add.reduceat(mask.astype(np.float32), start)
    letter = kind == S.LETTER
    begins = letter & ~np.concatenate(([False], letter[:-1]))
    word = np.maximum(count(begins), 1)
    other = kind == S.OTHER
    run = other & np.concatenate(([False], other[:-1]))
    same = np.concatenate(([False], points[1:] == points[:-1]))
    space = kind == S.SPACE
    rows[:, 0] = count(letter) / size
    rows[:, 1] = count(upper) / np.maximum(count(letter), 1)
    rows[:, 2] = count(kind == S.NUMBER) / size
    rows[:, 3] = count(space) / size
    rows[:, 4] = count(other) / size
    rows[:, 5] = count(run) / size
    rows[:, 6] = count(same) / size
    rows[:, 7] = count(begins & upper) / word
    rows[:, 8] = count(letter) / word / 8
    rows[:, 9] = np.log1p(size) / 6
    rows[:, 10] = count(space & np.concatenate(([False], space[:-1]))) / size
    # words that a passage has said before, passages that their text has said before
    edge = np.flatnonzero(begins)
    stop = np.flatnonzero(letter & ~np.concatenate((letter[1:], [False]))) + 1
    rolling = S.Rolling(points)
    if len(edge):
        owner = np.searchsorted(start, edge, side="right") - 1
        key = S.mix(rolling(edge, stop) ^ S.mix(owner.astype(S.U64)))
        distinct = owner[np.unique(key, return_index=True)[1]]
        rows[:, 11] = 1 - np.bincount(distinct, minlength=len(start)) / word
    key = S.mix(rolling(start, end) ^ S.mix(text.astype(S.U64)))
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    rows[:, 12] = np.minimum(times[where] - 1, 4) / 4
    # character bigrams, folded into buckets
    kinds = np.where(letter, np.where(upper, 1, 0), np.minimum(points, 0x3FF).astype(np.int64) + 2).astype(S.U64)
    pair = (S.mix(kinds[:-1] * S.U64(4096) + kinds[1:]) % S.U64(BUCKETS)).astype(np.int64)
    owner = np.repeat(np.arange(len(start)), end - start)[:-1]
    rows[:, STATISTICS:] = np.sqrt(np.bincount(owner * BUCKETS + pair, minlength=len(start) * BUCKETS).reshape(-1, BUCKETS) / size[:, None])


# ------------------------------------------------------------ model


@dataclass
class Model:
    """Standardisation and weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        """Everything from passages to scores; ``bag`` numbers each passage's document, ascending."""
        w = self.weights
        first = np.flatnonzero(np.concatenate(([True], bag[1:] != bag[:-1])))
        index = np.cumsum(np.concatenate(([0], (bag[1:] != bag[:-1]).astype(np.int64))))
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        v, u = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (v * u) @ w["attend"]
        a = np.exp(e - np.maximum.reduceat(e, first)[index])
        a /= np.add.reduceat(a, first)[index]
        z = np.add.reduceat(h * a[:, None], first)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "index": index, "p": 1 / (1 + np.exp(-(z @ w["score"] + w["score_bias"])))}

    def scores(self, texts: list[str]) -> np.ndarray:
        rows, bag = passages(texts)
        return self.forward((rows - self.mean) / self.scale, bag)["p"].astype(float)


def train(bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Adam on the weighted cross-entropy; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    bags = [((b - mean) / scale).astype(np.float32) for b in bags]
    shapes = {"encode": (FEATURES, HIDDEN), "value": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION), "attend": (ATTENTION,), "score": (HIDDEN,)}
    w = {k: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) for k, s in shapes.items()}
    w |= {"encode_bias": np.zeros(HIDDEN, np.float32), "score_bias": np.zeros(1, np.float32)}
    model, first, second, step = Model(mean, scale, w), {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            f = model.forward(x, np.repeat(np.arange(len(chosen)), [len(bags[i]) for i in chosen]))
            error = (f["p"] - labels[chosen]) * weight[chosen] / weight[chosen].sum()
            g = {"score": f["z"].T @ error, "score_bias": error.sum(keepdims=True)}
            dz = (error[:, None] * w["score"])[f["index"]]
            da = (dz * f["h"]).sum(1)
            de = f["a"] * (da - np.bincount(f["index"], f["a"] * da)[f["index"]])
            g["attend"] = (f["v"] * f["u"]).T @ de
            dv = de[:, None] * w["attend"] * f["u"] * (1 - f["v"] ** 2)
            du = de[:, None] * w["attend"] * f["v"] * f["u"] * (1 - f["u"])
            g["value"], g["gate"] = f["h"].T @ dv, f["h"].T @ du
            dh = (dz * f["a"][:, None] + dv @ w["value"].T + du @ w["gate"].T) * (1 - f["h"] ** 2)
            g["encode"], g["encode_bias"] = x.T @ dh, dh.sum(0)
            step += 1
            for k in w:
                d = g[k] + 1e-5 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                w[k] = (w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """A model of ``labels.quality`` from about ``per_label`` rows of each label, chosen by hash of doc_id.

    Rows count as much as the label's rows that they stand for. Labels other
    than 0 and 1 and null ids take no part. Without rows every score is 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.when(F.col("quality") == 1, F.lit(per_label / sizes.get(1, 1))).otherwise(F.lit(per_label / sizes.get(0, 1)))
    chosen = known.where(draw < share)  # 2 * per_label rows, about: small enough to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, "text"):
                x, bag = passages([t or "" for t in part.column("text").to_pylist()])
                cuts = np.searchsorted(bag, np.arange(part.num_rows + 1))
                found = [x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(found, pa.binary())], ["quality", "x"])

    found = sorted((r["quality"], bytes(r["x"])) for r in rows.mapInArrow(run, "quality int, x binary").collect())
    if not found:
        zero = {k: np.zeros(s, np.float32) for k, s in {"encode": (FEATURES, HIDDEN), "value": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION), "attend": (ATTENTION,), "score": (HIDDEN,), "encode_bias": (HIDDEN,), "score_bias": (1,)}.items()}
        return Model(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), zero)
    label = np.array([q for q, _ in found], np.float32)
    taken = {q: float((label == q).sum()) for q in (0, 1)}
    weight = np.array([sizes[q] / taken[q] for q, _ in found], np.float32)
    return train([np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, x in found], label, weight / weight.mean())


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``score`` of the whole text and ``predicted``.

    Null text counts as empty, and an empty text as one empty passage. Every
    row is scored by itself, so repeated rows have one score; an empty table gives
    no rows. Very long texts are scored by all their passages. Other columns than
    ``text`` may have any names; kept ones called ``score`` or ``predicted`` would clash.
    """
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, "text"):
                p = model.scores([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    schema = source.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return source.mapInArrow(run, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = S.read(spark, sf_dir, "documents"), S.read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(S.crc_mod("doc_id", 3) != 1))
    return score(docs.select("doc_id", "text", (S.crc_mod("doc_id", 3) == 1).alias("held_out")), model, ["doc_id", "held_out"])
