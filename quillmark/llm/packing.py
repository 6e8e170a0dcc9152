"""Packing documents into fixed-length sequences as a cutting-stock problem.

Texts are cut into full pieces and one remainder each. The remainders' length
histogram (at most ``capacity`` rows, whatever the corpus) is the demand of a
linear program over packing patterns; column generation solves it from the
patterns of best fit on, a knapsack dynamic program pricing the columns. The
rounded patterns, which never store more than best fit does, are then dealt to the
documents by their rank within their length, which takes one broadcast table of
pattern slots and no further look at the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm import _shared as S
from quillmark.llm.tokens import Encoder

CAPACITY = 1024
#: Column generation goes on for at least so many rounds, and until the program's value is within this share of its
#: lower bound, or until no pattern prices out.
ROUNDS, GAP = 20, 0.001
#: Weight of the plain lengths in the prices a pattern is first sought by, patterns taken from one
#: dynamic program, and simplex steps between two fresh inversions of the basis.
STEADY, TAKEN, FRESH = 0.9, 60, 200
#: Patterns held for each length; beyond it the least promising half that the basis does not use is given up.
HELD = 4
#: Pieces in a ranking group, about.
GROUP = 200
#: Ranking groups whose offsets are summed in one task.
SPAN = 4096


# ------------------------------------------------------------ patterns


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, each holding ``counts[i]`` pieces of ``lengths[i]``."""

    lengths: tuple[int, ...]
    counts: tuple[int, ...]
    times: int


def sequence_cost(fill: int, capacity: int) -> int:
    """Stored tokens of a sequence: padded to the capacity except at a power of two."""
    return fill if fill and fill & (fill - 1) == 0 else capacity


def price(values: np.ndarray, lengths: np.ndarray, cost: np.ndarray) -> tuple[float, list[dict[int, int]]]:
    """The largest ratio of a pattern's value to its cost, and the patterns of largest value less cost.

    Unbounded knapsack: the best pattern for each exact fill.
    """
    capacity = len(cost) - 1
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    chosen = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        if upto[c]:
            found = best[c - lengths[: upto[c]]] + values[: upto[c]]
            k = int(found.argmax())
            best[c], chosen[c] = found[k], k
    gain, out = best - cost, []
    for fill in np.argsort(-gain, kind="stable")[:TAKEN].tolist():
        if fill and gain[fill] > 1e-6:
            counts: dict[int, int] = {}
            while fill > 0:
                k = int(chosen[fill])
                counts[k] = counts.get(k, 0) + 1
                fill -= int(lengths[k])
            out.append(counts)
    return float((best[1:] / cost[1:]).max()), out


@dataclass
class Program:
    """The solved linear program: patterns (index of length to count) with how often each is used, value and bound."""

    patterns: list[tuple[dict[int, int], float]]
    value: float
    bound: float
    finished: bool  # no pattern prices out


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, start: list[dict[int, int]], gap: float = GAP) -> Program:
    """Column generation by the revised simplex method on min cost x, A x >= demand.

    ``start`` are patterns to begin with. Degenerate steps are avoided by a small
    perturbation of the demand. Patterns are first sought at prices near the plain
    lengths, which are themselves a feasible dual solution and hence a lower bound,
    and at the program's own prices if that gives none. The loop has no other end
    than the gap, after ``ROUNDS`` rounds, or the lack of columns.
    """
    m = len(lengths)
    cost = np.array([sequence_cost(c, capacity) for c in range(capacity + 1)], float)

    def dense(patterns: list[dict[int, int]]) -> np.ndarray:
        out = np.zeros((len(patterns), m))
        for row, counts in enumerate(patterns):
            for i, a in counts.items():
                out[row, i] = a
        return out

    pool = [{k: 1} for k in range(m)] + start
    rows = dense(pool)
    price_of = lambda a: cost[(a @ lengths).astype(int)]
    costs, known = price_of(rows), {tuple(sorted(p.items())) for p in pool}
    rng = np.random.default_rng(1)
    wanted = demand * (1 + 1e-4 * rng.random(m)) + 1e-4 * rng.random(m)
    basis, basic = np.arange(m), costs[:m].copy()  # a negative number: the surplus of row -1 - n
    inverse, x, y = np.eye(m), wanted.copy(), costs[:m].copy()
    bound, finished, steps, rounds = float(demand @ lengths), False, 0, 0
    while True:
        gains = rows @ y - costs
        column, surplus = int(gains.argmax()), int(y.argmin())
        if max(gains[column], -y[surplus]) > 1e-6:
            if -y[surplus] > gains[column]:
                entering, c, gain, name = -np.eye(1, m, surplus)[0], 0.0, -y[surplus], -1 - surplus
            else:
                entering, c, gain, name = rows[column], costs[column], gains[column], column
            direction = inverse @ entering
            ratio = np.full(m, np.inf)
            up = direction > 1e-9
            ratio[up] = np.maximum(x[up], 0) / direction[up]
            out = int(ratio.argmin())
            x = x - ratio[out] * direction
            x[out] = ratio[out]
            pivot = inverse[out] / direction[out]
            moved, used = np.flatnonzero(np.abs(direction) > 1e-12), np.flatnonzero(pivot)
            inverse[np.ix_(moved, used)] -= np.outer(direction[moved], pivot[used])
            inverse[out] = pivot
            y = y - gain * pivot
            basic[out], basis[out], steps = c, name, steps + 1
            if steps % FRESH == 0:
                inverse = np.linalg.inv(np.stack([rows[n] if n >= 0 else -np.eye(1, m, -1 - n)[0] for n in basis], 1))
                x, y = inverse @ wanted, basic @ inverse
            continue
        value = float(basic @ np.maximum(x, 0))
        if rounds >= ROUNDS and value - bound <= gap * bound:
            break
        rounds += 1
        new: list[dict[int, int]] = []
        for weight in (STEADY, STEADY / 2, 0.0):
            prices = weight * lengths + (1 - weight) * np.maximum(y, 0)
            ratio_, found = price(prices, lengths, cost)
            bound = max(bound, float(prices @ demand) / max(ratio_, 1.0))
            found = [p for p in found if tuple(sorted(p.items())) not in known]
            if found:
                more = dense(found)
                gains = more @ y - price_of(more)
                new = [p for p, g in zip(found, gains, strict=True) if g > 1e-6]
            if new:
                break
        if not new:
            finished = True
            break
        if len(pool) > HELD * m:
            held = rows @ y - costs
            held[basis[basis >= 0]] = np.inf
            kept = np.sort(np.argsort(-held, kind="stable")[: max(m, HELD * m // 2)])
            place = np.full(len(pool), -1)
            place[kept] = np.arange(len(kept))
            pool, rows, costs = [pool[k] for k in kept.tolist()], rows[kept], costs[kept]
            basis = np.where(basis >= 0, place[np.maximum(basis, 0)], basis)
            known = {tuple(sorted(p.items())) for p in pool}
        known |= {tuple(sorted(p.items())) for p in new}
        more = dense(new)
        pool, rows, costs = pool + new, np.concatenate((rows, more)), np.concatenate((costs, price_of(more)))
    x = inverse @ demand
    used = [(pool[n], float(v)) for n, v in zip(basis.tolist(), x, strict=True) if n >= 0 and v > 1e-9]
    return Program(used, float(basic @ np.maximum(x, 0)), bound, finished)


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: bins of one content are one pattern, however many pieces there are."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {}
    is_open = np.zeros(capacity + 1, bool)

    def put(left: int, content: dict[int, int], bins: int) -> None:
        if bins:
            room.setdefault(left, []).append((content, bins))
            is_open[left] = left > 0

    for n in sorted((n for n, k in histogram.items() if k > 0), reverse=True):
        left = histogram[n]
        while left:
            fits = np.flatnonzero(is_open[n:])
            if len(fits):
                r = int(fits[0]) + n
                content, bins = room[r].pop()
                is_open[r] = bool(room[r])
            else:
                r, content, bins = capacity, {}, left
            most = r // n
            taken = min(left, bins * most)
            whole, extra = divmod(taken, most)
            put(r - most * n, content | {n: most}, whole)
            put(r - extra * n, content | {n: extra}, int(extra > 0))
            if content:
                put(r, content, bins - whole - (extra > 0))
            left -= taken
    return [Pattern(tuple(c), tuple(c.values()), bins) for groups in room.values() for c, bins in groups]


def stored(patterns: list[Pattern], capacity: int) -> int:
    """Tokens that all sequences take, padding included."""
    return sum(p.times * sequence_cost(sum(n * a for n, a in zip(p.lengths, p.counts, strict=True)), capacity) for p in patterns)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[Pattern]:
    """Patterns that hold every piece of the histogram exactly once.

    The program's patterns are rounded down, or, largest share first, up where
    that still fits; best fit packs what is left over. The better of both ways
    is taken, or plain best fit, where that stores less.
    """
    histogram = {n: k for n, k in histogram.items() if k > 0}
    if not histogram:
        return []
    greedy = best_fit(histogram, capacity)
    lengths = np.array(sorted(histogram), np.int64)
    index = {int(n): k for k, n in enumerate(lengths)}
    demand = np.array([histogram[int(n)] for n in lengths], np.int64)
    start = {tuple(sorted((index[n], a) for n, a in zip(p.lengths, p.counts, strict=True))): None for p in greedy}
    program = solve(lengths, demand, capacity, [dict(p) for p in start], gap)
    found = [greedy]
    for least in (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2):
        left, rounded = demand.copy(), []
        for whole in (True, False):
            for counts, value in sorted(program.patterns, key=lambda p: -(p[1] if whole else p[1] % 1)):
                share = np.floor(value + 1e-6) if whole else float(value % 1 >= least)
                times = int(min(share, *(left[i] // a for i, a in counts.items())))
                if times > 0:
                    order = sorted(counts, reverse=True)
                    rounded.append(Pattern(tuple(int(lengths[i]) for i in order), tuple(counts[i] for i in order), times))
                    for i, a in counts.items():
                        left[i] -= a * times
        found.append(rounded + best_fit({int(n): int(k) for n, k in zip(lengths, left, strict=True)}, capacity))
    return min(reversed(found), key=lambda patterns: stored(patterns, capacity))


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces a sequence, first sequence, offset) in rank order."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for n, a in zip(p.lengths, p.counts, strict=True):
            rows.setdefault(n, []).append((ranks.get(n, 0), a, sequence, offset))
            ranks[n] = ranks.get(n, 0) + a * p.times
            offset += n * a
        sequence += p.times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def planned(spark: SparkSession, sizes: dict[int, int], capacity: int, gap: float) -> dict[int, np.ndarray]:
    """The slots of a plan, made in one task: the histogram has at most ``capacity`` rows, and a lost task is run again.

    Its linear algebra is not for the driver, whose threads have begun before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: k for batch in batches for n, k in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        for n, rows in slots(plan(held, capacity, gap)).items():
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(rows), pa.int64()), *(pa.array(rows[:, c]) for c in range(4))], names)

    names = ["length", "rank", "pieces", "sequence", "offset"]
    histogram = spark.createDataFrame(sorted(sizes.items()), "length long, n long").coalesce(1)
    found = histogram.mapInArrow(run, ", ".join(f"{c} long" for c in names)).toArrow()
    rows = np.stack([found.column(c).to_numpy() for c in names], 1)
    return {int(n): rows[rows[:, 0] == n, 1:] for n in np.unique(rows[:, 0])}


# ------------------------------------------------------------ pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's tokens and the closing id 0, cut at multiples of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.at(tokenizer)
        for batch in batches:
            for part in S.slices(batch, "text"):
                keys = part.column("doc_id").to_pylist()
                ids, offsets = encode([t or "" for t in part.column("text").to_pylist()])
                out: list[tuple] = []
                for key, a, b in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    raw, total = ids[a:b].astype("<u4").tobytes() + bytes(4), b - a + 1
                    for start in range(0, total, capacity):
                        stop = min(start + capacity, total)
                        out.append((key, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), total))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def ranked(cut: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length, by counts of small groups: no length meets in one task."""
    groups = max(1, total // GROUP)
    cut = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    sizes = cut.groupBy("length", "group").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("span", F.expr(f"group div {SPAN}"))
    spans = sizes.groupBy("length", "span").agg(F.sum("size").alias("span_size"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("length", "span", F.coalesce(F.sum("span_size").over(before("length", "span")), F.lit(0)).alias("span_first"))
    sizes = sizes.select("length", "span", "group", F.coalesce(F.sum("size").over(before("length", "span", "group")), F.lit(0)).alias("first"))
    first = sizes.join(spans, ["length", "span"]).select("length", "group", (F.col("first") + F.col("span_first")).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "start", "ids_crc32"))
    local = cut.withColumn("own", own)
    return local.join(first, ["length", "group"]).select(*cut.columns[:-1], (F.col("own") - 1 + F.col("first")).alias("rank"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, gap: float = GAP) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    Null text: empty, so one piece with id 0. Rows sharing a doc_id, repeated
    rows and rows with a null doc_id are packed each for itself. A very long
    text gives as many pieces as it needs. An empty table gives no rows. Only
    ``doc_id`` and ``text`` are read, so other columns may have any names. Ranks
    go by a hash of the document, so the packing is the same whatever the
    input's order; rows equal in every way are ranked among each other at will.
    """
    cut = S.materialize(pieces(docs, tokenizer, capacity), "pieces")
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total, full = sum(sizes.values()), sizes.pop(capacity, 0)
    table = planned(docs.sparkSession, sizes, capacity, gap)
    table[capacity] = np.array([[0, 1, max(total - full, 0), 0]], np.int64)  # full pieces stand alone

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                row = table[int(n)][np.searchsorted(table[int(n)][:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + nth // row[:, 1]
                offset[at] = row[:, 3] + nth % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names)

    names = [c.split()[0] for c in PIECES.split(", ")] + ["sequence_id", "offset"]
    columns = names[:5]
    return ranked(cut, total).select(*columns, "rank").mapInArrow(deal, PIECES + ", sequence_id long, offset long")


def tokenizer_path() -> str:
    """The public vocabulary file; only its path is used, on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(S.read(spark, sf_dir, "documents"), tokenizer_path())
