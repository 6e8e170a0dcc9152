"""Line deduplication: equal lines, and lines within an edit distance, across all documents.

Lines within distance t share one of t + 1 segments of the shorter one unchanged
(segment-partition join). Segment places depend on a level of the line's length
only, so lines of like lengths cut the same keys: the first segment counts from
the line's start, the last one from its end, and the inner ones are looked up at
the few shifts that the edits before them allow. Lines that share a key with
another line meet in groups, where a banded bit-parallel edit distance verifies
each pair once, at the first key that the two share. Groups give counts by line
and class edges, never lists of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import _shared as S
from quillmark.llm import graph

#: Edits up to which lines are alike, and characters below which a line is never touched.
DISTANCE, MIN_CHARS = 2, 20
#: Least width of a level of lengths; above, a level is a quarter of its shortest line wide.
WIDTH = 8
#: Line hashes a task remembers to emit a repeated line's keys once; forgotten beyond it.
REMEMBERED = 200_000
#: Keys of many lines are found on this share of the lines, from so many lines on, so many at most.
#: They are split by the lines' character sketches, which changes the work and never the result.
SAMPLE, HOT_LINES, HOT_KEYS = 16, 8, 20_000
#: Lines of a key that meet at once, pairs looked at together, and cells of the edit distance done together.
BLOCK, PAIRS, CELLS = 128, 500_000, 2_000_000

_U = S.U64
_A, _B = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25)
#: A key's low byte: four bits for the part of the sketch that split it (0: none), four for the segment.
_TAG = 0xFF
_SKETCH = (1 << 63) - 1


# ------------------------------------------------------------ lines of a chunk


class Lines:
    """All lines of at least ``least`` characters in some texts, as arrays."""

    def __init__(self, texts: list[str], least: int):
        self.points, offsets = S.code_points(texts)
        breaks = np.flatnonzero(self.points == 10)
        inside = np.searchsorted(breaks, offsets)  # line feeds before each text
        count = np.diff(inside) + 1
        self.text = np.repeat(np.arange(len(texts)), count)
        self.number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.start = np.zeros(count.sum(), np.int64)
        self.start[self.number == 0], self.start[self.number > 0] = offsets[:-1], breaks + 1
        self.end = np.zeros(count.sum(), np.int64)
        last = np.cumsum(count) - 1
        self.end[last] = offsets[1:]
        self.end[np.setdiff1d(np.arange(count.sum()), last, assume_unique=True)] = breaks
        self._take(self.end - self.start >= least)
        self.values = S.scattered(self.points)
        self.rolling = S.Rolling(self.points, self.values)

    def _take(self, keep: np.ndarray) -> None:
        for name in ("start", "end", "text", "number"):
            setattr(self, name, getattr(self, name)[keep])

    def hashes(self) -> np.ndarray:
        return self.rolling(self.start, self.end)

    def second(self) -> np.ndarray:
        """Another hash, so that two different lines are never taken as equal: characters weighted by place."""
        odd = 2 * np.arange(len(self.points), dtype=_U) + _U(1)
        plain, placed = np.zeros(len(odd) + 1, _U), np.zeros(len(odd) + 1, _U)
        np.cumsum(self.values, out=plain[1:])
        np.cumsum(self.values * odd, out=placed[1:])
        start = self.start.astype(_U)
        return S.mix(placed[self.end] - placed[self.start] - 2 * start * (plain[self.end] - plain[self.start]))

    def sketch(self) -> np.ndarray:
        """Parity of 63 character classes: an edit changes two bits at most. The top bit stays 0."""
        if not len(self.start):
            return np.zeros(0, _U)
        cuts = np.stack((self.start, self.end), 1).reshape(-1)
        bits = _U(1) << np.minimum(self.values & _U(63), _U(62))
        return np.where(self.end > self.start, np.bitwise_xor.reduceat(np.append(bits, _U(0)), cuts)[::2], _U(0))


# ------------------------------------------------------------ keys


class Segments:
    """Places of the t + 1 segments of a line, by the level of its length."""

    def __init__(self, t: int, least: int):
        if t < 1 or least < max(t * (t + 1), 2 * t + 1):
            raise ValueError("lines must have at least t * (t + 1) characters, and t be 1 or more")
        self.t = t
        bounds = [least]
        while bounds[-1] < 1 << 40:
            bounds.append(bounds[-1] + max(WIDTH, t + 1, bounds[-1] // 4))
        self.bounds = np.array(bounds, np.int64)

    def level(self, length: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, length, side="right") - 1

    def place(self, bound: np.ndarray, length: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the i-th segment of a level begins in a line of ``length``, and its size."""
        edge = bound // (self.t + 1)
        if i == 0:
            return np.zeros_like(bound), edge
        if i == self.t:
            return length - edge, edge
        size = (bound - 2 * edge) // (self.t - 1)
        return edge + (i - 1) * size, size

    def shifts(self, i: int, gap: int) -> range:
        """Shifts of an inner segment in a line ``gap`` or more characters longer."""
        return range(max(-i, gap - (self.t - i)), i + 1)

    def key(self, rolling: S.Rolling, start: np.ndarray, length: np.ndarray, level: np.ndarray, i: int, shift: int = 0) -> np.ndarray:
        at, size = self.place(self.bounds[level], length, i)
        hashes = S.mix(rolling(start + at + shift, start + at + shift + size) ^ (level.astype(_U) * _A + _U((i + 1) * int(_B) % 2**64)))
        return (hashes & _U(~_TAG & (1 << 64) - 1)) | _U(i)

    def index(self, rolling: S.Rolling, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(lines, t + 1) keys of the lines' own segments."""
        level = self.level(length)
        return np.stack([self.key(rolling, start, length, level, i) for i in range(self.t + 1)], 1)

    def probes(self, rolling: S.Rolling, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Line numbers and further keys under which shorter or equally long lines may have their segments."""
        t, level, rows, keys = self.t, self.level(length), [], []
        for i in range(1, t):
            for shift in self.shifts(i, 0):
                if shift:
                    rows.append(np.arange(len(start)))
                    keys.append(self.key(rolling, start, length, level, i, shift))
        gap = length - self.bounds[level] + 1  # characters to the level below
        for g in range(1, t + 1):
            low = np.flatnonzero((gap == g) & (level > 0))
            if len(low):
                for i in range(t + 1):
                    for shift in self.shifts(i, g) if 0 < i < t else (0,):
                        rows.append(low)
                        keys.append(self.key(rolling, start[low], length[low], level[low] - 1, i, shift))
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, _U), *keys])

    def holds(self, rolling: S.Rolling, r: tuple[np.ndarray, np.ndarray], s: tuple[np.ndarray, np.ndarray], i: int) -> np.ndarray:
        """Whether lines ``s`` (start, length) have a key of segment i that their shorter or equal ``r`` is indexed by."""
        (start, length), (other, longer) = r, s
        level, above = self.level(length), self.level(longer)
        bound = self.bounds[level]
        at, size = self.place(bound, length, i)
        own = rolling(start + at, start + at + size)
        if i in (0, self.t):
            there = other + self.place(bound, longer, i)[0]
            return rolling(there, there + size) == own
        gap = np.where(above == level, 0, longer - self.bounds[above] + 1)
        found = np.zeros(len(start), bool)
        for shift in self.shifts(i, 0):
            there = other + at + shift
            found |= (shift >= gap - (self.t - i)) & (rolling(there, there + size) == own)
        return found


def parts(t: int) -> list[tuple[int, int]]:
    """First bit and bits of the 2t + 1 parts of a sketch: of two lines within t edits some part is equal."""
    cuts = [round(k * 63 / (2 * t + 1)) for k in range(2 * t + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


# ------------------------------------------------------------ verification


def within(points: np.ndarray, rolling: S.Rolling, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """Whether the edit distance of each pair of lines (start, length) is at most ``most`` (under 31).

    ``a`` is at least as long as ``b``. What both begin and end with goes first;
    then bit vectors run along the diagonal, for many pairs at once.
    """
    (sa, la), (sb, lb) = a, b
    for end in (False, True):
        low, high = np.zeros_like(lb), lb.copy()
        while (open_ := low < high).any():
            half = (low + high + 1) // 2
            x, y = (sa + la - half, sb + lb - half) if end else (sa, sb)
            same = rolling(x, x + half) == rolling(y, y + half)
            low, high = np.where(open_ & same, half, low), np.where(open_ & ~same, half - 1, high)
        if not end:
            sa, sb = sa + low, sb + low
        la, lb = la - low, lb - low
    out = (la - lb <= most) & (la <= most)
    left = np.flatnonzero((la - lb <= most) & (la > most))
    left = left[np.argsort(la[left], kind="stable")]
    at = 0
    while at < len(left):
        size = la[left[at:]] * np.arange(1, len(left) - at + 1)  # cells, if the longest line decides
        stop = at + max(1, int(np.searchsorted(size, CELLS, side="right")))
        some = left[at:stop]
        out[some] = _banded(points, sa[some], la[some], sb[some], lb[some], most)
        at = stop
    return out


def _banded(points: np.ndarray, sa: np.ndarray, la: np.ndarray, sb: np.ndarray, lb: np.ndarray, most: int) -> np.ndarray:
    def columns(start: np.ndarray, length: np.ndarray, none: int) -> np.ndarray:
        step = np.arange(length.max())[:, None]
        return np.where(step < length, points[np.minimum(start + step, len(points) - 1)], np.uint32(none))

    pad = np.full((most, len(sa)), 0xFFFFFFFE, np.uint32)
    x, y = np.concatenate((pad, columns(sa, la, 0xFFFFFFFE), pad)), columns(sb, lb, 0xFFFFFFFF) if lb.max() else np.zeros((0, len(sb)), np.uint32)
    one, top = _U(1), _U(63)
    vp, vn = np.full(len(sa), (((1 << 64) - 1) << (63 - most)) & ((1 << 64) - 1), _U), np.zeros(len(sa), _U)
    distance, edge = np.full(len(sa), most, np.int64), np.full(len(sa), _U(1 << 62))
    for j in range(len(y)):
        eq = np.zeros(len(sa), _U)
        for d in range(2 * most + 1):  # bit 63 - d stands for the character of a at j + most - d
            if j + 2 * most - d < len(x):
                eq |= (x[j + 2 * most - d] == y[j]).astype(_U) << _U(63 - d)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        on, whole = j < lb, j < la - most
        tail = on & ~whole
        distance += on & whole & ((d0 >> top) == 0)
        distance += np.where(tail, ((hp & edge) != 0).astype(np.int64) - ((hn & edge) != 0), 0)
        edge = np.where(tail, edge >> one, edge)
        vp, vn = np.where(on, hn | ~((d0 >> one) | hp), vp), np.where(on, (d0 >> one) & hp, vn)
    return distance <= most


class Groups:
    """Lines that share a key, many groups in a table sorted by group and hash: counts and class edges."""

    NAMES = ("key", "a", "b", "block", "h", "h2", "meta", "rep", "line")

    def __init__(self, t: int, least: int):
        self.t, self.segments = t, Segments(t, least)

    def __call__(self, table: pa.Table) -> pa.RecordBatch:
        get = lambda name: table.column(name).to_numpy()
        key, block, h, h2, meta, rep = get("key").view(_U), get("block"), get("h"), get("h2"), get("meta").view(_U), get("rep")
        points, offsets = S.code_points(table.column("line").to_pylist())
        rolling = S.Rolling(points)
        start, length = offsets[:-1], np.diff(offsets)
        cross = get("a") != get("b")
        begin = np.flatnonzero(_new_group(table))
        end = np.repeat(np.append(begin[1:], len(h)), np.diff(np.append(begin, len(h))))
        partners = end - np.arange(len(h)) - 1
        links, drop, label = np.zeros(len(h), np.int64), np.zeros(len(h), bool), np.arange(len(h))
        taken = np.cumsum(partners) // PAIRS
        for k in range(int(taken[-1]) + 1 if len(taken) else 0):
            rows = np.flatnonzero((taken == k) & (partners > 0))
            x = np.repeat(rows, partners[rows])
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(partners[rows]) - partners[rows], partners[rows])
            fine = np.bitwise_count((meta[x] ^ meta[y]) & _U(_SKETCH)) <= 2 * self.t
            fine &= (np.abs(length[x] - length[y]) <= self.t) & (h[x] != h[y]) & ~(cross[x] & (block[x] == block[y]))
            x, y = x[fine], y[fine]
            swap = (length[y] < length[x]) | ((length[y] == length[x]) & (h[y] < h[x]))
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            first = self._first(rolling, key[x], start, length, meta, x, y)
            x, y = x[first], y[first]
            near = within(points, rolling, (start[y], length[y]), (start[x], length[x]), self.t)
            x, y = x[near], y[near]
            np.add.at(links, x, 1)
            np.add.at(links, y, 1)
            later = (rep[x] > rep[y]) | ((rep[x] == rep[y]) & (h[x] > h[y]))
            drop[x[later]], drop[y[~later]] = True, True
            while len(x):
                least = np.minimum(label[x], label[y])
                if (label[x] == least).all() and (label[y] == least).all():
                    break
                np.minimum.at(label, x, least)
                np.minimum.at(label, y, least)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(h2[some]), pa.array(links[some]), pa.array(drop[some]), pa.array(h[label[some]])], ["h", "h2", "links", "drop", "root"])

    def _first(self, rolling: S.Rolling, key: np.ndarray, start: np.ndarray, length: np.ndarray, meta: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether this is the first key that the lines of each pair share, in a fixed order of keys; x is the shorter one."""
        kind, part = (key & _U(15)).astype(np.int64), ((key >> _U(4)) & _U(15)).astype(np.int64)
        indexed, equal = meta[x] >> _U(63) == 1, length[x] == length[y]
        fine = indexed | (equal & (meta[y] >> _U(63) == 1))
        for n, (at, bits) in enumerate(parts(self.t)):
            alike = ((meta[x] ^ meta[y]) >> _U(at)) & _U((1 << bits) - 1) == 0
            fine &= ~((n + 1 < part) & alike)
        t, r, s = self.t, (start[x], length[x]), (start[y], length[y])
        before = np.zeros(len(x), bool)
        for i in (0, t, *range(1, t)):
            here = kind == i
            found = self.segments.holds(rolling, r, s, i)
            if 0 < i < t:
                # lines of one length meet at the shorter hash's segment, else at the other's
                fine &= ~(here & ~indexed & found)
                found |= equal & self.segments.holds(rolling, s, r, i)
            fine &= ~(here & before)
            before |= found
        return fine


def _new_group(table: pa.Table) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for name in ("key", "a", "b"):
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


# ------------------------------------------------------------ join


def occurrences(docs: DataFrame, t: int, least: int) -> DataFrame:
    """Every line of at least ``least`` characters: h, h2 (the line), doc_id, number of the line in
    its text, whether its text has it for the first time, its sketch, and its keys, where the task
    meets the line for the first time."""
    segments = Segments(t, least)
    schema = "h long, h2 long, doc_id long, number int, first boolean, sketch long, own array<long>, more array<long>"

    def lists(rows: np.ndarray, keys: np.ndarray, n: int) -> pa.Array:
        ends = np.cumsum(np.bincount(rows, minlength=n))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(keys[np.argsort(rows, kind="stable")].view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in S.slices(batch, "text"):
                lines = Lines([x or "" for x in part.column("text").to_pylist()], least)
                h, start, length = lines.hashes(), lines.start, lines.end - lines.start
                order = np.lexsort((lines.number, h, lines.text))
                again = np.zeros(len(h), bool)
                again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (lines.text[order[1:]] == lines.text[order[:-1]])
                new = _unseen(h, seen)
                own = segments.index(lines.rolling, start[new], length[new])
                rows, keys = segments.probes(lines.rolling, start[new], length[new])
                arrays = [h.view(np.int64), lines.second().view(np.int64), part.column("doc_id").take(pa.array(lines.text)), lines.number.astype(np.int32), ~again, lines.sketch().view(np.int64)]
                arrays += [lists(np.repeat(new, t + 1), own.reshape(-1), len(h)), lists(new[rows], keys, len(h))]
                yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], [c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def _unseen(hashes: np.ndarray, seen: set) -> np.ndarray:
    """Numbers, in order, of lines this task meets for the first time."""
    if len(seen) > REMEMBERED:
        seen.clear()
    distinct, first = np.unique(hashes, return_index=True)
    new = np.fromiter((x not in seen for x in distinct.tolist()), bool, len(distinct))
    seen.update(distinct[new].tolist())
    return np.sort(first[new])


def shared_keys(seen: DataFrame, t: int) -> DataFrame:
    """``key, h, meta`` (the sketch; top bit: indexed by the key) of lines that share a key with another.

    A key of very many lines goes out once for each part of the sketch, so that
    lines meet only if some part is equal, as it is within distance ``t``.
    """
    own = seen.select(F.explode("own").alias("key"), "h", F.col("sketch").bitwiseOR(F.lit(-(1 << 63))).alias("meta"))
    more = seen.select(F.explode("more").alias("key"), "h", F.col("sketch").alias("meta"))
    sampled = own.where(F.pmod(F.xxhash64("h"), F.lit(SAMPLE)) == 0).select("key", "h").distinct().groupBy("key").agg(F.count("*").alias("n"))
    hot = sampled.where(F.col("n") >= HOT_LINES).orderBy(F.desc("n"), "key").limit(HOT_KEYS).select(F.col("key").alias("hot"))
    hot = S.materialize(hot, "hot_keys")
    split = []
    for n, (at, bits) in enumerate(parts(t)):
        own_bits = F.shiftrightunsigned("meta", at).bitwiseAND(F.lit((1 << bits) - 1))
        tag = F.col("key").bitwiseAND(F.lit(15)).bitwiseOR(F.lit((n + 1) << 4))
        split.append(F.xxhash64("key", own_bits, F.lit(n)).bitwiseAND(F.lit(~_TAG)).bitwiseOR(tag))
    rows = own.unionByName(more).join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")  # at most HOT_KEYS rows
    rows = rows.select(F.explode(F.when(F.col("hot").isNull(), F.array("key")).otherwise(F.array(*split))).alias("key"), "h", "meta")
    over = Window.partitionBy("key")
    shared = rows.withColumn("low", F.min("h").over(over)).withColumn("high", F.max("h").over(over)).withColumn("sign", F.min("meta").over(over))
    return shared.where("low <> high and sign < 0").groupBy("key", "h").agg(F.bit_or("meta").alias("meta"))


def candidates(shared: DataFrame, t: int) -> DataFrame:
    """The rows of lines that share a key and nearly a sketch with another line."""
    x, y = shared.alias("x"), shared.alias("y")
    differ = F.col("x.meta").bitwiseXOR(F.col("y.meta")).bitwiseAND(F.lit(_SKETCH))
    alike = (F.col("x.h") != F.col("y.h")) & (F.least("x.meta", "y.meta") < 0) & (F.bit_count(differ) <= 2 * t)
    return x.join(y, (F.col("x.key") == F.col("y.key")) & alike, "left_semi").select("x.key", "x.h", "x.meta")


def near_lines(docs: DataFrame, seen: DataFrame, distinct: DataFrame, t: int = DISTANCE, least: int = MIN_CHARS) -> DataFrame:
    """``h, h2, links, drop, root``: parts of each line's number of different lines within ``t`` edits, whether
    one of those is earlier (by ``rep``, then by hash), and edges that connect the lines of a class.

    ``docs`` has long doc_id and text; ``distinct`` is ``h, h2, rep``, a document that has the line.
    No pair is written: the rows are those of the candidates, however many links they have.
    The texts of candidate lines are read from the documents once more, through bitmaps of
    fixed size, so that documents are not shuffled.
    """
    shared = S.materialize(shared_keys(seen, t), "shared_keys")
    rows = S.materialize(candidates(shared, t), "candidates")
    S.discard(shared)
    wanted = S.materialize(distinct.join(rows.select("h").distinct(), "h", "left_semi").select("h", "h2", "rep"), "wanted")

    documents, lines_wanted = S.Bitmap(wanted, "rep"), S.Bitmap(wanted, "h")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set = set()
        for batch in batches:
            batch = batch.filter(pa.array(documents.may_hold(batch.column("doc_id").to_numpy())))
            for part in S.slices(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                lines = Lines(texts, least)
                h = lines.hashes()
                new = _unseen(h, done)
                new, whole = new[lines_wanted.may_hold(h[new])], "".join(texts)
                found = [whole[a:b] for a, b in zip(lines.start[new].tolist(), lines.end[new].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(lines.second()[new].view(np.int64)), pa.array(found, pa.string())], ["h", "h2", "line"])

    texts = docs.mapInArrow(read, "h long, h2 long, line string").join(wanted, ["h", "h2"]).dropDuplicates(["h", "h2"])
    texts = S.materialize(texts, "line_texts")
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "h", "meta")
    grouped = dealt.join(texts, "h").select(*Groups.NAMES).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, n = Groups(t, least), [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 4096:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.flatnonzero(_new_group(table))[-1])  # the last group may go on
                if cut:
                    yield groups(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield groups(pa.Table.from_batches(held).combine_chunks())

    return grouped.mapInArrow(compare, "h long, h2 long, links long, drop boolean, root long")


def repeated(docs: DataFrame, t: int = DISTANCE, least: int = MIN_CHARS, classes: bool = False) -> DataFrame:
    """``doc_id, removed, n_links``: line numbers (from 0) to remove from each document that has any.

    Lines are what stands between line feeds. Of equal lines the first stays: in
    the smallest doc_id, at the first place. A line also goes if an earlier line
    (by the smallest doc_id that has it, then by hash) is within ``t`` edits.
    ``n_links`` sums, over the document's lines, the different lines within ``t``
    edits. Lines under ``least`` characters stay. Null text counts as
    empty; rows with a null doc_id take no part; rows that share a doc_id are
    one document, of which each row keeps its own first occurrences.

    ``classes`` adds ``line_classes``: number and class of the document's lines
    that equal or are linked to others; a class is a connected component of
    links, named by its least line hash.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = S.materialize(occurrences(rows, t, least), "lines")
    distinct = seen.groupBy("h", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    distinct = S.materialize(distinct, "distinct_lines")
    found = S.materialize(near_lines(rows, seen, distinct, t, least), "near_lines")
    near = found.groupBy("h", "h2").agg(F.max("drop").alias("drop"), F.sum("links").alias("links"))
    marks = distinct.join(near, ["h", "h2"], "left").where("n > 1 or links is not null")
    marks = marks.select("h", "h2", "rep", F.coalesce("drop", F.lit(False)).alias("drop"), F.coalesce("links", F.lit(0)).alias("links"))
    if classes:
        roots = graph.components(found.select(F.col("h").alias("u"), F.col("root").alias("v")))
        marks = marks.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("class", F.coalesce("root", "h")).drop("root")
    marked = seen.select("h", "h2", "doc_id", "number", "first").join(S.materialize(marks, "marks"), ["h", "h2"])
    gone = F.col("drop") | (F.col("doc_id") != F.col("rep")) | ~F.col("first")
    out = [F.array_sort(F.collect_set(F.when(gone, F.col("number")))).alias("removed"), F.sum("links").alias("n_links")]
    if classes:
        out.append(F.array_sort(F.collect_set(F.struct("number", F.col("class").alias("class_id")))).alias("line_classes"))
    return marked.groupBy("doc_id").agg(*out)


def without_repeated(docs: DataFrame, t: int = DISTANCE, least: int = MIN_CHARS) -> DataFrame:
    """Pipeline stage: texts without the removed lines; documents of which no line is left go.

    A ``n_chars`` column follows the new text; other columns, whatever their
    names, pass unchanged. Null and empty texts, rows with a null doc_id and
    very long texts are handled as ``repeated`` states; an empty table stays empty.
    The join shuffles at every size: both of its sides grow with the input.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    role = dict(zip(docs.columns, names, strict=True))
    found = repeated(docs, t, least).where(F.size("removed") > 0).select(F.col("doc_id").alias("key"), "removed")
    found = S.materialize(found, "removals")
    joined = docs.toDF(*names).join(found.hint("merge"), F.col(role["doc_id"]) == F.col("key"), "left")
    lines = F.filter(F.split(role["text"], "\n", -1), lambda _, i: ~F.array_contains(F.col("removed"), i))
    whole = F.col("removed").isNull()
    out = joined.withColumn("left", F.when(whole, F.col(role["text"])).otherwise(F.array_join(lines, "\n"))).where(whole | (F.trim("left") != ""))
    made = {"text": F.col("left")}
    if "n_chars" in role:
        made["n_chars"] = F.when(whole, F.col(role["n_chars"])).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return out.select(*[made.get(c, F.col(n)).alias(c) for c, n in role.items()])


def op5_lines(spark, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    found = repeated(docs, classes=True)
    none = F.expr("cast(array() as array<int>)")
    no_class = F.expr("cast(array() as array<struct<number:int,class_id:bigint>>)")
    return (
        docs.select("doc_id", n_lines.cast("long").alias("n_lines"))
        .join(found, "doc_id", "left")
        .select("doc_id", "n_lines", F.coalesce("removed", none).alias("removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("line_classes", no_class).alias("line_classes"))
        .withColumn("n_removed", F.size("removed").cast("long"))
    )
