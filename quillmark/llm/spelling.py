"""Spelling variants of a vocabulary: words one edit apart, found through the halves that the edit leaves whole.

One inserted, deleted or replaced character lies in one half of a word, so the
other half stands unchanged at the same distance from its end of the other word.
Shards of an Aho-Corasick automaton hold the two halves of every word; all words
are scanned, a find counts if the half lies where it must and the lengths fit, and
the distance is verified. A word is scanned by those shards only that can hold one
of its halves. A half that very many words share is halved further: the edit then
lies in one part of what the half leaves open, so groups of like words stay small
however many words begin or end alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import _shared as S

#: Words of a half before it is halved further, scanned words likewise, halves in an automaton, pairs verified at once.
HOT, HOT_ROWS = 256, 16 * 256
SHARD = 65_536
PAIRS = 1_000_000
#: A word's form occurs at least this many times as often.
FACTOR = 10
#: Distinct words counted in a task before they are handed on.
COUNTED = 200_000

#: Between the end of a word and its beginning; between two words.
TURN, STOP = "\0", "\1"


# ------------------------------------------------------------ vocabulary

LEAST = 7
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST)


def thinned(run: bytes, seed: int) -> bytes:
    """``run`` (Latin-1) without one character, where the checksum of id and run says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least: int = 2) -> DataFrame:
    """``word, n``: the words of all whole texts with at least ``LEAST`` characters and ``least`` occurrences.

    Words are maximal runs of the letters A to Z and U+00C0 to U+00FF, of which
    only A to Z are lower-cased; those whose checksum with the document's id is
    divisible by 31 lose one character. Null texts have no words; a null doc_id is
    the empty text in the checksum. Repeated rows count as often as they stand
    there. Only ``doc_id`` and ``text`` are read, so other columns may have any names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in S.slices(batch, "text"):
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = Counter(_RUN.findall((text or "").encode("latin-1", "replace").lower()))
                    seed = zlib.crc32(b"%s:" % ("" if key is None else str(key)).encode())
                    for word, n in found.items():
                        word = thinned(word, seed)
                        if len(word) >= LEAST:
                            total[word] += n
                if len(total) > COUNTED:
                    yield counted()
        if total:
            yield counted()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ------------------------------------------------------------ halves


def _halves(length: str) -> str:
    """The two ways to keep one half of what lies between the first ``p`` and the last ``s`` of ``length`` characters."""
    middle = f"({length} - p - s)"
    halved = f"array(struct(p + {middle} div 2 as p, s as s), struct(p as p, s + {middle} - {middle} div 2 as s))"
    return f"if({middle} >= 2, {halved}, array(struct(p as p, s as s)))"


def halved(entries: DataFrame) -> DataFrame:
    """Entries ``word, n, scanned, p, s`` with one more half kept, and the ``key`` of what they keep.

    A scanned word meets words of its own length and of one character more, so
    each pair is looked for once; it takes the halves of both lengths.
    """
    both = f"array_distinct(concat({_halves('cast(length(word) as bigint)')}, {_halves('cast(length(word) + 1 as bigint)')}))"
    at = F.explode(F.expr(f"if(scanned, {both}, {_halves('cast(length(word) as bigint)')})"))
    rows = entries.select("word", "n", "scanned", at.alias("at")).select("word", "n", "scanned", "at.p", "at.s")
    return rows.withColumn("key", F.expr("xxhash64(right(word, cast(s as int)), left(word, cast(p as int)))"))


def segments(words: DataFrame) -> DataFrame:
    """Entries of all words; keys of more than ``HOT`` words or ``HOT_ROWS`` scans that can be halved are halved."""
    start = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("scanned"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("s"))
    level, done = halved(start), []
    while True:
        level = S.materialize(level, "halves")
        open_ = F.expr("length(word) + cast(scanned as int) - p - s >= 2").cast("int")
        sums = level.groupBy("key").agg(F.sum(open_).alias("rows"), F.sum(F.when(~F.col("scanned"), open_)).alias("held"), F.count(F.when(~F.col("scanned"), 1)).alias("words"))
        hot = S.materialize(sums.where((F.col("words") > 0) & ((F.col("held") > HOT) | (F.col("rows") > HOT_ROWS))).select("key", F.lit(True).alias("hot")), "hot_halves")
        if hot.isEmpty():
            done.append(level)
            break
        told = level.join(hot, "key", "left")
        done.append(told.where("hot is null").select(level.columns))
        level = halved(told.where("hot"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


# ------------------------------------------------------------ automaton


class Texts:
    """Words as one array of code points, with hashes of all their parts."""

    def __init__(self, words: list[str]):
        self.points, offsets = S.code_points(words)
        self.start, self.length = offsets[:-1], np.diff(offsets)
        self.part = S.Rolling(self.points)


class Shard:
    """An automaton over the halves of some words."""

    def __init__(self, words: list[str], n: np.ndarray, p: np.ndarray, s: np.ndarray):
        import ahocorasick

        self.words, self.n, self.p, self.s, self.texts = words, n, p, s, Texts(words)
        halves: dict[str, int] = {}
        own = np.array([halves.setdefault(w[len(w) - b :] + TURN + w[:a], len(halves)) for w, a, b in zip(words, p.tolist(), s.tolist(), strict=True)], np.int64)
        self.order = np.argsort(own, kind="stable")
        self.first = np.searchsorted(own[self.order], np.arange(len(halves) + 1))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for half, k in halves.items():
            self.automaton.add_word(half, k)
        self.automaton.make_automaton()

    def scan(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (word of the shard, scanned word) one edit apart, each by the first halves that the edit leaves whole.

        Each word is read from its beginning to its end and, after a turn, once
        more, so a half at the end, before the turn, and one at the beginning,
        after it, are found together and only where they may stand.
        """
        texts = Texts(words)
        found = np.array(list(self.automaton.iter(STOP.join(w + TURN + w for w in words))), np.int64).reshape(-1, 2)
        ends = np.cumsum(2 * texts.length + 2)  # of each word's two readings, the stop included
        scanned, half = np.searchsorted(ends, found[:, 0], side="right"), found[:, 1]
        sizes = np.diff(self.first)[half]
        block = (np.cumsum(sizes) - sizes) // PAIRS
        for b in np.unique(block):
            at = block == b
            size = sizes[at]
            x = np.repeat(scanned[at], size)
            w = self.order[np.repeat(self.first[half[at]] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            yield self._one_edit(texts, w, x)

    def _one_edit(self, texts: Texts, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine, longer = self.texts, self.texts.length[w] - texts.length[x]
        fits = (longer == 0) | (longer == 1)
        w, x, longer = w[fits], x[fits], longer[fits]
        a, b, n, m = mine.start[w], texts.start[x], mine.length[w], texts.length[x]
        # characters in common at the beginning, by bisection
        low, high = np.zeros(len(w), np.int64), m.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = mine.part(a, a + middle) == texts.part(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        differ = (longer == 1) | (low < m)
        w, x, longer, a, b, n, m, low = (v[differ] for v in (w, x, longer, a, b, n, m, low))
        near = mine.part(a + low + 1, a + n) == texts.part(b + low + 1 - longer, b + m)
        # of two words of one length, both of which are scanned, the greater is the shard's
        theirs = texts.points[np.minimum(b + low, len(texts.points) - 1)] if len(texts.points) else 0
        near &= (longer == 1) | (mine.points[a + low] > theirs)
        near[near] = self._first_way(w[near], low[near])
        return w[near], x[near]

    def _first_way(self, w: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Whether a find is by the halves that are kept if the first half is kept wherever it can be."""
        p, s, n = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), self.texts.length[w]
        goal_p, goal_s = self.p[w], self.s[w]
        open_ = (p < goal_p) | (s < goal_s)
        while open_.any():
            half = (n - p - s) // 2
            left = common >= p + half
            p, s = np.where(open_ & left, p + half, p), np.where(open_ & ~left, n - p - half, s)
            open_ = ((p < goal_p) | (s < goal_s)) & (p <= goal_p) & (s <= goal_s)
        return (p == goal_p) & (s == goal_s)


NEAR = "word string, n_near long, best_n long, best string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each word, from entries sorted by shard, those held before those scanned, and word."""
    held: list[pa.RecordBatch] = []
    shard, last = None, None

    def results(words: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for w, x in shard.scan(words):
            ours, theirs = pa.array(shard.words, pa.string()).take(pa.array(w)), pa.array(words, pa.string()).take(pa.array(x))
            one = pa.array(np.ones(len(w), np.int64))
            for mine, other, count in ((ours, theirs, n[x]), (theirs, ours, shard.n[w])):
                yield pa.RecordBatch.from_arrays([mine, one, pa.array(count), other], [c.split()[0] for c in NEAR.split(", ")])

    number = None
    for batch in batches:
        of, scanned = batch.column("shard").to_numpy(), batch.column("scanned").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((of[1:] != of[:-1]) | (scanned[1:] != scanned[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if of[a] != number:
                number, shard, held, last = of[a], None, [], None
            if not scanned[a]:
                held.append(part)
                continue
            if held:
                table = pa.Table.from_batches(held)
                shard, held = Shard(table.column("word").to_pylist(), *(table.column(c).to_numpy() for c in ("n", "p", "s"))), []
            if shard is None:
                continue
            words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
            new = np.array([w != v for w, v in zip(words, [last, *words[:-1]], strict=True)], bool)
            last = words[-1]
            yield from results([w for w, k in zip(words, new.tolist(), strict=True) if k], n[new])
    S._tidy()


def near(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best``: number of near words, and the nearest form among them, of each word that has any."""
    S.small_batches(words.sparkSession)
    found = segments(words.where(~F.col("word").contains(TURN) & ~F.col("word").contains(STOP)))
    shards = max(1, -(-found.where(~F.col("scanned")).count() // SHARD))
    rows = found.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).select("shard", "scanned", "word", "n", "p", "s")
    pairs = rows.repartition(shards, "shard").sortWithinPartitions("shard", "scanned", "word").mapInArrow(_scan, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("form"))).alias("best")
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.form").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the end of the chain of forms, by doubling steps.

    Each form is ``FACTOR`` times as frequent as its word, so a chain is no longer
    than the decimal digits of the greatest count, and it never closes.
    """
    steps = S.materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("end"))
        told = S.materialize(steps.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "forms")
        if told.where("moved").isEmpty():
            return told.select("word", "root")
        steps = told.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of the distinct ``word``s with their counts ``n``.

    Near words differ by exactly one inserted, deleted or replaced character. The
    form is the near word of largest count, of several the smallest, if it occurs
    at least ``FACTOR`` times as often; the root is the end of the chain of forms.
    A null word is near no word, nor is one that holds U+0000 or U+0001; the empty
    word is near all words of one character. Very long words take part like any.
    An empty table gives no rows. Other columns are left out.
    """
    words = S.materialize(words.select("word", "n"), "vocabulary")
    all_ = words.join(near(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best_n") >= FACTOR * F.col("n"), F.struct("best", "best_n")).alias("f"))
    told = S.materialize(all_.select("word", F.col("f.best").alias("form"), "n", "n_near", F.col("f.best_n").alias("form_n")), "variants")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(S.read(spark, sf_dir, "documents")))


#: The checksum goes bit by bit; near words of one length share what is left without one place, others one's deletion.
ORACLE = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 7 GROUP BY ALL
), bits AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128
    THEN [ord(c), 0, 0, 0, 0, 0, 0, 0] ELSE [195, 0, 0, 0, 0, 0, 0, 0, ord(c) - 64, 0, 0, 0, 0, 0, 0, 0] END)) AS steps FROM lowered
), sums AS (
  SELECT run, n, xor(list_reduce(list_transform(list_prepend(4294967295, steps), lambda v: v::BIGINT),
    lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)), 4294967295) AS h FROM bits
), thinned AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM sums
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS k FROM words)
), pairs AS (
  SELECT DISTINCT a.word AS word, b.word AS other FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT p.word, count(*) AS n_near, min({'n': -w.n, 'form': p.other}) AS best FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word
), told AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best.n >= 10 * w.n THEN b.best.form END AS form,
    CASE WHEN -b.best.n >= 10 * w.n THEN -b.best.n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
  SELECT word, word AS root FROM told UNION ALL SELECT c.word, t.form FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NULL
)
SELECT t.word, t.form, e.root, t.n, t.n_near, t.form_n FROM told t JOIN ends e ON e.word = t.word
"""
