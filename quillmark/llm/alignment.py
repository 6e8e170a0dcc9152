"""Tokens of one tokenizer laid against those of another, over the bytes that both cut up.

The tokens of B are a static index of intervals: their ends, in order. Two
bisections per token of A find the B tokens it overlaps, its links. Gaps between
B tokens that no token of A spans are the boundaries of groups.

Both tokenizers cut before a space that follows a visible character, so texts are
cut there into atoms, and each distinct atom is encoded and aligned once. How often
two ids are linked is counted over the whole corpus. The pairs linked most, a
number with a fixed bound, are broadcast; links of all others are joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import _shared as S
from quillmark.llm.tokens import ranks

#: Pairs that are broadcast at most, atoms remembered in a worker, pairs counted before they are handed on.
TABLE = 500_000
CACHE = 200_000
COUNTED = 2_000_000
#: Atoms encoded as one text.
GROUP = 64
_CUT, _JOINED = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")

U64 = S.U64


class Links(NamedTuple):
    """For each A token the B tokens ``first`` to ``last`` (excluded) that it overlaps; for each group its ends among both."""

    first: np.ndarray
    last: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> Links:
    """Links and groups of two sequences of tokens that cover the same bytes; given are the offsets at which tokens end."""
    if not len(a_ends):
        return Links(*(np.zeros(0, np.int64),) * 4)
    a_starts, b_starts = np.concatenate(([0], a_ends[:-1])), np.concatenate(([0], b_ends[:-1]))
    first = np.searchsorted(b_ends, a_starts, side="right")
    last = np.searchsorted(b_starts, a_ends, side="left")
    # an A token spans the gaps after its B tokens, but for the last one's
    spans = np.cumsum(np.bincount(first, minlength=len(b_ends)) - np.bincount(last - 1, minlength=len(b_ends)))
    b_end = np.flatnonzero(spans == 0) + 1
    return Links(first, last, np.searchsorted(a_ends, b_ends[b_end - 1], side="left") + 1, b_end)


class Tokenizers:
    """A byte-level vocabulary file and a piece model with byte fallback, by the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        words = ranks(a_path)
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words, special_tokens={})
        self.a_sizes = np.zeros(max(words.values()) + 1, np.int64)
        for word, k in words.items():
            self.a_sizes[k] = len(word)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(p.rstrip("▁").find("▁", len(p) - len(p.lstrip("▁"))) >= 0 or (p.endswith("▁") and p.strip("▁")) for p in pieces):
            raise ValueError("pieces of this model reach over a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.digits = [str(k) for k in range(max(len(self.a_sizes), len(pieces)))]
        one = self.b.encode("x")
        self.b_space = self.b.encode("x ")[len(one) :]

    def one_by_one(self, atoms: list[str]) -> tuple[np.ndarray, ...]:
        """Which atoms both render as they stand, their ids of A and numbers of them, their ids of B and numbers of them."""
        of_b = [x if atom else self.b_space for atom, x in zip(atoms, self.b.encode(atoms, num_threads=1), strict=True)]
        fine = [b"".join([self.b_bytes[k] for k in ids]) == b" " + atom.encode() for ids, atom in zip(of_b, atoms, strict=True)]
        of_a = [self.a.encode_ordinary(" " + w) if ok else [] for w, ok in zip(atoms, fine, strict=True)]
        of_b = [x if ok else [] for x, ok in zip(of_b, fine, strict=True)]
        flat = lambda lists: np.fromiter(chain.from_iterable(lists), np.int64)
        return np.array(fine, bool), flat(of_a), np.array([len(x) for x in of_a], np.int64), flat(of_b), np.array([len(x) for x in of_b], np.int64)

    def together(self, atoms: list[str]) -> tuple[np.ndarray, ...]:
        """The same, read in groups, which both tokenizers cut between the atoms; one that ends with white space ends a group."""
        groups, at = [], 0
        ends = [k + 1 for k, w in enumerate(atoms) if not w or w[-1].isspace()] + [len(atoms)]
        for end in ends:
            groups += [" ".join(atoms[k : min(k + GROUP, end)]) for k in range(at, end, GROUP)]
            at = end
        of_b = [x if g else self.b_space for g, x in zip(groups, self.b.encode(groups, num_threads=1), strict=True)]
        ids = list(chain.from_iterable(of_b))
        raw = [w.encode() for w in atoms]
        if b"".join(map(self.b_bytes.__getitem__, ids)) != b" " + b" ".join(raw):
            return self.one_by_one(atoms)
        a = np.fromiter(chain.from_iterable([self.a.encode_ordinary(" " + g) for g in groups]), np.int64)
        b, ends = np.array(ids, np.int64), np.cumsum([len(w) + 1 for w in raw])
        count = lambda sizes: np.diff(np.searchsorted(np.cumsum(sizes), ends, side="right"), prepend=0)
        return np.ones(len(atoms), bool), a, count(self.a_sizes[a]), b, count(self.b_sizes[b])


def atoms(text: str) -> list[str]:
    """The parts that begin at a space after a visible character, without that space; ``text`` begins with a space."""
    if not _JOINED.search(text):
        return text.split(" ")[1:]
    return [a[1:] for a in _CUT.split(text)]


#: Columns of an atom's numbers.
VALID, N_A, N_B, N_GROUPS, N_LINKS, N_BEST, COUNT, REST = range(8)


class Numbers(dict):
    """Atoms and their numbers; a new one gets the next and is noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, atom: str) -> int:
        n = self[atom] = len(self)
        self.new.append(atom)
        return n


class Aligner:
    """What is known of each distinct atom; one instance in each worker process."""

    _latest: tuple = (None, None)

    @classmethod
    def of(cls, a_path: str, b_path: str, wants: str, table: tuple = ()) -> Aligner:
        """The worker's aligner for two paths and what is wanted: ``pairs``, ``ids`` or a version of ``table``; only the latest is kept."""
        key = a_path, b_path, wants
        if cls._latest[0] != key:
            cls._latest = key, cls(*key, table)
        return cls._latest[1]

    def __init__(self, a_path: str, b_path: str, wants: str, table: tuple = ()):
        self.tools, self.wants, self.table = Tokenizers(a_path, b_path), wants, table
        #: Called before what is known is given up.
        self.on_forget: Callable[[], None] | None = None
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.numbers = np.zeros((CACHE, 8), np.int64)
        self.pairs: list[np.ndarray] = []
        self.unknown: dict[int, np.ndarray] = {}
        self.groups: list[str] = []
        self.ids: list[tuple] = []

    def codes(self, words: list[str]) -> np.ndarray:
        """A number for each atom; unknown ones are aligned."""
        if len(self.known) > CACHE:
            if self.on_forget:
                self.on_forget()
            self.forget()
        base = len(self.known)
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self._learn(self.known.new, base)
            self.known.new = []
        return codes

    def _learn(self, new: list[str], base: int) -> None:
        tools = self.tools
        if base + len(new) > len(self.numbers):
            self.numbers = np.concatenate((self.numbers, np.zeros((base + len(new) - len(self.numbers), 8), np.int64)))
        fine, a, n_a, b, n_b = tools.together(new)
        links = align(np.cumsum(tools.a_sizes[a]), np.cumsum(tools.b_sizes[b]))
        size = links.last - links.first
        ends = np.cumsum(size)
        other = np.repeat(links.first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        pair = (np.repeat(a, size).astype(U64) << U64(32)) | b[other].astype(U64)
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        pair_end = np.concatenate(([0], ends))[to_a]
        group_end = np.searchsorted(links.a_end, to_a, side="right")
        out = self.numbers[base : base + len(new)]
        out[:, VALID], out[:, N_A], out[:, N_B] = fine, n_a, n_b
        out[:, N_GROUPS], out[:, N_LINKS] = np.diff(group_end, prepend=0), np.diff(pair_end, prepend=0)
        if self.wants == "pairs":
            self.pairs.append(pair)
        elif self.wants == "ids":
            ga, gb = np.diff(links.a_end, prepend=0), np.diff(links.b_end, prepend=0)
            at = lambda x: zip([0, *x.tolist()], x.tolist(), strict=False)
            self.ids += [(a[i:j], b[k:m], ga[x:y], gb[x:y]) for (i, j), (k, m), (x, y) in zip(at(to_a), at(to_b), at(group_end), strict=True)]
        else:
            keys, counts, best = self.table
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            for column, value in ((COUNT, counts), (N_BEST, best), (REST, None)):
                each = ~hit if value is None else np.where(hit, value[at], 0) if len(keys) else np.zeros(len(pair), np.int64)
                out[:, column] = np.diff(np.concatenate(([0], np.cumsum(each)))[pair_end], prepend=0)
            begin = np.concatenate(([0], pair_end))
            for k in np.flatnonzero(out[:, REST]).tolist():
                self.unknown[base + k] = pair[begin[k] : pair_end[k]][~hit[begin[k] : pair_end[k]]]
            self._write(a, b, links, group_end)

    def _write(self, a: np.ndarray, b: np.ndarray, links: Links, group_end: np.ndarray) -> None:
        """Adds each atom's groups as text."""
        digits = self.tools.digits
        text_a, text_b = [digits[k] for k in a.tolist()], [digits[k] for k in b.tolist()]
        ga, gb = links.a_end.tolist(), links.b_end.tolist()
        groups = [
            f"{text_a[i]}|{text_b[k]}" if j - i == 1 == m - k else ",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m])
            for i, j, k, m in zip([0, *ga], ga, [0, *gb], gb, strict=False)
        ]
        ends = group_end.tolist()
        self.groups += [groups[x] if y - x == 1 else ";".join(groups[x:y]) for x, y in zip([0, *ends], ends, strict=False)]


def windows(texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
    """Lists of (number of the text, atoms) of about ``CHUNK_CHARS`` characters; a longer text is cut between atoms."""
    held: list[tuple[int, list[str]]] = []
    size = 0
    for k, text in enumerate(texts):
        if not text:
            continue
        text, at = " " + text, 0
        while at < len(text):
            cut = _CUT.search(text, at + S.CHUNK_CHARS) if len(text) - at > S.CHUNK_CHARS else None
            end = cut.start() if cut else len(text)
            held.append((k, atoms(text[at:end])))
            size, at = size + end - at, end
            if size >= S.CHUNK_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _numbered(aligner: Aligner, window: list[tuple[int, list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all atoms of a window, where each text's begin, and the texts' numbers."""
    sizes = np.array([len(words) for _, words in window], np.int64)
    return aligner.codes([w for _, words in window for w in words]), np.cumsum(sizes) - sizes, np.array([k for k, _ in window], np.int64)


def _valid(aligner: Aligner, texts: list[str | None]) -> tuple[Iterable, np.ndarray]:
    """The windows of texts, to be read once, and which texts both tokenizers render as they stand."""
    ok = np.array([bool(t) for t in texts], bool)
    first = list(islice(windows(texts), 2))
    for window in first if len(first) < 2 else windows(texts):
        codes, at, of = _numbered(aligner, window)
        ok[of] &= np.minimum.reduceat(aligner.numbers[codes, VALID], at).astype(bool)
    return first if len(first) < 2 else windows(texts), ok


class Counted:
    """Links of pairs of ids: texts add how often atoms occur, and atoms become pairs when they are given up."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.keys, self.counts = aligner, np.zeros(0, U64), np.zeros(0, np.int64)
        self.times = np.zeros(CACHE, np.int64)
        aligner.on_forget = self.settle

    def add(self, codes: np.ndarray) -> None:
        if len(codes):
            times = np.bincount(codes)
            self._room(len(times))
            self.times[: len(times)] += times

    def _room(self, n: int) -> None:
        if n > len(self.times):
            self.times = np.concatenate((self.times, np.zeros(n - len(self.times), np.int64)))

    def settle(self) -> None:
        n = len(self.aligner.known)
        if n:
            self._room(n)
            keys = np.concatenate((self.keys, *self.aligner.pairs))
            counts = np.concatenate((self.counts, np.repeat(self.times[:n], self.aligner.numbers[:n, N_LINKS])))
            used = counts > 0
            self.keys, where = np.unique(keys[used], return_inverse=True)
            self.counts = np.bincount(where, counts[used], len(self.keys)).astype(np.int64)
            self.times = np.zeros(CACHE, np.int64)

    def taken(self) -> pa.RecordBatch:
        keys, counts = self.keys, self.counts
        self.keys, self.counts = keys[:0], counts[:0]
        return pa.RecordBatch.from_arrays([pa.array((keys >> U64(32)).astype(np.int64)), pa.array((keys & U64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts)], ["a", "b", "n"])


def translation(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a, b, n, best``: how many links of all ``text``s join two ids, and whether no A id is linked to that B id more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a_path, b_path, "pairs")
        counted = Counted(aligner)
        for batch in batches:
            for part in S.slices(batch, "text"):
                texts = part.column("text").to_pylist()
                whole, ok = _valid(aligner, texts)
                for window in whole:
                    codes, at, of = _numbered(aligner, window)
                    counted.add(codes if ok[of].all() else codes[np.repeat(ok[of], np.diff(at, append=len(codes)))])
                if len(counted.keys) > COUNTED:
                    yield counted.taken()
        counted.settle()
        aligner.on_forget = None
        yield counted.taken()

    found = docs.select("text").mapInArrow(run, "a long, b long, n long")
    pairs = S.materialize(found.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))  # no more rows than B has ids
    return S.materialize(pairs.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "translation")


def most_linked(pairs: DataFrame, limit: int = TABLE) -> tuple[int, DataFrame]:
    """A count from which on there are no more than ``limit`` pairs, and those pairs.

    Counts are told apart by their four leading binary digits, so their histogram is small whatever the corpus.
    """
    step = F.expr("cast(shiftleft(shiftright(n, greatest(length(bin(n)) - 4, 0)), greatest(length(bin(n)) - 4, 0)) as bigint)")
    sizes = sorted(((r["step"], r["k"]) for r in pairs.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = (sizes[0][0] * 2 if sizes else 1), 0
    for value, k in sizes:
        total += k
        if total > limit:
            break
        least = value
    return least, pairs.where(F.col("n") >= least)


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
DIGEST = "row long, doc_id long, " + "".join(f"{c} long, " for c in NUMBERS) + "groups_sha256 string, rest_pairs array<long>, rest_n array<long>"


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id``, numbers of tokens, groups and links, of links to the B id's most linked A id, the sum of their
    pairs' counts over the corpus, and the SHA-256 of the groups.

    Texts that are null or empty, and texts that B does not render as they stand,
    have no tokens: zeros and an empty hash; they count nowhere. Rows that share a
    doc_id, equal rows and rows with a null doc_id are digested and counted each
    for itself. Very long texts are read in windows between atoms. An empty table
    gives no rows. Only ``doc_id`` and ``text`` are read, so other columns may have any names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = translation(docs, a_path, b_path)
    least, most = most_linked(pairs)
    top = most.select((F.col("a") * F.lit(1 << 32) + F.col("b")).alias("key"), "n", F.col("best").cast("long").alias("best")).toArrow()
    keys = top.column("key").to_numpy().astype(U64)
    order = np.argsort(keys)
    table = docs.sparkSession.sparkContext.broadcast((keys[order], top.column("n").to_numpy()[order], top.column("best").to_numpy()[order]))
    version = hashlib.sha256(b"".join(x.tobytes() for x in (keys, top.column("n").to_numpy()))).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a_path, b_path, version, table.value)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in S.slices(batch, "text"):
                texts = part.column("text").to_pylist()
                sums = np.zeros((len(texts), 8), np.int64)
                sums[:, VALID] = [bool(t) for t in texts]
                hashes, rest = [None] * len(texts), [[] for _ in texts]
                for window in windows(texts):
                    codes, at, of = _numbered(aligner, window)
                    found = aligner.numbers[codes]
                    sums[of, 1:] += np.add.reduceat(found, at)[:, 1:]
                    sums[of, VALID] &= np.minimum.reduceat(found[:, VALID], at)
                    open_, listed, groups, unknown = found[:, REST] > 0, codes.tolist(), aligner.groups, aligner.unknown
                    for k, a, b in zip(of.tolist(), at.tolist(), [*at[1:].tolist(), len(codes)], strict=True):
                        if not sums[k, VALID]:
                            continue
                        text = ";".join([groups[c] for c in listed[a:b]])
                        if hashes[k] is None:
                            hashes[k] = hashlib.sha256(text.encode())
                        else:
                            hashes[k].update(b";" + text.encode())
                        rest[k] += [unknown[c] for c in codes[a:b][open_[a:b]].tolist()]
                ok = sums[:, VALID] > 0
                sums[~ok] = 0
                left = [np.unique(np.concatenate(r), return_counts=True) if r and fine else ((), ()) for r, fine in zip(rest, ok.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(texts))), part.column("doc_id"), *(pa.array(sums[:, c]) for c in range(1, 7)),
                     pa.array([h.hexdigest() if h and fine else "" for h, fine in zip(hashes, ok.tolist(), strict=True)], pa.string()),
                     pa.array([np.asarray(k, U64).astype(np.int64) for k, _ in left], pa.list_(pa.int64())), pa.array([np.asarray(n, np.int64) for _, n in left], pa.list_(pa.int64()))],
                    [c.split()[0] for c in DIGEST.split(", ")],
                )
                row += len(texts)

    told = S.materialize(docs.mapInArrow(run, DIGEST), "digests")
    open_ = told.select("row", F.explode(F.arrays_zip("rest_pairs", "rest_n")).alias("r")).select("row", F.shiftright("r.rest_pairs", 32).alias("a"), F.col("r.rest_pairs").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), F.col("r.rest_n").alias("m"))
    rare = pairs.where(F.col("n") < least)
    more = open_.join(rare, ["a", "b"]).groupBy("row").agg(F.sum(F.col("m") * F.col("n")).alias("more_count"), F.sum(F.col("m") * F.col("best").cast("long")).alias("more_best"))
    whole = told.join(more, "row", "left")
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_count", F.lit(0))}
    return whole.select("doc_id", *(added.get(c, F.col(c)).alias(c) for c in NUMBERS), "groups_sha256")


GROUPS = "doc_id long, a array<int>, b array<int>, a_sizes array<int>, b_sizes array<int>"


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id``, the ids of both tokenizers, and of each group how many of either it takes, in order; cases as in ``digests``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a_path, b_path, "ids")
        for batch in batches:
            for part in S.slices(batch, "text"):
                texts = part.column("text").to_pylist()
                parts, ok = [([], [], [], []) for _ in texts], [bool(t) for t in texts]
                for window in windows(texts):
                    codes, at, of = _numbered(aligner, window)
                    for k, a, b in zip(of.tolist(), at.tolist(), [*at[1:].tolist(), len(codes)], strict=True):
                        ok[k] = ok[k] and bool(aligner.numbers[codes[a:b], VALID].all())
                        for c in codes[a:b].tolist():
                            for held, more in zip(parts[k], aligner.ids[c], strict=True):
                                held += more.tolist()
                columns = [pa.array([p[c] if fine else [] for p, fine in zip(parts, ok, strict=True)], pa.list_(pa.int32())) for c in range(4)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], [c.split()[0] for c in GROUPS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, GROUPS)


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(S.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
