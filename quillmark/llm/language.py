"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3
characters, words padded with one space). A document gets the language whose
profile has the smallest out-of-place distance to the document's own list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import _shared as S

#: N-grams kept in a profile and taken from a document.
PROFILE = 400
#: Labelled rows per language that a profile is fitted on, about: the only bound in this operator.
SAMPLE_PER_LANGUAGE = 2000
UNDETERMINED = "und"
_SPACE = 32


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as integers (three code points of 21 bits) and their counts."""
    points, _ = S.code_points([text.lower()])
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = S.classes()[points] == S.LETTER
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = np.where(letter, points, _SPACE).astype(np.int64)
    keep = letter | np.concatenate(([True], letter[:-1]))  # one space for each run of others
    c = np.concatenate(([_SPACE], kept[keep], [_SPACE]))
    c = c[np.concatenate(([True], (c[1:] != _SPACE) | (c[:-1] != _SPACE)))]
    one, two = c[c != _SPACE], (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    three = three[c[1:-1] != _SPACE]  # none that reaches across words
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    return grams[np.lexsort((grams, -counts))[:most]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of every profile n-gram in every language; ``PROFILE`` where it has none."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def of(lists: dict[str, np.ndarray]) -> Profiles:
        names = tuple(sorted(lists))
        grams = np.unique(np.concatenate([lists[n] for n in names])) if names else np.zeros(0, np.int64)
        ranks = np.full((len(grams), len(names)), PROFILE, np.int32)
        for k, n in enumerate(names):
            ranks[np.searchsorted(grams, lists[n]), k] = np.arange(len(lists[n]))
        return Profiles(names, grams, ranks)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the share of the worst distance that the document stays below."""
        grams, counts = gram_counts(text or "")
        if not len(grams) or not self.languages:
            return UNDETERMINED, 0.0
        own = ranked(grams, counts)
        out = np.full((len(own), len(self.languages)), PROFILE, np.int64)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            found = np.flatnonzero(self.grams[at] == own)
            ranks = self.ranks[at[found]].astype(np.int64)
            out[found] = np.where(ranks == PROFILE, PROFILE, np.abs(ranks - found[:, None]))
        distance = out.sum(0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (PROFILE * len(own))


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles from the columns ``text`` and ``lang`` of ``labelled``.

    Fitted on about ``per_language`` rows of each language, chosen by the hash
    of the text; rows with null in either column take no part.
    """
    rows = labelled.select(F.col("text").alias("text"), F.col("lang").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = {k: per_language / n for k, n in sizes.items() if n > per_language}
    if share:
        limit = F.element_at(F.create_map([F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
        draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
        rows = rows.where(draw < F.coalesce(limit, F.lit(1.0)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
            parts = parts + ([sums[lang]] if lang in sums else [])
            grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums[lang] = grams, np.bincount(where, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)

        for batch in batches:
            for part in S.slices(batch, "text"):
                new: dict[str, list] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    new.setdefault(lang, []).append(gram_counts(text))
                for lang, parts in new.items():
                    add(lang, parts)
        for lang, (grams, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    from pyspark.sql import Window

    sums = rows.mapInArrow(partial, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("r", rank).where(F.col("r") <= PROFILE).collect()  # PROFILE rows a language
    lists: dict[str, list] = {k: [] for k in sizes}
    for row in sorted(top, key=lambda row: row["r"]):
        lists[row["lang"]].append(row["gram"])
    return Profiles.of({k: np.array(v, np.int64) for k, v in lists.items()})


def predict(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with ``lang_pred`` and ``score``; ``text`` is read whole.

    Null or letterless text: ``und``, 0. Equal distances: the smaller language name.
    """
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, "text"):
                found = [profiles.predict(t) for t in part.column("text").to_pylist()]
                arrays = [part.column(c) for c in keep]
                arrays += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score"])

    schema = source.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return source.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    return docs.where(S.crc_mod("doc_id", 5) != 0)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents")
    profiles = fit(training_rows(docs))
    ids = docs.select("doc_id", "text", (S.crc_mod("doc_id", 5) == 0).alias("held_out"))
    return predict(ids, profiles, ["doc_id", "held_out"])


def keep_determined(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Pipeline stage: drop the rows whose text has no letters or nothing in common with any profile.

    Columns, whatever their names, pass unchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, "text"):
                keep = [profiles.predict(t)[1] > 0 for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
