"""Archive search: the channels of a mode, fused by reciprocal rank into explained, addressable hits."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import fuzzy, lexical, semantic


class Mode(StrEnum):
    INTELLIGENT = "intelligent"
    EXACT = "exakt"
    NAMES = "namen"
    MEANING = "bedeutung"


@dataclass(frozen=True)
class Query:
    """A search request; the bounds are those of the archive's interface."""

    text: str
    mode: Mode = Mode.INTELLIGENT
    fuzziness: float = 0.72
    year_from: int | None = None
    year_to: int | None = None
    document_id: str | None = None
    limit: int = 50

    def __post_init__(self) -> None:
        if not self.text or not 0 <= self.fuzziness <= 1 or not 1 <= self.limit <= 500:
            raise ValueError("a query needs text, fuzziness within 0..1 and a limit within 1..500")
        object.__setattr__(self, "mode", Mode(self.mode))


@dataclass
class Archive:
    """Tables of an archive. ``lines`` carries line_id, document_id, page_index, bbox, text, normalized,
    confidence and maybe alternatives; ``documents`` document_id, title, year; ``index`` and ``sizes``
    are its postings and lengths, where they are stored."""

    lines: DataFrame
    documents: DataFrame
    index: DataFrame | None = None
    sizes: DataFrame | None = None
    aliases: DataFrame | None = None
    vectors: DataFrame | None = None

    def lexical(self, query: str, exact: bool, cap: int) -> DataFrame | None:
        """By the stored postings, or over the lines themselves, where none are stored."""
        if self.index is None:
            return lexical.search_lines(self.lines, query, exact, cap)
        return lexical.search(self.index, self.sizes if self.sizes is not None else lexical.lengths(self.lines), query, exact, cap)


#: Rank offset, and each channel's weights for rank and raw score.
OFFSET = 60
LEXICAL, FUZZY, SEMANTIC = (1.0, 0.02), (0.72, 0.72 * 0.02), (0.82, 0.012)
SIMILAR = "inhaltlich ähnlicher Begriff"


def fuse(channels: list[DataFrame]) -> DataFrame:
    """line_id, score, reason, matched_form, seq from rows (line_id, raw, rank, weight, raw_weight, priority, channel, reason, matched_form)."""
    rows = channels[0]
    for c in channels[1:]:
        rows = rows.unionByName(c)
    part = F.col("weight") / (OFFSET + F.col("rank")) + F.greatest("raw", F.lit(0.0)) * F.col("raw_weight")
    detail = F.max_by(F.struct("reason", "matched_form"), "priority")
    return rows.groupBy("line_id").agg(F.sum(part).alias("score"), detail.alias("d"), F.min(F.struct("channel", "rank")).alias("seq")).select("line_id", "score", "d.reason", "d.matched_form", "seq")


def _channel(hits: DataFrame, weights: tuple[float, float], order: int, priority, reason, matched) -> DataFrame:
    return hits.select(
        "line_id", F.col("raw").cast("double").alias("raw"), F.col("rank").cast("int").alias("rank"), F.lit(weights[0]).alias("weight"), F.lit(weights[1]).alias("raw_weight"),
        F.lit(order).alias("channel"), priority.cast("int").alias("priority"), reason.alias("reason"), matched.alias("matched_form"),
    )


def lexical_channel(archive: Archive, query: Query) -> DataFrame | None:
    exact = query.mode == Mode.EXACT
    found = archive.lexical(query.text, exact, max(200, 4 * query.limit))
    return found and _channel(found, LEXICAL, 0, F.lit(2), F.lit("exakter Texttreffer" if exact else "Volltexttreffer"), F.lit(query.text))


def fuzzy_channel(archive: Archive, query: Query, candidate_cap: int | None) -> DataFrame | None:
    names = query.mode == Mode.NAMES
    found = fuzzy.search(archive.lines, query.text, query.fuzziness, names, max(200, 4 * query.limit), archive.aliases, candidate_cap)
    wins = F.when((F.col("reason") == fuzzy.SOUNDS) & F.lit(names), 3).otherwise(1)
    return found and _channel(found, FUZZY, 1, wins, F.col("reason"), F.col("matched_form"))


def semantic_channel(archive: Archive, query: Query, vector: list[float]) -> DataFrame:
    found = semantic.search(archive.vectors, vector, max(100, 2 * query.limit))
    return _channel(found, SEMANTIC, 2, F.lit(0), F.lit(SIMILAR), F.lit(query.text))


def assemble(archive: Archive, fused: DataFrame, query: Query) -> DataFrame:
    """Hits in their page and document, filtered after the channels' caps, best first."""
    lines = archive.lines.select("line_id", "document_id", "page_index", "bbox", "text", "confidence")
    hits = fused.join(lines, "line_id").join(archive.documents.select("document_id", "title", "year"), "document_id")
    if query.document_id is not None:
        hits = hits.where(F.col("document_id") == query.document_id)
    if query.year_from is not None:
        hits = hits.where(F.col("year") >= query.year_from)
    if query.year_to is not None:
        hits = hits.where(F.col("year") <= query.year_to)
    final = hits.withColumn("score", F.least(F.lit(1.0), 20 * F.col("score")))
    ordered = final.orderBy(F.desc("score"), F.desc("confidence"), "seq", "line_id").limit(query.limit)
    return ordered.select("line_id", "document_id", F.col("title").alias("document_title"), "page_index", "bbox", "text", "matched_form", "reason", "score", "confidence", "year")


def search(archive: Archive, query: Query, vector: list[float] | None = None, candidate_cap: int | None = None, prefilter: bool = False) -> DataFrame:
    """Hits of one query as a lazy plan. ``candidate_cap`` is that of fuzzy.search. ``prefilter`` moves the filters before the caps, where the answer may differ."""
    if prefilter and (query.document_id or query.year_from or query.year_to):
        keep = archive.documents
        keep = keep.where(F.col("document_id") == query.document_id) if query.document_id else keep
        keep = keep.where(F.col("year") >= query.year_from) if query.year_from else keep
        keep = keep.where(F.col("year") <= query.year_to) if query.year_to else keep
        archive = Archive(archive.lines.join(keep.select("document_id"), "document_id", "left_semi"), archive.documents, aliases=archive.aliases, vectors=archive.vectors)
    channels = [lexical_channel(archive, query)]
    if query.mode in (Mode.INTELLIGENT, Mode.NAMES):
        channels.append(fuzzy_channel(archive, query, candidate_cap))
    if query.mode in (Mode.INTELLIGENT, Mode.MEANING) and archive.vectors is not None and vector is not None:
        channels.append(semantic_channel(archive, query, vector))
    channels = [c for c in channels if c is not None]
    if not channels:
        empty = archive.lines.limit(0).select("line_id", F.lit(0.0).alias("score"), F.lit("").alias("reason"), F.lit("").alias("matched_form"), F.struct(F.lit(0).alias("channel"), F.lit(0).alias("rank")).alias("seq"))
        return assemble(archive, empty, query)
    return assemble(archive, fuse(channels), query)
