"""Spatial merge of the readings of a page: other candidates' lines replace, extend or annotate the best one's.

Every line sees what earlier ones changed, so a page is one sequential group;
a page's size is bounded by its paper.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import _shared as S

SCHEMA = (
    "page string, text string, model string, confidence double, x1 int, y1 int, x2 int, y2 int, "
    "alternatives array<struct<text:string,model:string,confidence:double>>, page_model string, line_order int"
)
#: Recognizers that may add lines or replace texts, and the thresholds for it.
ENGINES, BY_LINE = ("tesseract:", "tesseract-line:"), "tesseract-line:"
USEFUL = frozenset("äöüÄÖÜß.,;:!?-–—()[]'\"/")


@lru_cache(4096)  # the same few texts are weighed again and again
def language_quality(text: str) -> float:
    if not text.strip():
        return 0.0
    useful = sum(c.isalnum() or c in USEFUL for c in text) / len(text)
    return max(0.0, min(1.0, useful - 0.03 * sum(text.count(c * 4) for c in set(text))))


@dataclass
class Line:
    text: str
    model: str
    confidence: float
    box: tuple[int, int, int, int]
    alternatives: list[dict]

    @property
    def middle(self) -> float:
        return (self.box[1] + self.box[3]) / 2

    @property
    def height(self) -> int:
        return self.box[3] - self.box[1]

    @property
    def worth(self) -> float:
        return 0.65 * self.confidence + 0.20 * language_quality(self.text) + 0.15 * min(len(self.text) / 45, 1.0)

    def reading(self, model: str | None = None) -> dict:
        return {"text": self.text, "model": model or self.model, "confidence": self.confidence}


def _nearest(lines: list[Line], other: Line) -> Line | None:
    middle, height, found, least = other.middle, other.height, None, 0.0
    for x in lines:
        _, top, _, bottom = x.box
        away = abs((top + bottom) / 2 - middle)
        if away <= max(bottom - top, height) and (found is None or away < least):
            found, least = x, away
    return found


def _better(now: Line, other: Line, engine: str) -> bool:
    """Whether the other reading takes the line's place."""
    if not engine.startswith(ENGINES) or len(other.text) < max(3, 0.70 * len(now.text)):
        return False
    sure = engine.startswith(BY_LINE) and other.confidence >= 0.78 and language_quality(other.text) >= 0.90
    return sure or other.worth >= now.worth + 0.12


def merged(best: list[Line], model: str, others: list[tuple[str, list[Line]]]) -> tuple[list[Line], str]:
    """The best candidate's lines after all others, in the order given, and the page's model name."""
    used = {model}
    for engine, lines in others:
        for other in lines:
            now = _nearest(best, other)
            if now is None:
                if engine.startswith(ENGINES) and other.confidence >= 0.65 and len(other.text.strip()) >= 2:
                    best.append(Line(other.text, other.model, other.confidence, other.box, list(other.alternatives)))
                    used.add(engine)
            elif now.text != other.text and len(now.alternatives) < 3:
                if _better(now, other, engine):
                    now.alternatives.append(now.reading())
                    now.text, now.model, now.confidence, now.box = other.text, other.model, other.confidence, other.box
                    used.add(engine)
                else:
                    now.alternatives.append(other.reading(engine))
    best.sort(key=lambda x: (x.box[1], x.box[0]))
    return best, model if len(used) == 1 else "ensemble:" + "+".join(sorted(used))


READING = ("rank", "candidate", "line_order", "text", "model", "confidence", "x1", "y1", "x2", "y2")


def merge(lines: DataFrame) -> DataFrame:
    """One merged set of lines for each page.

    ``lines`` has page, rank (of the candidate, 0 the best), candidate (its model), line_order, text,
    model, confidence, x1, y1, x2, y2. Pages that come whole, as rows of page and readings (an array of
    structs of the others), are not exchanged.
    """
    S.small_batches(lines.sparkSession)
    if "readings" in lines.columns:
        pages = lines.select("page", "readings")
    else:
        pages = lines.groupBy("page").agg(F.collect_list(F.struct(*READING)).alias("readings"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES):
                yield from _merged_pages(whole.slice(at, PAGES))

    return pages.mapInArrow(run, SCHEMA)


#: Pages handled at once; bounds memory.
PAGES = 100


def _merged_pages(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    readings = batch.column("readings")
    ends = np.cumsum(readings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    flat = readings.flatten()
    rank, candidate, place, text, model, confidence, *box = (flat.field(c).to_pylist() for c in READING)
    rows, start = [], 0
    for page, end in zip(batch.column("page").to_pylist(), ends, strict=True):
        candidates: dict[int, tuple[str, list[Line]]] = {}
        for k in sorted(range(start, end), key=lambda k: (rank[k], place[k])):
            line = Line(text[k], model[k], float(confidence[k]), tuple(int(c[k]) for c in box), [])
            candidates.setdefault(rank[k], (candidate[k], []))[1].append(line)
        start = end
        if candidates:
            (best_model, best), *others = candidates.values()
            out, name = merged(best, best_model, others)
            rows += [(page, x.text, x.model, x.confidence, *x.box, x.alternatives, name, k) for k, x in enumerate(out)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


_NAMES = ["page", "text", "model", "confidence", "x1", "y1", "x2", "y2", "alternatives", "page_model", "line_order"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.float64(), *[pa.int32()] * 4, pa.list_(pa.struct([("text", pa.string()), ("model", pa.string()), ("confidence", pa.float64())])), pa.string(), pa.int32()]
