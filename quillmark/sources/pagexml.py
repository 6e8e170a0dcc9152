"""PAGE XML as a source: lines with boxes, texts and confidences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.llm import _shared as S

SCHEMA = "line_index int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"


def lines_of(xml: str) -> list[tuple]:
    """Rows of one file; lines without text are left out but counted, a missing confidence is 0.75."""
    import xml.etree.ElementTree as ET

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for k, line in enumerate(e for e in ET.fromstring(xml.encode()).iter() if local(e) == "TextLine"):
        texts = [e.text or "" for e in line.iter() if local(e) == "Unicode"]
        corners = next((e.get("points", "") for e in line.iter() if local(e) == "Coords"), "")
        found = (texts[0] if texts else "").strip()
        points = [tuple(int(float(v)) for v in p.split(",")) for p in corners.split()]
        if found and points:
            xs, ys = zip(*points, strict=True)
            out.append((k, found, max(0.0, min(1.0, float(line.get("conf", 0.75)))), min(xs), min(ys), max(xs), max(ys)))
    return out


def parse(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the lines of each page of ``pages`` (keys, xml). Files are read a few at a time, so memory is bounded by the largest."""
    S.small_batches(pages.sparkSession)
    kinds = [pa.int32(), pa.string(), pa.float64(), *[pa.int32()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, "xml"):
                found = [lines_of(xml) for xml in part.column("xml").to_pylist()]
                page = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]))
                columns = list(zip(*(line for lines in found for line in lines), strict=True)) or [[]] * len(kinds)
                own = [part.column(k).take(page) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*keys, *names])

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select(*keys).schema.fields)
    return pages.select(*keys, "xml").mapInArrow(run, f"{schema}, {SCHEMA}")
