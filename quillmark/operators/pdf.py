"""Portable documents of transcriptions: a story of styled paragraphs for each document, laid out on A4 pages.

Letters are of the two Courier fonts that every viewer has, whose width is the
same for all characters. What their encoding lacks is drawn as its base letter
or a question mark; the line then carries its true text for copying and search.
"""

from __future__ import annotations

import textwrap
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import export

#: Font (1 plain, 2 bold), size, grey, and space before, in points, of a style.
STYLES = {"title": (2, 22, 0.0, 120), "h1": (2, 16, 0.0, 6), "h2": (2, 12, 0.0, 10), "body": (1, 10, 0.0, 0), "muted": (1, 8, 0.4, 4)}
BREAK = "break"
WIDTH, HEIGHT, SIDE, END = 595, 842, 57, 51


def _drawn(line: str) -> bytes:
    """The line in the fonts' encoding."""
    out = bytearray()
    for c in line:
        for form in (c, unicodedata.normalize("NFKD", c)[0], "?"):
            try:
                out += form.encode("cp1252")
                break
            except UnicodeEncodeError:
                continue
    return bytes(out)


def _line(said: str, style: str, y: float) -> str:
    font, size, grey, _ = STYLES[style]
    shown = _drawn(said)
    mark = "" if shown.decode("cp1252", "replace") == said else f"/Span <</ActualText <feff{said.encode('utf-16-be', 'replace').hex()}>>> BDC "
    return f"{mark}{grey} g BT /F{font} {size} Tf {SIDE} {y:.1f} Td <{shown.hex()}> Tj ET{' EMC' if mark else ''}\n"


def _sheets(story: Iterable[tuple[str, str]]) -> Iterator[str]:
    """The drawing instructions of each page; a story always has one."""
    sheet, y = [], HEIGHT - END
    for style, said in story:
        if style == BREAK:
            yield "".join(sheet)
            sheet, y = [], HEIGHT - END
            continue
        _, size, _, before = STYLES[style]
        y -= before
        for line in textwrap.wrap(said, int((WIDTH - 2 * SIDE) / (0.6 * size))) or [""]:
            y -= 1.3 * size
            if y < END:
                yield "".join(sheet)
                sheet, y = [], HEIGHT - END - 1.3 * size
            sheet.append(_line(line, style, y))
    yield "".join(sheet)


def layout(story: Iterable[tuple[str, str]]) -> bytes:
    """The file of (style, text) paragraphs; the style ``BREAK`` begins a new page."""
    sheets = [zlib.compress(s.encode("ascii")) for s in _sheets(story)]
    fonts = [f"<</Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /WinAnsiEncoding>>".encode() for name in ("Courier", "Courier-Bold")]
    kids = " ".join(f"{5 + 2 * k} 0 R" for k in range(len(sheets)))
    objects = [b"<</Type /Catalog /Pages 2 0 R>>", f"<</Type /Pages /Kids [{kids}] /Count {len(sheets)}>>".encode(), *fonts]
    for k, sheet in enumerate(sheets):
        frame = f"<</Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources <</Font <</F1 3 0 R /F2 4 0 R>>>> /Contents {6 + 2 * k} 0 R>>"
        objects += [frame.encode(), f"<</Length {len(sheet)} /Filter /FlateDecode>>\nstream\n".encode() + sheet + b"\nendstream"]
    out, places = bytearray(b"%PDF-1.5\n"), []
    for k, content in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, content)
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    end = f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<</Size {len(objects) + 1} /Root 1 0 R>>\nstartxref\n{len(out)}\n%%EOF\n"
    return bytes(out) + end.encode()


def _part(rows: DataFrame, section: int, a: Column, b: Column, style: Column, said: Column) -> DataFrame:
    return rows.select("document_id", F.struct(F.lit(section).alias("section"), a.cast("int").alias("a"), b.cast("int").alias("b"), style.alias("style"), F.coalesce(said, F.lit("")).alias("text")).alias("item"))


def story(documents: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """document_id, item (section, a, b, style, text): the paragraphs of every document, ordered by their items."""
    zero, number, mid = F.lit(0), F.col("page_index") + 1, F.lit(" · ")
    or_none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nicht angegeben"))
    fixed = lambda section, k, style, said: _part(documents, section, zero, F.lit(k), F.lit(style), F.lit(said))
    note = F.concat("model", mid, "variant", mid, F.lit("Sicherheit "), text.percent(F.col("mean_confidence")))
    row = F.concat(number.cast("string"), mid, "model", mid, "variant", mid, text.percent(F.col("mean_confidence"), 1), mid, text.percent(F.col("expected_cer"), 1))
    prose = export.reading_text(lines).select("document_id", F.posexplode(F.split("reading", "\n")).alias("k", "said"))
    parts = [
        _part(documents, 0, zero, zero, F.lit("title"), F.col("title")),
        _part(documents, 0, zero, F.lit(1), F.lit("body"), F.concat(F.lit("Jahr: "), or_none("year"), mid, F.lit("Schrift: "), or_none("script_hint"))),
        fixed(1, 0, BREAK, ""), fixed(1, 1, "h1", export.TRANSCRIPT),
        _part(pages, 2, F.col("page_index"), F.lit(-1), F.lit("h2"), F.concat(F.lit("Seite "), number.cast("string"))),
        _part(lines, 2, F.col("page_index"), F.col("line_order"), F.lit("body"), F.col("text")),
        _part(pages, 2, F.col("page_index"), F.lit(2**31 - 1), F.lit("muted"), note),
        fixed(3, 0, BREAK, ""), fixed(3, 1, "h1", export.READING), _part(prose, 4, zero, F.col("k"), F.lit("body"), F.col("said")),
        fixed(5, 0, BREAK, ""), fixed(5, 1, "h1", export.APPENDIX), fixed(5, 2, "h2", "Seite · Modell · Variante · Sicherheit · erw. CER"),
        _part(pages, 6, F.col("page_index"), zero, F.lit("body"), row),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def pdf(documents: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """document_id, content: a portable document of each row of ``documents``; columns as for ``export.docx``."""

    @F.pandas_udf("binary")
    def laid(items: pd.Series) -> pd.Series:
        return items.map(lambda x: layout((i["style"], i["text"]) for i in x))

    whole = story(documents, pages, lines).groupBy("document_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return whole.select("document_id", laid("items").alias("content"))
