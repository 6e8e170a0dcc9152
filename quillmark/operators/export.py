"""Exports: transcription texts, PAGE XML, JSON and zipped bundles, and the summaries of a job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text

#: What stands between pages, and the name space of PAGE XML.
PAGE_BREAK = "\n\n--- Seite ---\n\n"
NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"


def _ordered(order: str, value: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), between)


def original_text(lines: DataFrame) -> DataFrame:
    """document_id, original: a document's lines in order, its pages apart, one line feed at the end."""
    pages = lines.groupBy("document_id", "page_index").agg(_ordered("line_order", "text", "\n").alias("page"))
    whole = pages.groupBy("document_id").agg(_ordered("page_index", "page", PAGE_BREAK).alias("t"))
    return whole.select("document_id", F.concat(F.regexp_replace("t", r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit("\n")).alias("original"))


def reading_text(lines: DataFrame) -> DataFrame:
    """document_id, reading: the original text as running prose."""
    return original_text(lines).select("document_id", text.reading(F.col("original")).alias("reading"))


def _xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _corners(b: Column) -> Column:
    return F.format_string("%d,%d %d,%d %d,%d %d,%d", b["x1"], b["y1"], b["x2"], b["y1"], b["x2"], b["y2"], b["x1"], b["y2"])


def page_xml(lines: DataFrame) -> DataFrame:
    """document_id, page_index, xml: PAGE XML from lines (line_id, line_order, text, confidence, model,
    variant, bbox) of pages (width, height, source_path)."""
    line = F.concat(
        F.lit('<TextLine id="'), _xml(F.col("line_id")), F.lit('" conf="'), F.format_string("%.5f", F.col("confidence")), F.lit('" custom="model:'), _xml(F.col("model")), F.lit("; variant:"), _xml(F.col("variant")),
        F.lit('"><Coords points="'), _corners(F.col("bbox")), F.lit('"/><TextEquiv><Unicode>'), _xml(F.col("text")), F.lit("</Unicode></TextEquiv></TextLine>"),
    )
    pages = lines.withColumn("line", line).groupBy("document_id", "page_index", "source_path", "width", "height").agg(_ordered("line_order", "line", "").alias("body"))
    frame = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="{NAMESPACE}"><Metadata><Creator>quillmark</Creator></Metadata><Page imageFilename="'), _xml(F.col("source_path")),
        F.lit('" imageWidth="'), F.col("width").cast("string"), F.lit('" imageHeight="'), F.col("height").cast("string"), F.lit('"><TextRegion id="region_0">'), F.col("body"), F.lit("</TextRegion></Page></PcGts>"),
    )
    return pages.select("document_id", "page_index", frame.alias("xml"))


def segmentation_xml(boxes: DataFrame) -> DataFrame:
    """PAGE XML of line boxes (page, source_path, width, height, line_order, bbox) for a recognizer: no texts, a baseline in each."""
    b = F.col("bbox")
    line = F.concat(
        F.format_string('<TextLine id="line_%04d"><Coords points="', F.col("line_order")), _corners(b), F.lit('"/><Baseline points="'),
        F.format_string("%d,%d %d,%d", b["x1"], b["y2"] - 2, b["x2"], b["y2"] - 2), F.lit('"/></TextLine>'),
    )
    pages = boxes.withColumn("line", line).groupBy("page", "source_path", "width", "height").agg(_ordered("line_order", "line", "").alias("body"))
    start = F.format_string(f'<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="{NAMESPACE}"><Page imageFilename="%s" imageWidth="%d" imageHeight="%d"><TextRegion id="region_0">', _xml(F.col("source_path")), F.col("width"), F.col("height"))
    return pages.select("page", F.concat(start, F.col("body"), F.lit("</TextRegion></Page></PcGts>")).alias("xml"))


def json_result(documents: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """document_id, json: the nested record of a document, its pages and their lines."""
    by_page = lines.groupBy("document_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("line_order", "line_id", "text", "confidence", "bbox"))).alias("lines"))
    full = pages.join(by_page, ["document_id", "page_index"], "left")
    by_document = full.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_index", *[c for c in full.columns if c not in ("document_id", "page_index")]))).alias("pages"))
    whole = documents.join(by_document, "document_id", "left")
    return whole.select("document_id", F.to_json(F.struct(*whole.columns)).alias("json"))


#: The headings of a word-processor file, and the parts of such a file beside its text.
TRANSCRIPT, READING, APPENDIX = "Originalgetreue Transkription", "Lesefassung", "Technischer Anhang"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
DOCX_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{_TYPE}"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def _run(x: Column, style: str = "") -> Column:
    legal = F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")  # signs that XML cannot hold
    return F.concat(F.lit(f'<w:r><w:rPr>{style}</w:rPr><w:t xml:space="preserve">'), _xml(legal), F.lit("</w:t></w:r>"))


def _paragraph(*runs: Column) -> Column:
    return F.concat(F.lit("<w:p>"), *runs, F.lit("</w:p>"))


def _heading(x: Column, size: int) -> Column:
    return _paragraph(_run(x, f'<w:b/><w:sz w:val="{size}"/>'))


def docx(documents: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """document_id, content: a word-processor file of each document.

    ``documents`` has document_id, title, year, script_hint; ``pages`` document_id, page_index, model, variant,
    mean_confidence, expected_cer; ``lines`` document_id, page_index, line_order, text, confidence. Lines
    below 0.9 carry their confidence; then the reading version and a page list follow. Documents
    without pages have the headings alone.
    """
    unsure = _run(F.concat(F.lit("  [Sicherheit "), text.percent(F.col("confidence")), F.lit("]")), "<w:i/>")
    written = lines.withColumn("p", _paragraph(_run(F.col("text")), F.when(F.col("confidence") < 0.9, unsure).otherwise("")))
    number = (F.col("page_index") + 1).cast("string")
    by_page = written.groupBy("document_id", "page_index").agg(_ordered("line_order", "p", "").alias("body"))
    note = F.concat(F.lit("Seite "), number, F.lit(": "), F.col("model"), F.lit(", Variante "), F.col("variant"), F.lit(", mittlere Sicherheit "), text.percent(F.col("mean_confidence"), 1), F.lit(", erwartete CER "), text.percent(F.col("expected_cer"), 1))
    full = pages.join(by_page, ["document_id", "page_index"], "left").withColumn("part", F.concat(_heading(F.concat(F.lit("Seite "), number), 26), F.coalesce("body", F.lit("")))).withColumn("note", _paragraph(_run(note)))
    by_document = full.groupBy("document_id").agg(_ordered("page_index", "part", "").alias("parts"), _ordered("page_index", "note", "").alias("notes"))
    prose = F.array_join(F.transform(F.split("reading", "\n\n"), lambda x: _paragraph(_run(x))), "")
    whole = documents.join(by_document, "document_id", "left").join(reading_text(lines).select("document_id", prose.alias("prose")), "document_id", "left")
    or_none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nicht angegeben"))
    held = lambda c: F.coalesce(c, F.lit(""))
    body = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_WORD}"><w:body>'), _heading(F.col("title"), 40),
        _paragraph(_run(F.concat(F.lit("Jahr: "), or_none("year")))), _paragraph(_run(F.concat(F.lit("Schrifthinweis: "), or_none("script_hint")))),
        _heading(F.lit(TRANSCRIPT), 32), held("parts"), F.lit('<w:p><w:r><w:br w:type="page"/></w:r></w:p>'),
        _heading(F.lit(READING), 32), held("prose"), _heading(F.lit(APPENDIX), 32), held("notes"), F.lit("</w:body></w:document>"),
    )

    @F.pandas_udf("binary")
    def packed(xml: pd.Series) -> pd.Series:
        return xml.map(lambda x: _zipped([*DOCX_PARTS.items(), ("word/document.xml", x)]))

    return whole.select("document_id", packed(body).alias("content"))


def _zipped(files: list[tuple]) -> bytes:
    import io
    import zipfile

    target = io.BytesIO()
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return target.getvalue()


def bundle(documents: DataFrame, lines: DataFrame, pages_xml: DataFrame, results: DataFrame, printed: DataFrame | None = None) -> DataFrame:
    """document_id, folder, name, content: each document's files, and a zip of them all, as rows that any sink can store.

    ``printed`` (document_id, name, content) are more files, word-processor files and the like. A document's
    files meet in one task, which packs them: a book's, of some hundred pages, not a library's.
    """
    texts = original_text(lines).withColumn("reading", text.reading(F.col("original")))
    files = texts.select("document_id", F.explode(F.create_map(F.lit("transkription_original.txt"), F.col("original"), F.lit("lesefassung.txt"), F.col("reading"))).alias("name", "content"))
    files = files.unionByName(results.select("document_id", F.lit("result.json").alias("name"), F.col("json").alias("content")))
    files = files.unionByName(pages_xml.select("document_id", F.format_string("pagexml/seite_%04d.xml", F.col("page_index") + 1).alias("name"), F.col("xml").alias("content")))
    files = files.select("document_id", "name", F.encode("content", "utf-8").alias("content"))
    if printed is not None:
        files = files.unionByName(printed.select("document_id", "name", "content"))
    titles = documents.select("document_id", F.concat(text.slug(F.col("title")), F.lit("-"), F.substring("document_id", 1, 8)).alias("folder"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        packed = _zipped([(r.name, r.content) for r in rows.sort_values("name").itertuples()])
        first = rows.iloc[0]
        return pd.DataFrame({"document_id": [first.document_id], "folder": [first.folder], "name": [f"{first.folder}.zip"], "content": [packed]})

    named = files.join(titles, "document_id").select("document_id", "folder", "name", "content")
    return named.unionByName(named.groupBy("document_id").applyInPandas(pack, named.schema))


def write_files(rows: DataFrame, root: str) -> None:
    """Stores (folder, name, content) rows under ``root`` on a file system that all executors mount."""

    def store(batches: Iterator) -> None:
        from pathlib import Path

        for r in batches:
            target = Path(root) / r["folder"] / r["name"]
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(bytes(r["content"]))

    rows.foreachPartition(store)


def batch_index(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, title, pages, output_dir."""
    count = pages.groupBy("document_id").agg(F.count("*").alias("pages"))
    folder = F.concat(text.slug(F.col("title")), F.lit("-"), F.substring("document_id", 1, 8))
    return documents.join(count, "document_id", "left").select("document_id", "title", F.coalesce("pages", F.lit(0)).alias("pages"), folder.alias("output_dir"))


def job_summary(pages: DataFrame) -> DataFrame:
    """document_id, pages, to_review, incomplete from pages with expected_cer and warnings."""
    incomplete = F.exists("warnings", lambda w: F.contains(w, F.lit("unvollständig")))
    return pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(F.col("expected_cer") > 0.10).alias("to_review"), F.count_if(incomplete).alias("incomplete"))


def write_search_results(hits: DataFrame, path: str) -> None:
    """Stores ``search_results`` as one CSV file with its headings, in the hits' order of score; hits are few."""
    shown = search_results(hits.orderBy(F.desc("score"), "document_title", "page_index"))
    shown.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def search_results(hits: DataFrame) -> DataFrame:
    """The table that a list of hits prints: Dokument, Jahr, Seite, Text, Trefferart, Bewertung."""
    return hits.select(
        F.col("document_title").alias("Dokument"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("Jahr"), (F.col("page_index") + 1).alias("Seite"),
        F.col("text").alias("Text"), F.col("reason").alias("Trefferart"), text.percent(F.col("score")).alias("Bewertung"),
    )
