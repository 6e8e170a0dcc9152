"""A batch job: from a folder of scans to transcribed, stored and exported documents.

Each step is one plan over all pages of the job, written to the job's own folder
before the next, so that a lost executor costs tasks only. Files are written and
tables of the archive change after everything is computed, all tables in one
commit: a job that ends before leaves the archive as it was.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import commits, export, imaging, merge, pdf, recognition, recognizers, review, rules
from quillmark.sources import discovery

#: States of a job and what is said with them.
RUNNING, DONE, FAILED, CANCELLED = "läuft", "fertig", "fehlgeschlagen", "abgebrochen"
NO_FILES, NO_TEXT, BY_USER = "Keine unterstützten Dateien gefunden", "Auf der Seite konnte kein Text erkannt werden", "Durch Benutzer abgebrochen"

KEYS = ["page", "variant", "model"]


@dataclass(frozen=True)
class Request:
    folder: str
    year: int | None = None
    hint: str = "auto"
    budget: float = 1.0


class Cancelled(Exception):
    pass


class Job:
    """One run over the documents of a folder.

    ``load(spark, folder)`` gives path, width, height, channels and data of the images, and ``frame``
    where a file has several; with another loader, files of other kinds can be read. ``fetch`` asks for second
    readings (see ``review.ask``), ``second`` names their model, ``most`` is a call's greatest cost. ``archive`` gets the tables
    documents, pages, lines and jobs, ``output`` the files.
    """

    def __init__(
        self, spark: SparkSession, archive: commits.Snapshots, output: str, readers: list[recognizers.Recognizer], fetch: Callable[[Row], tuple[str, float]] | None = None,
        second: str = "", most: float | None = None, load: Callable[[SparkSession, str], DataFrame] = discovery.load_scans, progress: Callable[[str, float], None] = lambda message, share: None,
    ):
        self.spark, self.archive, self.output, self.readers = spark, archive, output.rstrip("/"), readers
        self.fetch, self.second, self.most, self.load, self.progress = fetch, second, most, load, progress
        self.id, self._stopped = uuid.uuid4().hex, False
        self.work = f"{archive.root}/_jobs/{self.id}"

    def cancel(self) -> None:
        """Ends the job, also amid a step; what it has stored by then stays."""
        self._stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.id)

    def run(self, request: Request) -> str:
        """The job's id; an error is recorded as the job's state and raised, a cancelled job only recorded."""
        self.spark.sparkContext.addJobTag(self.id)
        self._state(RUNNING, "")
        try:
            count = self._run(request)
            self._state(DONE, f"{count} Dokumente verarbeitet")
            self.progress("Verarbeitung abgeschlossen", 1.0)
        except Exception as error:
            if not self._stopped:
                self._state(FAILED, str(error))
                raise
            self._state(CANCELLED, BY_USER)
        finally:
            self.spark.sparkContext.removeJobTag(self.id)
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.work)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        return self.id

    # ---------------------------------------------------------- steps

    def _run(self, request: Request) -> int:
        self._step("Dateien und Seiten werden erfasst", 0.01)
        found = self._keep("found", discovery.documents(discovery.files(self.spark, request.folder)))
        if found.isEmpty():
            raise ValueError(NO_FILES)
        images, scans = self._scans(found, request)
        self._step("Helligkeit, Kontrast und Schieflage angepasst", 0.22)
        views = self._keep("views", imaging.chosen(images))
        self._step("lokale OCR-/HTR-Modelle arbeiten", 0.30)
        read = self._keep("read", self._led_back(recognizers.recognize(views, self.readers), views))
        lines, pages = self._transcribed(read, scans, views, request)
        if self.fetch:
            self._step("optionale Zweitlesung wird geprüft", 0.86)
            lines, pages = self._reviewed(lines, pages, views, request)
        lines = text.compose_field(text.compose(lines, "text"), "alternatives", "text").withColumn("normalized", text.normalize(F.col("text")))
        lines, pages = self._keep("lines", lines.drop("page")), self._keep("pages", pages.drop("page"))
        documents = found.select(
            F.col("id").alias("document_id"), "title", "kind", "source_paths", F.lit(request.year).cast("int").alias("year"),
            F.lit(request.hint).alias("script_hint"), F.lit(self.id).alias("job_id"), F.lit(time.time()).alias("created_at"),
        ).join(pages.select("document_id").distinct(), "document_id", "left_semi")
        documents = self._keep("documents", documents)
        self._step("Ausgabedateien werden formatiert", 0.97)
        self._export(documents, pages, lines)
        self._step("Suchindex wird aktualisiert", 0.98)

        def save(transaction: commits.Transaction) -> None:
            for name, table in (("lines", lines), ("pages", pages), ("documents", documents)):
                transaction.replace(name, table, ["document_id"])

        self.archive.update(save)
        return documents.count()

    def _scans(self, found: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
        """Images with their page key, and the pages: page, document_id, page_index, source_path, width, height."""
        plain = lambda path: F.regexp_replace(path, "^file:/+", "/")
        paged = discovery.image_pages(found).withColumn("file", plain(F.col("source_path")))
        images = self.load(self.spark, request.folder).withColumn("file", plain(F.col("path"))).drop("path").join(paged, "file")
        if "frame" in images.columns:
            images = images.withColumn("page_index", F.col("page_index") + F.col("frame"))
        images = images.withColumn("page", F.format_string("%s-%04d", "document_id", "page_index"))
        scans = self._keep("scans", images.select("page", "document_id", "page_index", "source_path", "width", "height"))
        if scans.isEmpty():
            raise ValueError(NO_FILES)
        return images, scans

    def _led_back(self, read: DataFrame, views: DataFrame) -> DataFrame:
        """Lines with their boxes on the page as it was scanned; recognizers saw it straightened."""
        box = imaging.box_back(F.struct("x1", "y1", "x2", "y2"), F.col("transform"))
        found = read.join(views.select("page", "variant", "transform"), ["page", "variant"]).withColumn("__box", box)
        return found.select(*(F.col(f"__box.{c}").alias(c) if c in ("x1", "y1", "x2", "y2") else F.col(c) for c in read.columns))

    def _transcribed(self, read: DataFrame, scans: DataFrame, views: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
        """Lines and pages by the best candidate of each page, merged with the others and put right by rules."""
        names = F.array(*(F.lit(r.name) for r in self.readers))
        sized = read.join(scans.select("page", F.col("height").alias("page_height")), "page")
        rated = recognition.scores(recognition.coverage(sized, KEYS)).join(views.select("page", "variant", "choice"), ["page", "variant"])
        rated = rated.withColumn("position", F.col("choice") * len(self.readers) + F.array_position(names, F.col("model")))
        rated = self._keep("rated", rated.select(*KEYS, "position", "score", "coverage", "expected_cer"))
        silent = scans.join(rated, "page", "left_anti").orderBy("page").limit(1).collect()
        if silent:
            raise RuntimeError(f"{NO_TEXT}: {silent[0].source_path}")
        # a candidate's rank only orders: score first, then position
        order = F.dense_rank().over(Window.partitionBy("page").orderBy(F.desc("score"), "position")) - 1
        ranked = read.join(rated.withColumn("rank", order), KEYS)
        merged = merge.merge(ranked.select("page", "rank", F.col("model").alias("candidate"), "line_order", "text", "model", "confidence", "x1", "y1", "x2", "y2"))
        year = F.lit(request.year).cast("int")
        ruled = self._keep("ruled", rules.civil_register(rules.year_hint(merged, year), ["page"], year))
        best = recognition.best(rated, ["page"]).select("page", "variant", "coverage", "expected_cer")
        told = ruled.groupBy("page").agg(
            F.avg("confidence").alias("mean_confidence"), F.first("page_model").alias("model"), F.count("*").alias("line_count"), F.max(F.contains("model", F.lit("+standesformular"))).alias("by_rule"),
        )
        pages = scans.join(best, "page").join(told, "page").withColumn("warnings", recognition.warnings(F.col("by_rule"), F.col("coverage"), F.col("expected_cer")))
        lines = ruled.drop("page_model").join(scans.select("page", "document_id", "page_index"), "page").join(best.select("page", "variant"), "page").select(
            "page", F.format_string("%s-%04d-%04d", "document_id", "page_index", "line_order").alias("line_id"), "document_id", "page_index", "line_order", "text", "confidence",
            "model", "variant", F.struct("x1", "y1", "x2", "y2").alias("bbox"), "alternatives",
        )
        return lines, pages.drop("by_rule")

    def _reviewed(self, lines: DataFrame, pages: DataFrame, views: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
        """Lines and pages with what the second readings of uncertain pages say."""
        local = lines.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_order", "text"))), lambda x: x["text"]), "\n").alias("local_text"))
        first = views.where("choice = 0").select("page", F.col("image").alias("original"))
        last = views.groupBy("page").agg(F.max("choice").alias("choice")).join(views, ["page", "choice"]).select("page", F.col("image").alias("optimized"))
        calls = review.wanted(pages).select("page").join(local, "page").join(first, "page").join(last, "page")
        calls = calls.select("*", F.lit(request.year).cast("int").alias("year"), review.task(F.lit(request.hint)).alias("task"))
        answers = self._keep("answers", review.ask(self._keep("calls", calls), self.fetch, request.budget, f"{self.work}/said", self.most))
        found = review.news(review.readings(answers).withColumn("model", F.lit(self.second)), local)
        return review.annotated(lines, found), review.warned(pages, found)

    def _export(self, documents: DataFrame, pages: DataFrame, lines: DataFrame) -> None:
        shown = lines.join(pages.select("document_id", "page_index", "source_path", "width", "height"), ["document_id", "page_index"])
        printed = export.docx(documents, pages, lines).withColumn("name", F.lit("transkription.docx")).unionByName(pdf.pdf(documents, pages, lines).withColumn("name", F.lit("transkription.pdf")))
        files = export.bundle(documents, lines, export.page_xml(shown), export.json_result(documents, pages, lines), printed)
        export.write_files(files, self.output)
        export.batch_index(documents, pages).write.mode("overwrite").json(f"{self.output}/auftrag-{self.id[:8]}/stapelindex")

    # ---------------------------------------------------------- bookkeeping

    def _step(self, message: str, share: float) -> None:
        if self._stopped:
            raise Cancelled(message)
        self.progress(message, share)

    def _keep(self, name: str, table: DataFrame) -> DataFrame:
        """Writes a step's table to the job's folder and rereads it."""
        table.write.mode("overwrite").parquet(f"{self.work}/{name}")
        return self.spark.read.schema(table.schema).parquet(f"{self.work}/{name}")

    def _state(self, status: str, message: str) -> None:
        """Appends to the job's events, of which ``store.latest`` tells the state."""
        self.spark.createDataFrame([(self.id, time.time(), status, message)], "job_id string, at double, status string, message string").coalesce(1).write.mode("append").parquet(f"{self.archive.root}/jobs")
