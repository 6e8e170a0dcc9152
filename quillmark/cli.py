"""Command line: transcribe folders, search an archive of Parquet tables, list found documents and models, follow new lines into the index."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.models import Model, Registry
from quillmark.operators import batch, commits, recognizers, search
from quillmark.settings import Settings
from quillmark.sources import discovery
from quillmark.streaming import index


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="search lines of an archive")
    s.add_argument("archive", help="folder with lines.parquet and documents.parquet")
    s.add_argument("text")
    s.add_argument("--mode", choices=[m.value for m in search.Mode], default=search.Mode.INTELLIGENT.value)
    s.add_argument("--fuzziness", type=float, default=0.72)
    s.add_argument("--limit", type=int, default=30)
    d = sub.add_parser("discover", help="list the documents of a folder")
    d.add_argument("folder")
    i = sub.add_parser("index", help="append new lines to the postings")
    i.add_argument("lines")
    i.add_argument("index")
    i.add_argument("checkpoint")
    b = sub.add_parser("batch", help="transcribe the scans of a folder into an archive and files")
    b.add_argument("folder")
    b.add_argument("archive", help="folder of the archive's tables, as snapshots")
    b.add_argument("output")
    b.add_argument("--year", type=int)
    b.add_argument("--script", choices=["auto", "handschrift", "druck", "schreibmaschine"], default="auto")
    b.add_argument("--settings", default="", help="file of settings")
    m = sub.add_parser("models", help="list the models of a folder")
    m.add_argument("root")
    m.add_argument("catalogue", help="JSON list of models (key, files, checksum)")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "models":
        known = [Model(**{**m, "files": tuple(m["files"])}) for m in json.loads(Path(a.catalogue).read_text(encoding="utf-8"))]
        for m in Registry(a.root, known).status():
            print(f"{m['key']}\t{'installiert' if m['installed'] else 'fehlt'}")
        return
    spark = spark or SparkSession.builder.appName("quillmark").getOrCreate()
    if a.command == "search":
        lines = spark.read.parquet(f"{a.archive}/lines.parquet")
        if "normalized" not in lines.columns:
            lines = text.compose(lines, "text").withColumn("normalized", text.normalize(F.col("text")))
        found = search.search(search.Archive(lines, spark.read.parquet(f"{a.archive}/documents.parquet")), search.Query(a.text, a.mode, a.fuzziness, limit=a.limit))
        for r in found.select("document_title", "page_index", "text", "reason", text.percent(F.col("score")).alias("p")).toLocalIterator():
            print(f"{r.document_title}\t{r.page_index + 1}\t{r.p}\t{r.reason}\t{r.text}")
    elif a.command == "discover":
        for r in discovery.documents(discovery.files(spark, a.folder)).toLocalIterator():
            print(f"{r.id}\t{r.kind}\t{r.title}\t{len(r.source_paths)}")
    elif a.command == "batch":
        program = Settings.load(a.settings).recognizer_command if a.settings else Settings.recognizer_command
        installed = recognizers.Installed(languages=recognizers.installed_languages(program))
        readers = recognizers.ready(recognizers.assemble(installed, [], a.script == "schreibmaschine"), program)
        job = batch.Job(spark, commits.Snapshots(spark, a.archive), a.output, readers, progress=lambda said, share: print(f"[{share:>6.1%}] {said}"))
        print(job.run(batch.Request(a.folder, a.year, a.script)))
    else:
        source = spark.readStream.schema("line_id string, text string").parquet(a.lines)
        index.follow(source, a.index, a.checkpoint).awaitTermination()


if __name__ == "__main__":
    main()
