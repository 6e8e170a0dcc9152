"""Recognizers around a job: which ones read a page, what each reads, and how their raw output becomes lines.

A recognizer is a name, a kind and a function from image rows to line rows;
engines and weights are not bundled. Page readers take every variant of a
page, segment readers only the original.
"""

from __future__ import annotations

import csv
import io
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import recognition

#: The confidence of a reading without a score, and the limits of one with a score.
UNSCORED, LEAST, MOST = 0.72, 0.05, 0.92
#: Languages of whole-page readers in order, for old script and for typewriters; the last resort.
HISTORICAL, TYPEWRITTEN, RESORT = ("frak2021", "deu_latf", "script/Fraktur", "deu"), ("deu",), "deu"
PAGE, SEGMENTS = "page", "segments"


def line_id(model: Column, variant: Column, index: Column, text: Column) -> Column:
    """Id of a candidate line: 20 hex digits that depend on who read what."""
    return F.substring(F.sha1(F.concat_ws(":", model, variant, index.cast("string"), text)), 1, 20)


def sequence_confidence(score: Column) -> Column:
    """Confidence of a generated sequence from its mean log probability; null: unscored."""
    return F.when(score.isNull(), UNSCORED).otherwise(recognition.clamp(F.exp(score), LEAST, MOST))


def segment_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of separately read segments from their words (keys, segment, word, text, confidence, bbox).

    Blank words are left out, a segment without others gives no line. Confidence
    is the mean of those not negative, of 100, or 0. ``segment`` keeps its number.
    Words that come segment by segment, as rows (keys, segment, words: array of structs word, text,
    confidence, bbox), are not exchanged.
    """
    if "words" in words.columns:
        trimmed = F.transform(recognition.said(F.col("words")), lambda w: F.trim(w["text"]))
        lines = words.select(*keys, "segment", F.array_join(trimmed, " ").alias("text"), recognition.sureness(F.col("words")).alias("confidence"), F.try_element_at("words", F.lit(1))["bbox"].alias("bbox"))
        return lines.where("text <> ''")
    said = F.trim("text")
    ordered = F.array_sort(F.collect_list(F.when(said != "", F.struct("word", said.alias("text")))))
    mean = F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))) / 100
    lines = words.groupBy(*keys, "segment").agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"),
        recognition.clamp(F.coalesce(mean, F.lit(0.0)), 0.0, 1.0).alias("confidence"), F.first("bbox").alias("bbox"),
    )
    return lines.where("text <> ''")


@dataclass(frozen=True)
class Recognizer:
    """``read`` maps image rows (page, variant, image) to line rows (page, variant, line_order, text, confidence, x1, y1, x2, y2)."""

    name: str
    kind: str
    read: Callable[[pd.DataFrame], pd.DataFrame] | None = None


@dataclass(frozen=True)
class Installed:
    """What a machine offers."""

    languages: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    detector: bool = False
    #: The generating whole-page model, and whether there is memory enough for it.
    large: str | None = None
    large_fits: bool = False


def assemble(installed: Installed, models: Iterable[str], typewritten: bool = False, advanced: bool = True) -> list[Recognizer]:
    """The recognizers of a document in order, for the ``models`` that its year and script ask for.

    Page readers of installed languages; with ``advanced`` also segment readers
    of those languages where a detector finds lines, the large model if it fits,
    and the installed ones of ``models``. Without any, one page reader of the
    last-resort language; a machine without languages and models is an error.
    """
    spoken = [x for x in (TYPEWRITTEN if typewritten else HISTORICAL) if x in installed.languages]
    found = [Recognizer(f"tesseract:{x}", PAGE) for x in spoken]
    if advanced:
        wanted = [m for m in models if m in installed.models]
        large = [installed.large] if installed.large and installed.large_fits else []
        if installed.detector and (wanted or large):
            found += [Recognizer(f"tesseract-line:{x}", SEGMENTS) for x in spoken]
        found += [Recognizer(m, SEGMENTS) for m in [*large, *wanted]]
    if not found:
        if not installed.languages:
            raise RuntimeError("no recognizer is installed")
        language = RESORT if RESORT in installed.languages else installed.languages[0]
        found = [Recognizer(f"tesseract:{language}", PAGE)]
    return found


def readings_wanted(variants: DataFrame, recognizers: DataFrame, original: str = "original") -> DataFrame:
    """Every variant (…, variant) with every recognizer (recognizer, kind, position) that may read it."""
    fits = (F.col("kind") == PAGE) | (F.col("variant") == original)
    return variants.join(F.broadcast(recognizers), fits)  # a handful of recognizers


LINES = "page string, variant string, model string, line_order int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"


def recognize(images: DataFrame, recognizers: list[Recognizer], original: str = "original") -> DataFrame:
    """Line rows of every recognizer over image rows (page, variant, image).

    A reader that fails on a page, and pages of which it reads nothing but
    blanks, give no rows; other errors than RuntimeError surface.
    """
    names = [c.split()[0] for c in LINES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for reader in recognizers:
                some = batch if reader.kind == PAGE else batch[batch["variant"] == original]
                for k in range(len(some)):
                    try:
                        lines = reader.read(some.iloc[k : k + 1])
                    except (RuntimeError, subprocess.SubprocessError):
                        continue
                    if "".join(lines["text"]).strip():
                        yield lines.assign(model=reader.name)[names]

    return images.select("page", "variant", "image").mapInPandas(run, LINES)


def external(command: list[str], parse: Callable[[str], pd.DataFrame], seconds: int = 600) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A reader that runs a program: ``{image}``, ``{input}`` and ``{output}`` in ``command`` name its files.

    ``parse`` gets the output file, or what the program prints if its command names none.

    Image rows carry ``image`` (bytes) and may carry ``segmentation`` (the XML
    of ``export.segmentation_xml``). A failing program is a RuntimeError.
    """

    to_file = any("{output}" in part for part in command)

    def read(row: pd.DataFrame) -> pd.DataFrame:
        one = row.iloc[0]
        with tempfile.TemporaryDirectory() as folder:
            places = {n: str(Path(folder) / n) for n in ("image", "input", "output")}
            Path(places["image"]).write_bytes(bytes(one["image"]))
            Path(places["input"]).write_text(one.get("segmentation") or "", encoding="utf-8")
            done = subprocess.run([part.format(**places) for part in command], capture_output=True, text=True, timeout=seconds, check=False)
            if done.returncode or (to_file and not Path(places["output"]).exists()):
                raise RuntimeError(done.stderr.strip() or "the recognizer failed")
            said = Path(places["output"]).read_text(encoding="utf-8") if to_file else done.stdout
            return parse(said).assign(page=one["page"], variant=one["variant"])

    return read


# ------------------------------------------------------------ an installed page reader


def printed_lines(out: str) -> pd.DataFrame:
    """Lines in reading order of a page reader's tab-separated words, by the rules of ``recognition.lines_of_words``."""
    words = pd.read_csv(io.StringIO(out), sep="\t", quoting=csv.QUOTE_NONE, keep_default_na=False, dtype={"text": str})
    words = words.assign(text=words["text"].str.strip(), sure=words["conf"].where(words["conf"] >= 0), right=words["left"] + words["width"], bottom=words["top"] + words["height"])
    found = words[words["text"] != ""].groupby(["block_num", "par_num", "line_num"], sort=False)
    lines = found.agg(text=("text", " ".join), confidence=("sure", "mean"), x1=("left", "min"), y1=("top", "min"), x2=("right", "max"), y2=("bottom", "max"))
    lines["confidence"] = (lines["confidence"].fillna(0.0) / 100).clip(0.0, 1.0)
    lines = lines.sort_values(["y1", "x1"], kind="stable").reset_index(drop=True)
    return lines.assign(line_order=range(len(lines)))


def page_reader(language: str, program: str = "tesseract") -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A reader by the program of that name, which every executor must have."""
    options = ["-l", language, "--oem", "1", "--psm", "3", "-c", "preserve_interword_spaces=1", "tsv"]
    return external([program, "{image}", "stdout", *options], printed_lines)


def installed_languages(program: str = "tesseract") -> tuple[str, ...]:
    """Languages that the program says it has; none without it."""
    if shutil.which(program) is None:
        return ()
    done = subprocess.run([program, "--list-langs"], capture_output=True, text=True, timeout=15, check=False)
    said = [] if done.returncode else [x.strip() for x in done.stdout.splitlines()]
    return tuple(x for x in said if x and not x.startswith("List of available languages"))


def ready(found: list[Recognizer], program: str = "tesseract") -> list[Recognizer]:
    """Assembled recognizers with the installed page reader behind those of its kind; others without a reader go."""
    known = [replace(r, read=page_reader(r.name.split(":", 1)[1], program)) if r.read is None and r.kind == PAGE else r for r in found]
    return [r for r in known if r.read]
