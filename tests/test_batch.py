"""The batch job and second readings, with recognizers and a service that are made up."""

import json
import random
import re
import uuid
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest

from quillmark import cli
from quillmark.operators import batch, commits, export, pdf, review, store
from quillmark.operators import recognizers as R
from quillmark.sources import discovery
from tests.test_archive import png, scan


def reader(texts, confidence=0.94):
    def read(row):
        n = len(texts)
        return pd.DataFrame({"page": row["page"].iloc[0], "variant": row["variant"].iloc[0], "line_order": range(n), "text": texts, "confidence": confidence,
                             "x1": 20, "y1": [20 + 50 * k for k in range(n)], "x2": 280, "y2": [50 + 50 * k for k in range(n)]})

    return read


def fails(row):
    raise RuntimeError("no")


def states(spark, root):
    events = spark.read.parquet(f"{root}/jobs")
    return {r.job_id: (r.status, r.message) for r in store.latest(events, "job_id", ["at"], ["status", "message"]).collect()}


def test_job_from_folder_to_files(spark, tmp_path):
    for name in ("Über alles +1/seite2.png", "Über alles +1/seite1.png", "B/x.png"):
        png(tmp_path / "in" / name, scan())
    archive, said = commits.Snapshots(spark, str(tmp_path / "archive")), []
    readers = [R.Recognizer("tesseract:deu", R.PAGE, reader(["den 3. Mai 1871", "Johann Schmidt"])), R.Recognizer("trocr-x", R.SEGMENTS, reader(["den 3. Mai 1871", "Johann Schmitt"], 0.3)), R.Recognizer("z", R.PAGE, fails)]
    calls = tmp_path / "calls"  # calls run in other processes
    calls.mkdir()

    def fetch(row):
        (calls / uuid.uuid4().hex).write_text(repr((bytes(row.original[:2]), row.task, row.year)))
        return json.dumps({"text": " Johann Schmid ", "confidence": 7}), 0.4

    job = batch.Job(spark, archive, str(tmp_path / "out"), readers, fetch, "reader-2", progress=lambda m, s: said.append(s))
    for _ in range(2):  # a document saved again replaces itself
        job.run(batch.Request(str(tmp_path / "in"), 1872))
    assert states(spark, archive.root)[job.id] == (batch.DONE, "2 Dokumente verarbeitet")
    assert said == sorted(said[: len(said) // 2]) * 2 and said[-1] == 1.0
    documents, pages, lines = (archive.read(t).collect() for t in ("documents", "pages", "lines"))
    assert sorted(r.title for r in documents) == ["B", "Über alles +1"] and len(pages) == 3 and len(lines) == 6
    first = next(r for r in lines if r.line_order == 0)
    assert first.text == "den 3. Mai 1872" and first.model == "tesseract:deu+jahrangabe" and first.normalized == "den 3 mai 1872"
    assert first.line_id == f"{first.document_id}-{first.page_index:04d}-0000"
    assert first.alternatives[0].text == "den 3. Mai 1871"
    second = next(r for r in lines if r.line_order == 1)
    assert [a.text for a in second.alternatives] == ["Johann Schmitt"]
    # two calls of 0.4 fit into 1.0 dollars, the third page's is discarded
    assert [p.read_text() for p in calls.iterdir()] == [repr((b"P5", "handwriting", 1872))] * 6
    again = [r for r in lines if r.line_order == 0 and r.alternatives[-1].text == "Johann Schmid"]
    assert len(again) == 2 and again[0].alternatives[-1].confidence == 1.0 and again[0].alternatives[-1].model == "reader-2"
    warned = [r.warnings[-1] for r in sorted(pages, key=lambda r: (r.document_id, r.page_index))]
    assert warned == ["Cloud-Zweitlesung vorhanden (reader-2, $0.4000)"] * 2 + [review.UNAVAILABLE]
    assert {(r.variant, r.model, r.width) for r in pages} == {("original", "tesseract:deu", 300)}
    names = {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()}
    folder = next(n for n in names if n.startswith("Über-alles-1-")).split("/")[0]
    for name in ("transkription_original.txt", "lesefassung.txt", "result.json", "transkription.docx", "transkription.pdf", "pagexml/seite_0002.xml", f"{folder}.zip"):
        assert f"{folder}/{name}" in names
    assert (tmp_path / "out" / folder / "transkription_original.txt").read_text() == "den 3. Mai 1872\nJohann Schmidt" + export.PAGE_BREAK + "den 3. Mai 1872\nJohann Schmidt\n"
    with zipfile.ZipFile(tmp_path / "out" / folder / f"{folder}.zip") as packed:
        held = {f"{folder}/{n}" for n in packed.namelist()}
    assert held == {n for n in names if n.startswith(folder + "/")} - {f"{folder}/{folder}.zip"} and f"{folder}/transkription.docx" in held
    assert not list((tmp_path / "archive" / "_jobs").iterdir())


def test_job_without_files_or_text_fails_and_a_cancelled_one_ends(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "note.txt").write_text("x")
    archive = commits.Snapshots(spark, str(tmp_path / "archive"))
    make = lambda *readers, **more: batch.Job(spark, archive, str(tmp_path / "out"), list(readers), **more)
    none = make()
    with pytest.raises(ValueError, match=batch.NO_FILES):
        none.run(batch.Request(str(tmp_path / "in")))
    png(tmp_path / "in" / "a.png", np.full((60, 80), 255.0))
    mute = make(R.Recognizer("z", R.PAGE, fails))
    with pytest.raises(RuntimeError, match=batch.NO_TEXT):
        mute.run(batch.Request(str(tmp_path / "in")))
    stopped = make(R.Recognizer("a", R.PAGE, reader(["x"])), progress=lambda m, s: s > 0.2 and stopped.cancel())
    stopped.run(batch.Request(str(tmp_path / "in")))
    found = states(spark, archive.root)
    assert found[none.id][0] == found[mute.id][0] == batch.FAILED and found[stopped.id] == (batch.CANCELLED, batch.BY_USER)
    assert archive.version("lines") == 0


def test_answers_are_read_or_unavailable(spark):
    rows = [("a", '{"text": " x ", "confidence": "0.25", "notes": "n"}', 0.1), ("b", "no json", 0.1), ("c", None, 0.0), ("d", "[1]", 0.0), ("e", "{}", 0.0), ("f", '{"text": "x", "confidence": -3}', 0.0)]
    found = {r.page: (r.available, r.text, r.confidence, r.notes) for r in review.readings(spark.createDataFrame(rows, review.ANSWERS)).collect()}
    gone = (False, None, None, None)
    assert found == {"a": (True, "x", 0.25, "n"), "b": gone, "c": gone, "d": gone, "e": (True, "", 0.5, ""), "f": (True, "x", 0.0, "")}


def test_calls_end_with_the_budget(spark, tmp_path):
    def fetch(row):
        (tmp_path / f"called {row.page}").touch()
        if row.page == "b":
            raise OSError("offline")
        return "{}", {"a": 0.3, "c": 0.9, "d": 0.7}.get(row.page, 0.5)

    pages = spark.createDataFrame([(p,) for p in "edcba"], "page string")
    for most in (None, 0.9):
        found = review.ask(pages, fetch, 1.0, str(tmp_path / f"answers {most}"), most).collect()
        assert sorted((r.page, r.content, r.cost) for r in found) == [("a", "{}", 0.3), ("b", None, 0.0), ("c", None, 0.0), ("d", "{}", 0.7), ("e", None, 0.0)]
        assert sorted(p.name[-1] for p in tmp_path.glob("called *")) == ["a", "b", "c", "d"]
        for p in tmp_path.glob("called *"):
            p.unlink()
    assert {r.content for r in review.ask(pages, fetch, 0.0, str(tmp_path / "none")).collect()} == {None} and not list(tmp_path.glob("called *"))
    assert review.ask(pages.limit(0), fetch, 1.0, str(tmp_path / "empty"), 0.5).collect() == []

    def broken(row):
        raise KeyError("a fault of the caller's own")

    with pytest.raises(Exception, match="fault of the caller"):
        review.ask(pages, broken, 1.0, str(tmp_path / "broken")).collect()


@pytest.mark.parametrize(("most", "budget"), [(None, 3.0), (0.08, 30.0), (0.5, 40.0), (0.02, 12.0), (0.0, 25.0)])
def test_answers_within_a_budget_are_those_of_calls_one_after_the_other(spark, tmp_path, most, budget):
    rng = random.Random(str(most))
    costs = {f"p{k:04d}": rng.choice((0.0, 0.01, 0.05, rng.random() * 0.08)) for k in range(1000)}
    failing = set(rng.sample(sorted(costs), 50))

    def fetch(row):
        if row.page in failing:
            raise ValueError("no answer")
        return row.page.upper(), costs[row.page]

    spent, want = 0.0, {}
    for page in sorted(costs):
        called = spent < budget and page not in failing
        kept = called and spent + costs[page] <= budget
        want[page] = (page.upper(), costs[page]) if kept else (None, 0.0)
        spent += costs[page] if kept else 0.0
    order = sorted(costs)
    rng.shuffle(order)
    pages = spark.createDataFrame([(p, b"image") for p in order], "page string, image binary")
    assert {r.page: (r.content, r.cost) for r in review.ask(pages, fetch, budget, str(tmp_path / "answers"), most).collect()} == want


PROGRAM = """#!/usr/bin/env python
import sys
if sys.argv[1] == "--list-langs":
    print("List of available languages (2):\\ndeu\\neng")
    sys.exit()
assert open(sys.argv[1], "rb").read(2) == b"P5" and sys.argv[2:5] == ["stdout", "-l", "deu"]
print("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext")
print("1\t1\t0\t0\t0\t0\t0\t0\t300\t200\t-1\t")
for k, (line, left, top, conf, word) in enumerate([(2, 20, 90, 90, "Schmidt"), (1, 80, 20, 80, 'am "See'), (1, 20, 22, 60, " Haus"), (2, 99, 90, -1, "NA"), (3, 5, 150, -1, "x")]):
    print(f"5\t1\t1\t1\t{line}\t{k}\t{left}\t{top}\t40\t14\t{conf}\t{word}")
"""


def test_batch_and_models_on_the_command_line(spark, tmp_path, capsys):
    png(tmp_path / "in" / "x.png", scan())
    program = tmp_path / "reader"
    program.write_text(PROGRAM)
    program.chmod(0o755)
    (tmp_path / "settings.json").write_text(json.dumps({"recognizer_command": str(program)}))
    assert R.installed_languages(str(program)) == ("deu", "eng") and R.installed_languages(str(tmp_path / "absent")) == ()
    cli.main(["batch", str(tmp_path / "in"), str(tmp_path / "archive"), str(tmp_path / "out"), "--settings", str(tmp_path / "settings.json")], spark)
    assert "[100.0%]" in capsys.readouterr().out
    lines = commits.Snapshots(spark, str(tmp_path / "archive")).read("lines").orderBy("line_order").collect()
    assert [(r.text, round(r.confidence, 3), tuple(r.bbox)) for r in lines] == [('am "See Haus', 0.7, (20, 20, 120, 36)), ("Schmidt NA", 0.9, (20, 90, 139, 104)), ("x", 0.0, (5, 150, 45, 164))]
    (tmp_path / "known.json").write_text(json.dumps([{"key": "a", "files": ["w.bin"]}]))
    cli.main(["models", str(tmp_path / "models"), str(tmp_path / "known.json")], spark)
    assert capsys.readouterr().out == "a\tfehlt\n"


def drawn(content):
    """The text of each page's lines, after a look at the table of places."""
    start = int(re.search(rb"startxref\n(\d+)", content)[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", content[start:])]
    assert content[start:].startswith(b"xref\n0 ") and all(content[p:].startswith(b"%d 0 obj" % k) for k, p in enumerate(places, 1))
    pages = [zlib.decompress(x).decode() for x in re.findall(rb"stream\n(.*?)\nendstream", content, re.S)]
    return [[bytes.fromhex(x).decode("cp1252") for x in re.findall(r"<([0-9a-f]*)> Tj", page)] for page in pages], pages


def test_portable_documents(spark):
    documents = spark.createDataFrame([("d", "Kirchenbuch (1)", 1872, "auto"), ("e", "leer", None, None)], "document_id string, title string, year int, script_hint string")
    pages = spark.createDataFrame([("d", k, "m", "original", 0.935, 0.05) for k in (0, 1)], "document_id string, page_index int, model string, variant string, mean_confidence double, expected_cer double")
    said = [("d", 0, k, f"Zeile {k}", 0.9) for k in range(90)] + [("d", 1, 0, "Waſſer ⟦?⟧ über " + "wort " * 40, 0.9), ("d", 1, 1, "", 0.9)]
    lines = spark.createDataFrame(said, "document_id string, page_index int, line_order int, text string, confidence double")
    found = {r.document_id: bytes(r.content) for r in pdf.pdf(documents, pages, lines).collect()}
    sheets, raw = drawn(found["d"])
    assert discovery.pdf_pages(found["d"]) == len(sheets) and discovery.pdf_pages(found["e"]) == 4
    assert sheets[0] == ["Kirchenbuch (1)", "Jahr: 1872 · Schrift: auto"] and drawn(found["e"])[0][0] == ["leer", "Jahr: nicht angegeben · Schrift: nicht angegeben"]
    flat = [x for sheet in sheets[1:] for x in sheet]
    assert flat[:3] == [export.TRANSCRIPT, "Seite 1", "Zeile 0"] and flat[flat.index("Seite 2") - 1] == "m · original · Sicherheit 94%"
    assert flat.index("Zeile 89") - flat.index("Zeile 0") == 89 and all(len(x) <= 80 for x in flat)
    at = flat.index("Seite 2")
    assert flat[at + 1].startswith("Wasser ??? über wort") and " ".join(flat[at + 1 : at + 5]).count("wort") == 40
    assert "Waſſer ⟦?⟧".encode("utf-16-be").hex() in "".join(raw)
    assert sheets[-1] == [export.APPENDIX, "Seite · Modell · Variante · Sicherheit · erw. CER", "1 · m · original · 93.5% · 5.0%", "2 · m · original · 93.5% · 5.0%"]
