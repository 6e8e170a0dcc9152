"""Recognizers, page counts, listings and settings."""

import hashlib
import io
import struct
import sys
import zipfile
import zlib
from xml.etree import ElementTree

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.models import Model, Registry
from quillmark.operators import export, store
from quillmark.operators import recognizers as R
from quillmark.plans import catalog
from quillmark.settings import Settings
from quillmark.sources import discovery

SF = "/root/testdata/sf0.001"
NEW = "segmented_reading sequence_confidences variant_recognizers recent_documents parameterised_rows civil_register_rules stream_incremental_index natural_order line_context alias_expansion".split()


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "pages", "nation"):
        c.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = catalog.QUERIES[name](spark, SF)
    rows = sorted(map(str, (tuple(r) for r in found.select(*sorted(found.columns)).collect())))
    want = sorted(map(str, c.execute(f"select {', '.join(sorted(found.columns))} from ({catalog.ORACLES[name]})").fetchall()))
    assert rows == want and rows


def test_assembly_of_recognizers():
    all_ = R.Installed(("deu", "frak2021", "eng"), ("trocr-modern",), True, "party", True)
    assert [r.name for r in R.assemble(all_, ["trocr-modern", "x"])] == ["tesseract:frak2021", "tesseract:deu", "tesseract-line:frak2021", "tesseract-line:deu", "party", "trocr-modern"]
    assert [r.name for r in R.assemble(all_, [], typewritten=True, advanced=False)] == ["tesseract:deu"]
    assert [r.name for r in R.assemble(R.Installed(("ita",)), [])] == ["tesseract:ita"]
    with pytest.raises(RuntimeError):
        R.assemble(R.Installed(), ["trocr-modern"])


def reader(name, fails=False):
    def read(row):
        if fails:
            raise RuntimeError("no")
        said = row["image"].iloc[0].decode()
        return pd.DataFrame({"page": row["page"], "variant": row["variant"], "line_order": 0, "text": said, "confidence": 0.94, "x1": 20, "y1": 20, "x2": 300, "y2": 60})

    return read


def test_recognize_skips_failures_blanks_and_variants(spark):
    images = spark.createDataFrame([("p", "original", b"Johann Schmidt"), ("p", "kontrast", b"Johann"), ("q", "original", b"  ")], "page string, variant string, image binary")
    readers = [R.Recognizer("a", R.PAGE, reader("a")), R.Recognizer("b", R.SEGMENTS, reader("b")), R.Recognizer("c", R.PAGE, reader("c", True))]
    found = sorted((r.page, r.variant, r.model, r.text) for r in R.recognize(images, readers).collect())
    assert found == [("p", "kontrast", "a", "Johann"), ("p", "original", "a", "Johann Schmidt"), ("p", "original", "b", "Johann Schmidt")]


def test_external_recognizer():
    parse = lambda out: pd.DataFrame({"line_order": [0], "text": [out], "confidence": [0.5]})
    row = pd.DataFrame({"page": ["p"], "variant": ["original"], "image": [b"abc"], "segmentation": ["<x/>"]})
    copy = "import sys; open(sys.argv[3], 'w').write(open(sys.argv[1]).read() + open(sys.argv[2]).read())"
    assert R.external([sys.executable, "-c", copy, "{image}", "{input}", "{output}"], parse)(row)["text"].tolist() == ["abc<x/>"]
    with pytest.raises(RuntimeError, match="oops"):
        R.external([sys.executable, "-c", "import sys; sys.exit('oops')"], parse)(row)


def test_page_counts(spark, tmp_path):
    directory = lambda order, after: struct.pack(order + "H", 1) + struct.pack(order + "HHII", 256, 3, 1, 5) + struct.pack(order + "I", after)
    tiff = b"II" + struct.pack("<HI", 42, 8) + directory("<", 26) + directory("<", 0)
    packed = zlib.compress(b"<</Type /Page>> <</Type/Pages>> <</Type/Page /X 1>>")
    pdf = b"%PDF-1.7 1 0 obj <</Type /Page /Parent 2>> 2 0 obj <</Type /Pages>> 3 0 obj <</Type /ObjStm /Length 9>> stream\n" + packed + b" endstream"
    (tmp_path / "a.tif").write_bytes(tiff)
    (tmp_path / "b.pdf").write_bytes(pdf)
    (tmp_path / "c.tiff").write_bytes(b"no")
    found = {r.path.rpartition("/")[2]: r.pages for r in discovery.page_counts(spark, str(tmp_path)).collect()}
    assert found == {"a.tif": 2, "b.pdf": 3, "c.tiff": None}


def test_pages_are_loaded_by_number(spark):
    pages = spark.createDataFrame([("d", 0, "x.png")], "document_id string, page_index int, source_path string")
    assert discovery.load_page(pages, "d", 0).collect()[0].source_path == "x.png"
    with pytest.raises(IndexError):
        discovery.load_page(pages, "d", 1)


def test_natural_keys_of_long_numbers(spark):
    names = ["a9", "a10", "a" + "1" * 25, "a" + "1" * 24 + "2", "a" + "9" * 24, "b0", "a007"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = [r.n for r in df.orderBy(text.natural_key(F.col("n"))).collect()]
    assert found == ["a007", "a9", "a10", "a" + "9" * 24, "a" + "1" * 25, "a" + "1" * 24 + "2", "b0"]


def test_variants_of_names_without_aliases(spark):
    names, pairs = spark.createDataFrame([("x",), ("y",)], "name string"), spark.createDataFrame([("x", "z")], "canonical string, alias string")
    assert sorted(map(tuple, store.alias_variants(names, pairs).collect())) == [("x", "x"), ("x", "z"), ("y", "y")]


def test_settings(tmp_path):
    place = tmp_path / "s" / "settings.json"
    assert Settings.load(place) == Settings()
    Settings(review_budget=2.5, output_dir="ö").save(place)
    place.write_text(place.read_text().replace("{", '{"unknown": 1,', 1))
    assert Settings.load(place) == Settings(review_budget=2.5, output_dir="ö")


def test_word_processor_files(spark):
    documents = spark.createDataFrame([("d", "Kirchenbuch <1872>", 1872, "handschrift"), ("e", "leer", None, None)], "document_id string, title string, year int, script_hint string")
    pages = spark.createDataFrame([("d", 1, "m", "original", 0.815, 0.08), ("d", 0, "m", "kontrast", 0.86, 0.125)], "document_id string, page_index int, model string, variant string, mean_confidence double, expected_cer double")
    lines = spark.createDataFrame([("d", 0, 1, "derung & mehr", 0.825), ("d", 0, 0, "Auswan-", 0.95), ("d", 1, 0, "Ende \x01", 0.5)], "document_id string, page_index int, line_order int, text string, confidence double")
    found = {r.document_id: bytes(r.content) for r in export.docx(documents, pages, lines).collect()}
    said = {}
    for key, content in found.items():
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            assert set(z.namelist()) == {"[Content_Types].xml", "_rels/.rels", "word/document.xml"}
            for name in z.namelist():
                ElementTree.fromstring(z.read(name))
            root = ElementTree.fromstring(z.read("word/document.xml"))
        said[key] = [p for p in ("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p")) if p]
    assert said["d"][:8] == ["Kirchenbuch <1872>", "Jahr: 1872", "Schrifthinweis: handschrift", export.TRANSCRIPT, "Seite 1", "Auswan-", "derung & mehr  [Sicherheit 82%]", "Seite 2"]
    assert said["d"][-3:] == [export.APPENDIX, "Seite 1: m, Variante kontrast, mittlere Sicherheit 86.0%, erwartete CER 12.5%", "Seite 2: m, Variante original, mittlere Sicherheit 81.5%, erwartete CER 8.0%"]
    assert "Auswanderung & mehr" in " ".join(said["d"]) and said["e"][1] == "Jahr: nicht angegeben"


def test_progress_words(spark):
    df = spark.createDataFrame([(-3.0, -0.2), (59.4, 0.125), (61.0, 0.995), (600.2, 2.0)], "s double, v double")
    assert [tuple(r) for r in df.select(text.elapsed(F.col("s")), text.progress(F.col("v"))).collect()] == [("0 s", 0), ("59 s", 12), ("1:01 min", 100), ("10:00 min", 100)]


def test_models_are_fetched_checked_and_removed(tmp_path):
    content = b"weights"
    good = Model("a", ("w.bin", "p/x.json"), "sha256:" + hashlib.sha256(content).hexdigest())
    kept = Registry(tmp_path / "m", [good, Model("b", ("w.bin",), "md5:00"), Model("../c", ("w",))])
    kept.install("a", lambda model, name: content)
    assert kept.is_installed("a") and [m["installed"] for m in Registry(tmp_path / "m", [good]).status()] == [True]
    with pytest.raises(RuntimeError):
        kept.install("b", lambda model, name: content)
    assert not kept.folder("b").exists()
    for act in (kept.remove, kept.folder):
        with pytest.raises(ValueError):
            act("../c")
    kept.remove("a")
    assert not kept.is_installed("a")
