"""Recognition, rules, merge, storage, exports, discovery, imaging and streaming."""

import csv
import io
import json
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark import cli
from quillmark.functions import text
from quillmark.operators import commits, export, imaging, lexical, merge, recognition, recognizers, rules, store
from quillmark.plans import catalog
from quillmark.sources import authority, discovery, pagexml
from quillmark.streaming import index

NONE = "cast(array() as array<struct<text:string,model:string,confidence:double>>)"


def test_boxes_around_polygons(spark):
    df = spark.range(1).select(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(-4, 30), (120, 28), (125, 55), (0, 57)])).alias("b"), F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(20, 90), (180, 92)])).alias("l"))
    w, h = F.lit(200), F.lit(120)
    row = df.select(recognition.boundary_box(F.col("b"), w, h).alias("b"), recognition.baseline_box(F.col("l"), w, h).alias("l")).collect()[0]
    assert tuple(row.b) == (0, 24, 130, 61) and tuple(row.l) == (12, 70, 188, 102)


def lines_df(spark, rows):
    df = spark.createDataFrame(rows, "page int, line_order int, text string, year int")
    return df.select("*", F.lit("m").alias("model"), F.lit(0.8).alias("confidence"), F.expr(NONE).alias("alternatives"))


def test_year_hint_keeps_the_reading(spark):
    rows = [(0, 0, "Sorau, am 28. April 1849", 1919), (0, 1, "Ort ohne Monat 1849", 1919), (0, 2, "1919 im Mai", 1919), (0, 3, "im Mai 1849", None)]
    found = {r.line_order: r for r in rules.year_hint(lines_df(spark, rows), F.col("year")).collect()}
    assert found[0].text == "Sorau, am 28. April 1919" and found[0].alternatives[0].text == rows[0][2] and found[0].model == "m+jahrangabe"
    assert [found[k].text for k in (1, 2, 3)] == [r[2] for r in rows[1:]]


def test_civil_register_form(spark):
    said = ["Dc. 145.", "Der Standesbeamte.", "verstorben sei.", "Wor dem Anzeiger", "wäre in Sorau", "des Jahres x", "abc, genehmigt und unterschrieben.", "am zwanzigtx April", "sind setzte aus, das er"]
    rows = [(0, k, t, 1919) for k, t in enumerate(said)] + [(1, 0, "Dc. 145.", 1919), (1, 1, "Wor dem", 1919)]
    found = {(r.page, r.line_order): r for r in rules.civil_register(lines_df(spark, rows), ["page"], F.col("year")).collect()}
    assert [found[0, k].text for k in range(9)] == ["Nr. 145.", "Der Standesbeamte.", "verstorben sei.", "Vor dem Anzeiger", "wohnhaft in Sorau", "des Jahres tausend neunhundert und neunzehn", "Vorgelesen, genehmigt und unterschrieben.", "am zwanzigsten April", "und zeigte an, daß er"]
    assert found[0, 0].alternatives[0].text == "Dc. 145." and found[0, 0].model == "m+standesformular" and found[1, 0].text == "Dc. 145."


def test_merge_of_readings():
    line = lambda t, y, c, m="x": merge.Line(t, m, c, (0, y, 100, y + 20), [])
    best = [line("Johann Schmidt aus Sorau", 0, 0.4), line("zweite Zeile", 40, 0.9)]
    others = [("tesseract:deu", [line("Johann Schmidt aus Soran", 2, 0.95, "tesseract:deu"), line("neue Zeile", 200, 0.7), line("schwach", 300, 0.5)]), ("trocr-x", [line("zweite Zeilen", 41, 0.99)])]
    found, model = merge.merged(best, "trocr-y", others)
    assert [x.text for x in found] == ["Johann Schmidt aus Soran", "zweite Zeile", "neue Zeile"]
    assert found[0].alternatives[0]["text"] == "Johann Schmidt aus Sorau" and found[1].alternatives[0]["model"] == "trocr-x"
    assert model == "ensemble:tesseract:deu+trocr-y"


def test_second_readings_within_budget(spark):
    calls = spark.createDataFrame([(1, k, c) for k, c in enumerate([0.4, 0.4, 0.4, 0.2, 0.1])], "job int, seq int, cost double")
    found = recognition.within_budget(calls, "job", ["seq"], 1.0).orderBy("seq").collect()
    assert [r.accepted for r in found] == [True, True, False, True, False] and found[-1].spent == pytest.approx(1.0)


def exported(spark):
    rows = [("d1", 0, 0, "l0", "Auswan-"), ("d1", 0, 1, "l1", "derung & <Alt>-Schrift"), ("d1", 1, 0, "l2", "Seite zwei")]
    df = spark.createDataFrame(rows, "document_id string, page_index int, line_order int, line_id string, text string")
    box = F.struct(F.lit(1).alias("x1"), F.lit(2).alias("y1"), F.lit(30).alias("x2"), F.lit(40).alias("y2"))
    return df.select("*", F.lit(0.5).alias("confidence"), box.alias("bbox"), F.lit("m").alias("model"), F.lit("original").alias("variant"), F.lit("a.png").alias("source_path"), F.lit(100).alias("width"), F.lit(200).alias("height"))


def test_exports_and_page_xml_round_trip(spark, tmp_path):
    lines = exported(spark)
    original = export.original_text(lines).collect()[0].original
    assert original == "Auswan-\nderung & <Alt>-Schrift\n\n--- Seite ---\n\nSeite zwei\n"
    assert export.reading_text(lines).collect()[0].reading.startswith("Auswanderung & <Alt>-Schrift")
    parsed = pagexml.parse(export.page_xml(lines), ["document_id", "page_index"]).orderBy("page_index", "line_index").collect()
    assert [(r.text, r.confidence, r.x1, r.y2) for r in parsed] == [("Auswan-", 0.5, 1, 40), ("derung & <Alt>-Schrift", 0.5, 1, 40), ("Seite zwei", 0.5, 1, 40)]
    documents = spark.createDataFrame([("d1", "Kirchenbuch 1872", 1872)], "document_id string, title string, year int")
    pages = lines.select("document_id", "page_index", "width", "height").distinct()
    results = export.json_result(documents, pages, lines)
    assert json.loads(results.collect()[0].json)["title"] == "Kirchenbuch 1872"
    files = export.bundle(documents, lines, export.page_xml(lines), results)
    export.write_files(files, str(tmp_path))
    folder = tmp_path / "Kirchenbuch-1872-d1"
    assert (folder / "lesefassung.txt").exists() and (folder / "pagexml" / "seite_0002.xml").exists()
    assert "result.json" in zipfile.ZipFile(io.BytesIO((folder / "Kirchenbuch-1872-d1.zip").read_bytes())).namelist()
    boxes = lines.select(F.lit("p").alias("page"), "source_path", "width", "height", "line_order", "bbox").where("line_id = 'l0'")
    assert 'id="line_0000"' in export.segmentation_xml(boxes).collect()[0].xml
    assert [r.pages for r in export.batch_index(documents, pages).collect()] == [2]


def test_storage(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    assert sorted(map(tuple, store.replace_by_key(old, new, ["k"]).collect())) == [("a", 9), ("b", 1)]
    assert [r.k for r in store.remove(old, new, ["k"]).collect()] == ["b"]
    assert {r.k: r.v for r in store.latest(old.withColumn("t", F.col("v")), "k", ["t"], ["v"]).collect()} == {"a": 2, "b": 1}
    tables = commits.Snapshots(spark, str(tmp_path))
    assert tables.version("x") == 0
    tables.write("x", old)
    tables.write("x", new)
    assert tables.version("x") == 2 and tables.read("x").count() == 1
    pairs = spark.createDataFrame([("Müller", "Möller"), ("müller", "MÖLLER"), ("", "x")], "canonical string, alias string")
    assert [tuple(r) for r in store.aliases(pairs).collect()] == [("mueller", "moeller")]


def test_composed_everywhere_text_is_normalised(spark, tmp_path):
    """Typed with combining marks, as some systems do: stored, corrected, streamed and named as with composed letters."""
    apart = "Mu\u0308ller Stra\u00dfe"
    lines = spark.createDataFrame([("a", "x", "x"), ("b", "y", "y")], "line_id string, text string, normalized string")
    edits = spark.createDataFrame([("a", 1, f" {apart} "), ("a", 0, "old")], "line_id string, seq int, new_text string")
    found = {r.line_id: (r.text, r.normalized, r.manually_corrected) for r in store.corrected(lines, edits).collect()}
    assert found == {"a": ("Müller Straße", "mueller strasse", True), "b": ("y", "y", False)}
    with pytest.raises(KeyError, match="c"):
        store.corrected(lines, edits.unionByName(spark.createDataFrame([("c", 1, "x")], edits.schema)))
    assert [r.line_id for r in store.unknown_edits(lines, spark.createDataFrame([("c", 1, "x"), ("a", 1, "x")], edits.schema)).collect()] == ["c"]
    pairs = spark.createDataFrame([(apart, "Mo\u0308ller"), (None, "x")], "canonical string, alias string")
    assert [tuple(r) for r in store.aliases(pairs).collect()] == [("mueller strasse", "moeller")]
    spark.createDataFrame([("a", apart)], "line_id string, text string").write.parquet(f"{tmp_path}/in")
    index.follow(spark.readStream.schema("line_id string, text string").parquet(f"{tmp_path}/in"), f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    assert {r.token for r in spark.read.parquet(f"{tmp_path}/index").collect()} == {"müller", "straße", "mueller", "strasse"}
    held = spark.createDataFrame([("a", [(apart, 1), (None, 2)]), ("b", [("x", 3)]), ("c", None), ("d", [])], "line_id string, alternatives array<struct<text:string,n:int>>")
    assert {r.line_id: r.alternatives and [tuple(x) for x in r.alternatives] for r in text.compose_field(held, "alternatives", "text").collect()} == {"a": [("Müller Straße", 1), (None, 2)], "b": [("x", 3)], "c": None, "d": []}


def test_search_results_are_stored(spark, tmp_path):
    hits = spark.createDataFrame([("Buch \"A\"", 1872, 0, "Haus, am See", "Wort", 0.5), ("B", None, 4, "x", "Wort", 0.75)], "document_title string, year int, page_index int, text string, reason string, score double")
    export.write_search_results(hits, f"{tmp_path}/out")
    (stored,) = (tmp_path / "out").glob("*.csv")
    assert list(csv.reader(stored.open(encoding="utf-8"))) == [["Dokument", "Jahr", "Seite", "Text", "Trefferart", "Bewertung"], ["B", "", "5", "x", "Wort", "75%"], ["Buch \"A\"", "1872", "1", "Haus, am See", "Wort", "50%"]]


def png(path, gray):
    h, w = gray.shape
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in gray)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def scan():
    page = np.full((200, 300), 225.0)
    for y in (40, 90, 140):
        page[y : y + 14, 40:260:3] = 30
    return page


def test_discovery_and_images(spark, tmp_path):
    for name in ("A/seite10.png", "A/seite2.png", "A/seite1.PNG", "B/x.png"):
        png(tmp_path / name, scan())
    (tmp_path / "B" / "alt.pdf").write_bytes(b"%PDF")
    (tmp_path / "B" / "note.txt").write_text("x")
    found = discovery.documents(discovery.files(spark, str(tmp_path))).collect()
    assert [(r.title, r.kind, r.page_count) for r in found] == [("A", "images", 3), ("alt", "pdf", None), ("B", "images", 1)]
    assert [p.rsplit("/", 1)[1] for p in found[0].source_paths] == ["seite1.PNG", "seite2.png", "seite10.png"]
    assert all(len(r.id) == 20 for r in found)
    rows = imaging.prepared(discovery.load_images(spark, str(tmp_path / "B"))).orderBy("position").collect()
    assert [r.name for r in rows] == list(imaging.VARIANTS)
    boxes = [tuple(b) for b in rows[0].boxes]
    assert len(boxes) == 3 and boxes == sorted(boxes, key=lambda b: (b[1], b[0]))


def test_binary_variant_and_skew():
    out = imaging.variants(scan())
    assert list(out) == list(imaging.VARIANTS) and all(v.shape == (200, 300) for v in out.values())
    assert len(np.unique(out["binarisiert"])) <= 2
    tilted = imaging.deskewed(scan(), 3.0)
    assert abs(abs(imaging.skew(tilted)) - 3.0) <= 1.0 and imaging.skew(np.full((50, 50), 255.0)) == 0.0


def test_authority_cache(spark):
    body = json.dumps({"member": [{"id": "https://d-nb.info/gnd/118", "preferredName": "Schmidt, J", "variantName": ["Smith"], "dateOfBirth": ["1800"], "professionOrOccupation": [{"label": "Maler"}]}]})
    cache = spark.createDataFrame([("schmidt", body, 1000.0)], "name_key string, body string, fetched_at double")
    row = authority.lookup(cache, " Schmidt ", 2000.0).collect()[0]
    assert (row.gnd_id, row.name, row.birth, row.death, row.occupations) == ("118", "Schmidt, J", "1800", None, ["Maler"])
    assert authority.lookup(cache, "Schmidt", 1e9).count() == 0
    assert authority.lookup(cache, "Schmidt", 1e9, lambda q: body if "preferredName" in q["q"] else "").count() == 1


def test_authority_of_a_table_of_names(spark, tmp_path):
    archive, asked = commits.Snapshots(spark, str(tmp_path / "archive")), tmp_path / "asked"
    asked.mkdir()

    def fetch(parameters):
        name = parameters["q"].split('"')[1]
        (asked / f"{name} {len(list(asked.iterdir()))}").touch()  # calls run in other processes
        if name == "Offline":
            raise OSError("no connection")
        return json.dumps({"member": [{"id": f"https://d-nb.info/gnd/{name}-{n}", "preferredName": name} for n in range(1 if name == "None" else 2)]})

    def calls():
        found = sorted(p.name.split()[0] for p in asked.iterdir())
        for p in asked.iterdir():
            p.unlink()
        return found

    names = spark.createDataFrame([(n,) for n in ["Groß", " gross ", "GROSS", "Maier", "Offline", "", " ", None, "Maier"]], "name string")
    found = {(r.asked, r.gnd_id) for r in authority.resolve(names, archive, 1000.0, fetch).collect()}
    (first,) = {n for _, n in found if n.endswith("-0") and not n.startswith("Maier")}
    assert {a for a, _ in found} == {"Groß", " gross ", "GROSS", "Maier"} and len(found) == 8 and len(calls()) == 3
    more = names.unionByName(spark.createDataFrame([("Neu",)], names.schema))
    assert authority.resolve(more, archive, 2000.0, fetch).count() == 10 and calls() == ["Neu", "Offline"]
    assert authority.resolve(names, archive, 1000.0 + authority.LIFETIME, fetch).count() == 8 and len(calls()) == 3
    assert authority.resolve(names.limit(0), archive, 5000.0, fetch).collect() == [] and calls() == []
    keys = [r.name_key for r in archive.read(authority.CACHE).collect()]
    assert sorted(keys) == ["gross", "maier", "neu"] and first


def test_incremental_index(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, "line_id string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for rows in ([("a", "Haus am See")], [("b", "Haus")]):
        write(rows)
        index.follow(spark.readStream.schema("line_id string, text string").parquet(f"{tmp_path}/in"), f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    counts = {r.token: r.n for r in spark.read.parquet(f"{tmp_path}/index").groupBy("token").agg(F.countDistinct("line_id").alias("n")).collect()}
    assert counts == {"haus": 2, "am": 1, "see": 1}


def test_lines_are_counted_by_token_without_bringing_them_together(spark, tmp_path):
    """Memory of a task follows its tokens, not the lines of each; lines that came several times count once."""
    spark.createDataFrame([(k, f"Haus am See {k}\nHaus, haus\n\n") for k in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("stream_incremental_index", "token_doc_freq"):
        found = catalog.QUERIES[name](spark, str(tmp_path))
        rows = {r.token: (r.lines, r.n) for r in found.collect()}
        assert rows["haus"] == (80, 240) and rows["am"] == (40, 80) and rows["7"] == (1, 2) and len(rows) == 43
        exchanged = re.findall(r"hashpartitioning\((.*?), \d+\)", found._jdf.queryExecution().toString())
        assert exchanged and not any("line_id" in keys for keys in exchanged), exchanged
    rows = [("a", "Haus am Haus", "haus am haus x"), ("b", None, "z z"), ("c", "", ""), ("a", "am See", "am see"), ("a", "am See", "am see"), (None, "Haus", "haus"), (None, "Haus", "haus")]
    lines = spark.createDataFrame(rows, "line_id string, text string, normalized string")
    marked, plain = lexical.marked_postings(lines), lexical.postings(lines)
    assert sorted(map(str, marked.drop("first").collect())) == sorted(map(str, plain.collect()))
    want = plain.groupBy("token").agg(F.countDistinct("line_id").alias("lines"), F.count("*").alias("n"))
    assert sorted(map(tuple, lexical.frequencies(marked, lines).collect())) == sorted(map(tuple, want.collect()))
    for text_ in ("Haus am See", "Haus"):  # one line in two batches
        spark.createDataFrame([("a", text_), (text_, text_)], "line_id string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        index.follow(spark.readStream.schema("line_id string, text string").parquet(f"{tmp_path}/in"), f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    assert {tuple(r) for r in index.frequencies(spark, f"{tmp_path}/index").collect()} == {("haus", 3, 8), ("am", 2, 4), ("see", 2, 4)}


def test_command_line(spark, tmp_path, capsys):
    lines = spark.createDataFrame([("l1", "d1", 0, "Johann Schmidt", 0.9)], "line_id string, document_id string, page_index int, text string, confidence double")
    lines.withColumn("bbox", F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>")).write.parquet(f"{tmp_path}/lines.parquet")
    spark.createDataFrame([("d1", "Buch", 1872)], "document_id string, title string, year int").write.parquet(f"{tmp_path}/documents.parquet")
    cli.main(["search", str(tmp_path), "Schmitt", "--mode", "namen", "--fuzziness", "0.6"], spark)
    assert "Buch\t1\t" in capsys.readouterr().out


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def same(a, b):
    rows = lambda df: sorted(([round(x, 9) if isinstance(x, float) else x for x in r] for r in df.select(*a.columns).collect()), key=str)
    return rows(a) == rows(b)


def test_words_that_come_by_lines_are_grouped_without_an_exchange(spark):
    rng = np.random.default_rng(3)
    rows = [("d", int(p), 0, 0, int(n), int(w), str(rng.choice([" ", "", "a ", "Wort", " b"])), float(rng.integers(-10, 100)), int(10 * w), int(60 * n + w % 3), int(10 * w + 9), int(60 * n + 40)) for p in range(4) for n in range(5) for w in rng.permutation(rng.integers(0, 6))]
    rows += [("d", 9, 0, 0, 0, 0, "x", -1.0, 1, 1, 2, 2), ("d", 9, 0, 0, 1, 0, " ", 5.0, 1, 1, 2, 2)]
    flat = spark.createDataFrame(rows, "document_id string, page_index int, block int, par int, line int, word int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    keys, word = ["document_id", "page_index"], F.struct("word", "text", "confidence", "x1", "y1", "x2", "y2")
    whole = spark.createDataFrame(flat.groupBy(*keys, "block", "par", "line").agg(F.collect_list(word).alias("words")).collect(), flat.select(*keys, "block", "par", "line", F.array(word).alias("words")).schema)
    assert same(recognition.lines_of_words(flat, keys), recognition.lines_of_words(whole, keys)) and exchanges(recognition.lines_of_words(whole, keys)) == 1
    boxed = flat.withColumnRenamed("line", "segment").withColumn("bbox", F.lit(1))
    nested = whole.withColumnRenamed("line", "segment").withColumn("words", F.transform("words", lambda w: w.withField("bbox", F.lit(1))))
    assert same(recognizers.segment_lines(boxed, keys), recognizers.segment_lines(nested, keys)) and exchanges(recognizers.segment_lines(nested, keys)) == 0


def test_candidates_that_come_whole_are_rated_without_an_exchange(spark):
    said = ["Johann Schmidt", "", "", "", "", "aaaaaaaa####", " ", "Ä é ß!", "....", None, "x"]
    rows = [("p", k, n, said[(n * k + n) % len(said)], n / 50, 60 * n, 60 * n + 40) for k in range(6) for n in range(3 * k + 1)] + [("q", 0, n, t, 0.5, 0, 10) for n, t in enumerate(["", " ", "", "", ""])]
    flat = spark.createDataFrame(rows, "page string, position int, line_order int, text string, confidence double, y1 int, y2 int").select("*", F.lit("trocr-x").alias("model"), F.lit(2440).alias("page_height"))
    keys = ["page", "position", "model"]
    counted = flat.withColumns(dict(zip(("useful", "repeated", "blank"), text.quality_counts(F.col("text")), strict=True)))
    line = F.struct("line_order", "text", "confidence", "y1", "y2", "useful", "repeated", "blank")
    whole = counted.groupBy(*keys, "page_height").agg(F.collect_list(line).alias("lines"))
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    a, b = (recognition.scores(recognition.coverage(x, keys)) for x in (flat, whole))
    assert same(a, b) and exchanges(b) == 0


def test_pages_that_come_whole_are_merged_without_an_exchange(spark):
    rows = [(f"p{p}", k, f"tesseract:{k}", n, f"Zeile {n * (k + p) % 4} aus Sorau", "m", 0.3 + 0.1 * k, 0, 60 * n + k, 100, 60 * n + 30) for p in range(250) for k in range(3) for n in range(3)]
    flat = spark.createDataFrame(rows, "page string, rank int, candidate string, line_order int, text string, model string, confidence double, x1 int, y1 int, x2 int, y2 int")
    whole = flat.groupBy("page").agg(F.collect_list(F.struct(*merge.READING)).alias("readings"))
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    found = merge.merge(whole)
    assert same(merge.merge(flat), found) and exchanges(found) == 0 and found.count() == 750
    want, name = merge.merged([merge.Line(r[4], r[5], r[6], r[7:], []) for r in rows[:3]], "tesseract:0", [(f"tesseract:{k}", [merge.Line(r[4], r[5], r[6], r[7:], []) for r in rows[3 * k : 3 * k + 3]]) for k in (1, 2)])
    assert [(r.text, r.page_model, len(r.alternatives)) for r in found.where("page = 'p0'").orderBy("line_order").collect()] == [(x.text, name, len(x.alternatives)) for x in want]


def test_page_xml_is_read_a_few_files_at_a_time(spark):
    """A batch of large files is never held as lines whole."""
    xml = "<PcGts>" + "".join(f'<TextLine conf="0.5"><Coords points="1,2 3,4"/><Unicode>{"x" * 5000}</Unicode></TextLine>' for _ in range(30)) + "</PcGts>"
    pages = spark.createDataFrame([(i, xml if i % 2 else "<PcGts/>") for i in range(40)], "i int, xml string").coalesce(1)
    batch = next(iter(pages.toArrow().to_batches()))
    sizes = [p.num_rows for p in pagexml.S.slices(batch, "xml")]
    assert len(sizes) > 5 and sum(sizes) == batch.num_rows and pagexml.lines_of(xml)[0][1] == "x" * 5000
    found = pagexml.parse(pages, ["i"])
    assert {r.i: r.n for r in found.groupBy("i").agg(F.count("*").alias("n")).collect()} == {i: 30 for i in range(1, 40, 2)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
