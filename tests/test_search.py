"""Text functions, phonetics and search against plain Python and SQLite."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillmark.functions import phonetics, text
from quillmark.operators import fuzzy, lexical, search, semantic, store

CODES = {"Schmidt": "862", "Schmitt": "862", "Schmid": "86", "Müller": "657", "Johann": "06", "Johan": "06", "Anna": "06", "Weiß": "38", "Stadt": "822", "Katze": "48", "Philipp": "351", "Xaver": "837", "Carl": "475", "Christian": "47826", "Hans": "068"}


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_normalize_equals_the_string_function(spark):
    rng = random.Random(1)
    values = ["Schröder, Weiß", "ſchön ﬁn ﬂ ꝛ", "a_b-c  d", "é È ß", "", " \n", *("".join(rng.choices("aÄöß ſ_-,.;é1²ΣςµX\n", k=12)) for _ in range(300))]
    assert one(spark, values, text.normalize) == [text.normalize_string(v) for v in values]
    assert text.normalize_string("Schröder, Weiß") == "schroeder weiss"
    df = text.compose(spark.createDataFrame([("über",), ("plain",), (None,)], "v string"), "v")
    assert {r[0] for r in df.collect()} == {"über", "plain", None}


def test_phonetic_codes(spark):
    assert dict(zip(CODES, one(spark, list(CODES), phonetics.cologne), strict=True)) == CODES
    assert one(spark, ["C", "X", "", "42", "Dieter Ct"], phonetics.cologne)[:4] == ["4", "8", "", ""]


def test_language_quality_slug_natural_percent(spark):
    def quality(t):
        useful = sum(c.isalnum() or c in text.USEFUL for c in t)
        return max(0.0, min(1.0, useful / len(t) - 0.03 * sum(t.count(c * 4) for c in set(t)))) if t.strip() else 0.0

    values = ["aaaaaaaa bc", "  ", "äöü ß!", "####x", "normal text, fine."]
    assert one(spark, values, text.language_quality) == pytest.approx([quality(v) for v in values])
    assert one(spark, ["Kirchenbuch 1872 / A", "...", "ä ö"], text.slug) == ["Kirchenbuch-1872-A", "dokument", "ä-ö"]
    names = ["seite10.png", "seite2.png", "Seite1.png"]
    assert sorted(names, key=dict(zip(names, one(spark, names, text.natural_key), strict=True)).get) == ["Seite1.png", "seite2.png", "seite10.png"]
    assert one(spark, [0.125, 0.5, 0.995], text.percent, "double") == ["12%", "50%", "100%"]
    assert one(spark, ["Auswan-\nderung und Alt-\nSchrift\nx\n\ny  z"], text.reading) == ["Auswanderung und Alt- Schrift x\n\ny z\n"]


@pytest.fixture(scope="module")
def archive(spark):
    rows = [
        ("line-1", "doc-1", 0, "Johann Schmidt wanderte nach Amerika aus.", 0.82, []),
        ("line-2", "doc-1", 0, "Anna Müller blieb in Württemberg.", 0.91, [("Anna Moeller blieb", "m", 0.5)]),
        ("line-3", "doc-2", 0, "Ganz anderer Inhalt über Wetter und Ernte", 0.5, []),
    ]
    schema = "line_id string, document_id string, page_index int, text string, confidence double, alternatives array<struct<text:string,model:string,confidence:double>>"
    lines = spark.createDataFrame(rows, schema).withColumn("normalized", text.normalize(F.col("text"))).withColumn("bbox", F.struct(F.lit(10).alias("x1"), F.lit(20).alias("y1"), F.lit(900).alias("x2"), F.lit(60).alias("y2")))
    documents = spark.createDataFrame([("doc-1", "Kirchenbuch 1872", 1872), ("doc-2", "Chronik", None)], "document_id string, title string, year int")
    return search.Archive(lines, documents)


def ids(found):
    return [r.line_id for r in found.collect()]


def test_exact_and_name_search_and_correction(spark, archive):
    assert ids(search.search(archive, search.Query("Amerika", search.Mode.EXACT))) == ["line-1"]
    hit = search.search(archive, search.Query("Schmitt", search.Mode.NAMES, 0.65)).collect()[0]
    assert (hit.line_id, hit.reason) == ("line-1", fuzzy.SOUNDS)
    assert ids(search.search(archive, search.Query("Johan Schmitt", search.Mode.NAMES, 0.65)))[0] == "line-1"
    edits = spark.createDataFrame([("line-1", 1, "x"), ("line-1", 2, " Johann Schmid reiste nach Amerika. ")], "line_id string, seq int, new_text string")
    fixed = search.Archive(store.corrected(archive.lines, edits), archive.documents)
    assert ids(search.search(fixed, search.Query("Schmid", search.Mode.EXACT))) == ["line-1"]
    assert ids(search.search(fixed, search.Query("wanderte", search.Mode.EXACT))) == []
    assert "line-2" in ids(search.search(archive, search.Query("Moeller", search.Mode.INTELLIGENT)))
    assert ids(search.search(archive, search.Query("Amerika", year_from=1800, year_to=1850))) == []
    assert ids(search.search(archive, search.Query("..."))) == []
    with pytest.raises(ValueError):
        search.Query("")


def test_bm25_equals_sqlite(spark):
    rng = random.Random(3)
    said = [" ".join(rng.choices(["über", "haus", "hauses", "see", "baum", "weiß", "é", "x-y"], k=rng.randint(1, 12))) for _ in range(80)]
    lines = spark.createDataFrame([(f"l{i:03d}", t) for i, t in enumerate(said)], "line_id string, text string").withColumn("normalized", text.normalize(F.col("text")))
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(line_id unindexed, text, normalized, tokenize='unicode61 remove_diacritics 0')")
    c.executemany("insert into f values (?,?,?)", [(f"l{i:03d}", t, text.normalize_string(t)) for i, t in enumerate(said)])
    for query, exact, match in (("haus weiß", False, '"haus"* OR "weiss"*'), ("see baum", True, '"see baum"'), ("x-y", False, '"x-y"*')):
        want = dict(c.execute("select line_id, bm25(f, 0.0, 1.0, 0.5) from f where f match ?", (match,)).fetchall())
        found = {r.line_id: r.bm25 for r in lexical.search(lexical.postings(lines), lexical.lengths(lines), query, exact, 200).collect()}
        assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], rel_tol=1e-9) for k in want)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def plain(a, b):
    if not a or not b:
        return 0.0
    best = 0.0
    for s, t in ((a, b), (b, a)) if len(a) == len(b) else ((min(a, b, key=len), max(a, b, key=len)),):
        m = len(s)
        for k in range(1 - m, len(t)):
            w = t[max(0, k) : k + m]
            best = max(best, 200.0 * lcs(s, w) / (m + len(w)))
    return best


def test_partial_ratio_equals_its_definition(monkeypatch):
    rng = random.Random(2)
    for n in range(60):
        monkeypatch.setattr(fuzzy, "PLACES", 40 if n % 2 else 400_000)
        query = "".join(rng.choices("abc d", k=rng.randint(1, 9)))
        texts = ["".join(rng.choices("abc d", k=rng.randint(0, 25))) for _ in range(8)]
        assert fuzzy.partial_ratios(query, texts).tolist() == pytest.approx([plain(query, t) for t in texts])
    monkeypatch.setattr(fuzzy, "BITS", 5)  # patterns of many words
    for _ in range(60):
        query = "".join(rng.choices("abc d", k=rng.randint(4, 22)))
        texts = ["".join(rng.choices("abc d", k=k)) for k in (0, 1, 4, 5, 6, 10, 21, len(query), 30)]
        assert fuzzy.partial_ratios(query, texts).tolist() == pytest.approx([plain(query, t) for t in texts])


def test_partial_ratio_of_long_queries():
    rng = random.Random(3)
    for m in (62, 63, 64, 65, 126, 130):
        query = "".join(rng.choices("abcd ", k=m))
        texts = ["".join(rng.choices("abcd ", k=k)) for k in (3, 63, 64, m, m + 5)] + [query[1:] + "x", "zz" + query + "z", query[:40] + "ä" + query[40:]]
        assert fuzzy.partial_ratios(query, texts).tolist() == pytest.approx([plain(query, t) for t in texts])
    assert fuzzy.partial_ratios("", ["a"]).tolist() == [0.0] and fuzzy.partial_ratios("a" * 70, []).tolist() == []


def test_fuzzy_scores_lines_beyond_the_former_cap(spark):
    rng = random.Random(6)
    said = ["".join(rng.choices("abcdefgh ", k=20)) for _ in range(40)]
    rows = [(f"l{i:05d}", rng.choice(said), 0.9) for i in range(20_500)] + [("x1", "thonerly heed", 0.1), ("x2", "a thonerly hede", 0.2)]
    lines = spark.createDataFrame(rows, "line_id string, normalized string, confidence double")
    score = {t: plain("thonerly heed", t) for t in {r[1] for r in rows}}
    want = sorted(((-score[t] / 100, i) for i, t, _ in rows if score[t] >= 45))[:200]
    found = fuzzy.search(lines, "thonerly heed", 0.4, False, 200).orderBy("rank").collect()
    assert [(r.line_id, r.raw) for r in found] == [(i, pytest.approx(-s)) for s, i in want] and found[0].line_id == "x1"
    archive = search.Archive(lines.withColumns({"document_id": F.lit("d"), "page_index": F.lit(0), "bbox": F.lit(None).cast("string"), "text": F.col("normalized")}), spark.createDataFrame([("d", "t", 1900)], "document_id string, title string, year int"))
    for mode in (search.Mode.INTELLIGENT, search.Mode.NAMES):
        assert {"x1", "x2"} <= set(ids(search.search(archive, search.Query("thonerli heed", mode, 0.65))))
    assert "x1" not in {r.line_id for r in fuzzy.search(lines, "thonerly heed", 0.4, False, 200, candidate_cap=20_000).collect()}


def test_semantic_search_and_missing(spark):
    vectors = spark.createDataFrame([("a", "r1", [1.0, 0.0]), ("b", "r1", [0.6, 0.8]), ("c", "r0", [0.0, 1.0]), ("d", "r1", [1.0])], "line_id string, revision string, embedding array<float>")
    assert [(r.line_id, r.rank) for r in semantic.search(vectors, [0.0, 1.0], 2).orderBy("rank").collect()] == [("c", 0), ("b", 1)]
    lines = spark.createDataFrame([("a", "long"), ("c", "long"), ("e", "ab"), ("f", "abc")], "line_id string, text string")
    assert sorted(r.line_id for r in semantic.missing(lines, vectors, "r1").collect()) == ["c", "f"]

    class Length:
        revision = "r2"

        def __call__(self, texts):
            return [[len(t), 1.0] for t in texts]

    found = {r.line_id: list(r.embedding) for r in semantic.encode(lines, Length, "r2").collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in found.values()) and len(found) == 4


def test_searches_read_the_lines_once(spark):
    """One plan node cuts all lines into tokens; the collection's figures and the scores share its exchange."""
    words = "the heed of thon erly theme".split()
    rng = random.Random(4)
    rows = [(f"l{k:03}", " ".join(rng.choices(words, k=rng.randint(0, 9)))) for k in range(300)] + [("many", "of the " * 4000)]
    lines = spark.createDataFrame(rows, "line_id string, text string").withColumn("normalized", text.normalize(F.col("text")))
    index = lexical.postings(lines)
    for query, exact in (("of the", True), ("heed", False), ("thon erly the", False), ("thon-erly", False)):
        found = lexical.search_lines(lines, query, exact, 50)
        same = [tuple(r) for r in found.orderBy("rank").collect()]
        assert same == [tuple(r) for r in lexical.search(index, lexical.lengths(lines), query, exact, 50).orderBy("rank").collect()]
        assert same == [tuple(r) for r in lexical.search(index, lines.select("line_id"), query, exact, 50).orderBy("rank").collect()]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
        phrases = lexical.parse(query, exact)
        hits = lambda t, p: sum(all(x.startswith(w) if p.prefix and j == len(p.tokens) - 1 else x == w for j, (x, w) in enumerate(zip(t[i:], p.tokens, strict=False))) for i in range(len(t) - len(p.tokens) + 1))  # noqa: B023, E731
        tf = {k: [1.5 * hits(t.split(), p) for p in phrases] for k, t in rows}
        sizes = {k: 2 * len(t.split()) for k, t in rows}
        mean, n = sum(sizes.values()) / len(rows), len(rows)
        held = [sum(v[k] > 0 for v in tf.values()) for k in range(len(phrases))]
        idf = [max(math.log((n - h + 0.5) / (h + 0.5)), 0) or 1e-6 for h in held]
        want = {k: -sum(i * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * sizes[k] / mean)) for i, x in zip(idf, v, strict=True)) for k, v in tf.items() if any(v)}
        assert [r[0] for r in same] == sorted(want, key=lambda k: (round(want[k], 12), k))[:50] and [r[1] for r in same] == pytest.approx([want[r[0]] for r in same])


def test_fuzzy_search_exchanges_only_lines_that_reach_the_score(spark):
    lines = spark.createDataFrame([("a", "thonerly heed", 0.5), ("b", "nothing alike", 0.5), ("c", None, 0.5)], "line_id string, normalized string, confidence double")
    found = fuzzy.search(lines, "thonerly heed", 0.6, False, 10)
    assert [r.line_id for r in found.collect()] == ["a"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "60.0" in plan[plan.index("Aggregate"):]  # the filter stands below the grouping
