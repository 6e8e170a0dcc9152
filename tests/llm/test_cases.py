"""Cases that every operator and stage has to answer: empty tables, repeated ids, clashing columns, hot groups."""

import itertools
import random

import corpus_pipeline
from quillmark.llm import html, minhash, quality
from tests.llm.test_documents import SCHEMA, bag, changed, jaccard, prose, words

#: Names that the operators use inside.
CLASHING = ("key", "left", "removed", "class_id", "__gone", "__text", "__html", "node", "score", "c0", "count")


def written(spark, folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_of_an_empty_table(spark, tmp_path):
    written(spark, tmp_path, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), [(1, "one two three four five six seven")])
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and "sequence_id" in found.columns


def test_pipeline_of_repeated_ids_and_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    texts = [prose(rng, 40) + "\n" + prose(rng, 30) for _ in range(30)]
    long = " ".join(prose(rng, 500, 900) for _ in range(60))
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(3, texts[3], "en"), (3, prose(rng, 50), "en"), (90, long, "en"), (None, prose(rng, 50), None)]
    docs = spark.createDataFrame([(*r, *[f"{c}{k}" for c in CLASHING]) for k, r in enumerate(rows)], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    written(spark, tmp_path, docs, [(1, prose(rng, 20))])
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.schema.simpleString() == before.schema.simpleString()
            kept = docs.collect()
            sizes.append(len(kept))
            for r in kept:  # a row's extra values stay together
                assert len({r[c][len(c) :] for c in CLASHING}) == 1
    assert {r.doc_id for r in kept} == {*range(30), 90, None}
    assert sizes[0] == len(rows) and sizes[-1] == len({*range(30), 90, None})
    assert {r.doc_id for r in docs.collect()} == {*range(30), 90, None}


def test_large_groups_are_compared_in_all_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(2)
    rows, text = [], prose(rng, 80)
    for k in range(60):  # near copies that drift, of which distant ones are not alike
        rows.append((k, text, "en", "s", "b"))
        text = changed(rng, text, rng.choice((1, 2, 3)))
    rng.shuffle(rows)
    label = {r[0]: r[0] for r in rows}
    bags = {r[0]: bag(words(r[1])) for r in rows}
    for a, b in itertools.combinations(sorted(bags), 2):
        if jaccard(bags[a], bags[b]) >= 0.8:
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    assert {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()} == label


def test_html_and_quality_of_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(pages, html.trained(), ["page_id", "url"]).collect() == []
    clashing = spark.createDataFrame([(1, "u", "v", "<p>one two</p>")], "page_id long, __html string, text string, html string")
    found = html.extract(clashing, html.trained(), ["page_id", "__html", "text"])
    assert found.columns == ["page_id", "__html", "text", "n_chars"] and found.collect()[0][:2] == (1, "u")
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(docs, model, ["doc_id"]).collect() == []
