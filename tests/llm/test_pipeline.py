import random

import corpus_pipeline


def test_stages_run_and_keep_columns(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["the", "house", "river", "green", "walks", "quietly", "seven", "birds", "over", "night"]) + str(rng.randrange(30)) * (rng.random() < 0.4) for _ in range(n)).capitalize() + "."
    base = [(k, "\n".join(say(rng.randint(15, 40)) for _ in range(4)), "en", "s", None) for k in range(80)]
    item = say(20)
    leak = (500, say(30) + "\n" + item + "\n" + say(30), "en", "s", None)
    copies = [(k + 100, base[k][1], "en", "s", None) for k in range(10)]
    rows = [*base, *copies, leak, (600, None, None, None, None), (601, "", "en", "s", None), (602, "1 2 3", "en", "s", None), (None, say(40), "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r[0] for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == before.columns
    assert not ids["language_id"] & {600, 601, 602} and ids["language_id"] >= {k for k in range(80)} | {500, None}
    assert not ids["line_dedup"] & set(range(100, 110)) and ids["line_dedup"] >= set(range(80)) | {500, None}
    assert ids["near_dedup"] >= set(range(80)) | {500, None}
    assert ids["decontamination"] == ids["near_dedup"] - {500} == ids["packing"]
    assert len(corpus_pipeline.STAGES) == 5
