"""Spelling variants, against all pairs."""

import itertools
import random
import zlib
from collections import Counter

import duckdb
import pytest

from quillmark.llm import spelling


def one_edit(a, b):
    a, b = sorted((a, b), key=len, reverse=True)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(n):
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return rows


@pytest.mark.parametrize("hot", [2, 1000])
def test_variants_equal_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "HOT_ROWS", 4 * hot)
    monkeypatch.setattr(spelling, "SHARD", 200)
    monkeypatch.setattr(spelling, "PAIRS", 50)
    rng = random.Random(hot)
    # letters of few kinds: many words share halves; empty and very long words, and one beyond the first plane
    words = {"".join(rng.choices("abé", k=rng.randint(0, 9))) for _ in range(600)} | {"x" * 5000, "x" * 5001, "x" * 4000 + "y" + "x" * 999, "😀b", "😀"}
    n = {w: rng.choice((2, 3, 5, 30, 400, 5000)) for w in words}
    rows = [(w, k, "own") for w, k in n.items()]
    found = spelling.variants(spark.createDataFrame(rows, "word string, n long, root string")).collect()
    assert len(found) == len(n) and {tuple(r) for r in found} == brute(n)


def test_hot_halves_are_halved_again(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT", 8)
    words = ["begin" + a + b + "x" for a in "abcdefgh" for b in "abcdefgh"]
    levels = spelling.segments(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    assert levels.where("not scanned").groupBy("key").count().agg({"count": "max"}).collect()[0][0] <= 8
    found = spelling.variants(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()
    assert {r.n_near for r in found} == {14} and len(found) == 64


def test_null_words_and_empty_tables(spark):
    rows = [(None, 5), ("a\0b", 5), ("ab", 50), ("abc", 5)]
    found = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert found == {(None, None, None, 5, 0, None), ("a\0b", None, "a\0b", 5, 0, None), ("ab", None, "ab", 50, 1, None), ("abc", "ab", "ab", 5, 1, 50)}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_query_equals_its_sql_and_a_plain_count(spark, tmp_path):
    rng = random.Random(4)
    stems = ["archive", "ÄRZTEhaus", "überführung", "lettering", "éçàmùöß", "quillmarks", "short", "naïveté" * 3]
    texts = []
    for _ in range(300):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choices(stems, [200, 20, 20, 3, 3, 3, 3, 3])[0]
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "x", "É"]) + w[k + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice((" ", "-", "7", "中", "ŵ")).join(words))
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[4]), (None, texts[5]), (900, None), (901, ""), (902, "archive " * 60_000)]
    spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, n long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(str, map(tuple, spelling.op11_spelling(spark, str(tmp_path)).collect())))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, c.execute(spelling.ORACLE).fetchall())) == found
    n = Counter()
    for k, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch <= "Z" else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
                n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    assert sorted(map(str, brute({w: k for w, k in n.items() if len(w) >= 7 and k >= 2}))) == found
    assert len(found) > 60
