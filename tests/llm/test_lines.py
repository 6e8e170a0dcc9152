import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import _shared as S
from quillmark.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out) + 1), rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("abcß"))
        elif out and kind == 1:
            out.pop(min(at, len(out) - 1))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice("abcß")
    return "".join(out)


def within(pairs, most):
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    points, offsets = S.code_points([x for pair in pairs for x in pair])
    start, length = offsets[:-1], np.diff(offsets)
    return L.within(points, S.Rolling(points), (start[::2], length[::2]), (start[1::2], length[1::2]), most).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=70), st.text("abc", max_size=70)), min_size=1, max_size=5), st.integers(0, 5))
def test_banded_distance_of_any_texts(pairs, most):
    assert within(pairs, most) == [distance(a, b) <= most for a, b in pairs]


def test_banded_distance_of_like_texts(monkeypatch):
    rng = random.Random(1)
    for cells in (300, 1_000_000):
        monkeypatch.setattr(L, "CELLS", cells)
        for most in range(5):
            pairs = []
            for _ in range(60):
                a = "".join(rng.choices("abc", k=rng.randint(0, 120)))
                pairs.append((a, edited(rng, a, rng.randint(0, 5))))
            assert within(pairs, most) == [distance(a, b) <= most for a, b in pairs]


def test_long_lines_meet_quickly():
    rng = random.Random(9)
    a = "".join(rng.choices("abcdefgh ", k=60_000))
    b = a[:30_000] + "é" + a[30_001:50_000] + a[50_001:]
    assert within([(a, b), (a, b[:-1] + "é")], 2) == [True, False]


@pytest.mark.parametrize("t", [1, 2, 3])
def test_like_lines_share_an_indexed_key(t):
    rng = random.Random(t)
    segments = L.Segments(t, 20)
    for _ in range(400):
        a = "".join(rng.choices("ab", k=rng.randint(20, 80)))
        b = edited(rng, a, rng.randint(0, t))
        if len(b) < 20 or a == b:
            continue
        points, offsets = S.code_points([a, b] if len(a) <= len(b) else [b, a])
        rolling, start, length = S.Rolling(points), offsets[:-1], np.diff(offsets)
        own, (rows, more) = segments.index(rolling, start, length), segments.probes(rolling, start, length)
        assert set(own[0].tolist()) & {*own[1].tolist(), *more[rows == 1].tolist()}


def test_sketches_never_miss():
    rng = random.Random(2)
    for _ in range(500):
        a = "".join(rng.choices("abcdef ", k=rng.randint(20, 80)))
        b = edited(rng, a, 2)
        found = L.Lines([a, b], 0)
        x, y = found.sketch()
        assert int(x ^ y).bit_count() <= 4


def fixture(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcde ", k=rng.randint(15, 60))) for _ in range(25)]
    docs = []
    for k in range(60):
        picked = [edited(rng, rng.choice(base), rng.choice((0, 0, 1, 2, 3))) for _ in range(rng.randint(0, 6))]
        docs.append((k, "\n".join(picked), "clash"))
    dense = "".join(rng.choices("abcde ", k=44))  # many near copies of one line
    docs += [(100 + k, edited(rng, dense, rng.choice((0, 1, 1, 2))) + "\n" + edited(rng, dense, 1), "y") for k in range(30)]
    return [*docs, (60, None, None), (61, "", "x"), (None, base[0], "x"), (62, "Ä" * 50_000 + "\n" + base[1] * 3, "x")]


def brute(docs, t=L.DISTANCE, least=L.MIN_CHARS):
    """Removed line numbers by comparing all lines with all."""
    first = {}
    for key, text, _ in docs:
        if key is not None:
            for n, line in enumerate((text or "").split("\n")):
                if len(line) >= least:
                    first[line] = min(first.get(line, (key, n)), (key, n))
    return first


def classes_of(texts, near):
    label = {x: x for x in texts}
    for a, b in near:
        old, new = label[a], label[b]
        label = {x: new if y == old else y for x, y in label.items()}
    return label


@pytest.mark.parametrize("split", [False, True])
def test_links_classes_and_removals_equal_brute_force(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(L, "SAMPLE", 1)
        monkeypatch.setattr(L, "HOT_LINES", 2)
        monkeypatch.setattr(L, "BLOCK", 3)
    docs = fixture(3)
    df = spark.createDataFrame(docs, "doc_id long, text string, key string")
    first = brute(docs)
    hashes = {line: int(L.Lines([line], 0).hashes().view(np.int64)[0]) for line in first}
    texts = sorted(first)
    want = {(a, b) for i, a in enumerate(texts) for b in texts[:i] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    assert len(want) > 300
    degree = {x: sum(x in pair for pair in want) for x in texts}
    found = {r.doc_id: r for r in L.repeated(df, classes=True).collect()}
    lines = {key: (text or "").split("\n") for key, text, _ in docs if key is not None}
    times = Counter(x for k in lines for x in lines[k])
    label = classes_of(texts, want)
    name = {c: min(hashes[x] for x in texts if label[x] == c) for c in set(label.values())}
    for key, own in lines.items():
        linked = [(n, name[label[x]]) for n, x in enumerate(own) if x in first and (times[x] > 1 or degree[x])]
        row = found.get(key)
        assert ([tuple(c) for c in row.line_classes] if row else []) == linked
        assert (row.n_links if row else 0) == sum(degree[x] for x in own if x in first)
    order = {line: (first[line][0], hashes[line]) for line in texts}
    dropped = {max(pair, key=order.get) for pair in want}
    expected = {}
    for key, text, _ in docs:
        if key is not None:
            gone = [n for n, x in enumerate((text or "").split("\n")) if x in first and (x in dropped or first[x] != (key, n))]
            expected[key] = gone
    got = {r.doc_id: r.removed for r in L.repeated(df).collect()}
    assert {k: got.get(k, []) for k in expected} == expected
    stage = {r.doc_id: r.text for r in L.without_repeated(df).collect()}
    for key, text, _ in docs:
        if key is not None:
            kept = [x for n, x in enumerate((text or "").split("\n")) if n not in expected[key]]
            assert stage.get(key, "") == (text if text is None else "\n".join(kept)) or (key not in stage and not "".join(kept).strip())


def test_empty_table(spark):
    assert L.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
