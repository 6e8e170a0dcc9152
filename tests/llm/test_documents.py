"""Operators on documents against brute force, and their behaviour on awkward rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmark.llm import decontaminate, graph, language, minhash, packing, quality

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, score string, bands string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(tokens):
    return Counter(tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))) if tokens else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def changed(rng, text, times):
    out = text.split(" ")
    for _ in range(times):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10_000)}"
    return " ".join(out)


def awkward():
    return [(9001, None, None, "s", "b"), (9002, "", "en", "s", "b"), (9003, "  \n ", "en", "s", "b"), (None, "some words without an id here", "en", "s", "b"), (9004, "123 !!", "en", "s", "b"), (9005, "one", None, "s", "b"), (9006, "ab cd " * 20_000, "en", "s", "b")]


@pytest.fixture(scope="module")
def documents():
    rng, rows, key = random.Random(4), [], 0
    for _ in range(12):
        base = prose(rng, rng.randint(30, 120))
        for times in (0, 0, 1, 1, 2, 3, 5, 8):
            rows.append((key, changed(rng, base, times), "en", "s", "b"))
            key += 1
    rows.append((key, "w1 w2 w1 w2 w1 w2 w1 w2 w1 w2 w1 w2", "en", "s", "b"))
    rows.append((key + 1, "w1 w2 w1 w2 w1 w2 w1 w2 w1 w2", "en", "s", "b"))
    rng.shuffle(rows)
    return rows


def test_minhash_classes_equal_brute_force(spark, documents):
    rows = documents + awkward() + [documents[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    sets = {r[0]: bag(words(r[1])) for r in rows if r[0] is not None}
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        same = jaccard(sets[a], sets[b]) >= 0.8 if sets[a] and sets[b] else texts[a] == texts[b] and not sets[a] and not sets[b]
        if same:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = minhash.classes(df).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == {k: find(k) for k in sets}
    kept = minhash.one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({find(k) for k in sets})
    assert kept[0].asDict().keys() == set(df.columns)
    assert minhash.classes(df.limit(0)).count() == 0

def components_of(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        label = [label[a] if x == label[b] else x for x in label]
    return {frozenset(i for i in range(n) if label[i] == x) for x in label}


def clique_and_chain(rng):
    """Shuffled sets of 12 near copies, and of a chain of drifting versions that starts at one of them."""
    base = rng.integers(1, 2**63, 60, dtype=np.uint64)
    fresh = lambda s, k: np.sort(np.concatenate((rng.permutation(s)[k:], rng.integers(1, 2**63, k, dtype=np.uint64))))
    sets = [fresh(base, int(rng.integers(0, 4))) for _ in range(12)]
    at = sets[-1]
    for _ in range(60):
        at = fresh(at, int(rng.integers(4, 7)))
        sets.append(at)
    return [sets[k] for k in rng.permutation(len(sets))]


def test_links_hold_every_bridge_of_a_clique_and_a_chain():
    for seed in (3, 9, 11, 22, 23, 32):
        sets = clique_and_chain(np.random.default_rng(seed))
        bags = [Counter(s.tolist()) for s in sets]
        want = [p for p in itertools.combinations(range(len(sets)), 2) if jaccard(bags[p[0]], bags[p[1]]) >= 0.8]
        assert components_of(len(sets), minhash.links(sets)) == components_of(len(sets), want)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = np.sort(np.repeat(rng.integers(1, 2**63, 300, dtype=np.uint64), rng.integers(1, 4, 300)))
    b = np.sort(np.concatenate((a[60:], rng.integers(1, 2**63, 60, dtype=np.uint64))))
    ua, ub = minhash.units(a), minhash.units(b)
    exact = len(np.intersect1d(ua, ub)) / len(np.union1d(ua, ub))
    s = minhash.signatures(np.concatenate((ua, ub)), np.repeat([0, 1], [len(ua), len(ub)]), 2, 2048)
    assert abs((s[0] == s[1]).mean() - exact) < 0.05
    one = minhash.signatures(ua[:1], np.zeros(1, np.int64), 1)
    assert (one > 0).all()


def test_links_connect_all_similar_pairs_of_large_groups():
    rng = random.Random(8)
    base = prose(rng, 60)
    sets = minhash.shingles_of([changed(rng, base, rng.randint(0, 6)) for _ in range(120)])
    label = list(range(len(sets)))
    for i, j in minhash.links(sets):
        label = [label[i] if x == label[j] else x for x in label]
    bags = [Counter(s.tolist()) for s in sets]
    want = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if jaccard(bags[i], bags[j]) >= 0.8:
            want = [want[i] if x == want[j] else x for x in want]
    groups = lambda x: {frozenset(k for k, v in enumerate(x) if v == c) for c in x}
    assert groups(label) == groups(want)


def test_components_of_a_chain(spark):
    from quillmark.llm import graph

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r.node: r.root for r in graph.components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, n)) for k, n in enumerate((13, 13, 20, 25, 40, 3, 1))] + [(50, None), (51, "")]
    rows = []
    for k in range(60):
        text = prose(rng, rng.randint(0, 60), 5000)
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items[:5])[1]
            text += " " + changed(rng, item, rng.choice((0, 0, 1, 2))) + "\n" + prose(rng, rng.randint(0, 20), 5000)
        rows.append((k, text, "en", "s", "b"))
    rows += awkward() + [rows[3]]
    df, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for key, text, *_ in rows:
        tokens = words(text)
        for item, said in items:
            w = words(said)
            n, size = len(w), min(5, len(w))
            shingles = lambda x: Counter(tuple(x[i : i + size]) for i in range(len(x) - size + 1))  # noqa: B023, E731
            if n and any(jaccard(shingles(w), shingles(tokens[s : s + n])) >= 0.8 for s in range(len(tokens) - n + 1) if len(tokens) < 5000):
                want[key, item] += 1
    found = decontaminate.find(df, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == want
    left = decontaminate.drop_leaking(df, bench).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(str(r[0]) for r in rows if not any(k == r[0] for k, _ in want))
    assert decontaminate.find(df, bench.limit(0)).count() == 0 and decontaminate.find(df.limit(0), bench).count() == 0


def test_components_are_whole_or_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "u long, v long")
    with pytest.raises(RuntimeError):
        graph.components(edges, most_rounds=1)
    assert {tuple(r) for r in graph.components(edges).collect()} == {(k, 0) for k in range(13)}


def test_texts_shorter_than_an_item_leak_as_brute_force_says():
    rng = random.Random(8)
    items = [(k, prose(rng, n, 60)) for k, n in enumerate((3, 6, 7, 9, 12, 15, 20, 30, 59))]
    items.append((9, " ".join(["w1", "w2", "w3"] * 9)))
    texts = []
    for _, text in items:
        w = text.split()
        for cut in range(1, len(w) // 3 + 2):
            texts += [" ".join(w[:-cut]), " ".join(w[cut:]), changed(rng, " ".join(w[cut:]), 1) if w[cut:] else ""]
    texts.append(" ".join(["w2", "w3", "w1"] * 8))
    bags = {k: bag(words(text)) for k, text in items}
    want, width = set(), {k: len(words(text)) for k, text in items}
    for t, text in enumerate(texts):
        w = words(text)
        for k in bags:
            spans = [w[s : s + width[k]] for s in range(max(1, len(w) - width[k] + 1))] if w else []
            if any(jaccard(bags[k], bag(x)) >= 0.8 for x in spans):
                want.add((t, k))
    found = decontaminate.leaks(texts, decontaminate.items(items))
    assert {(t, k) for t, k, *_ in found} == want and len(want) > 30
    last = texts.index(" ".join(items[8][1].split()[:-1]))
    assert (last, 8, 0, pytest.approx(54 / 55)) in found


def test_fingerprints_within_the_radius_are_all_found():
    rng = np.random.default_rng(2)
    group = decontaminate.Items(9, list(range(20)), rng.integers(1, 2**63, (20, 5), dtype=np.uint64))
    prints = np.array([group.prints[k % 20] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k % 24, replace=False))) for k in range(480)])
    w, i = group.candidates(prints)
    assert {(a, b) for a, b in zip(w, i, strict=True)} == {(a, b) for a in range(480) for b in range(20) if int(prints[a] ^ group.prints[b]).bit_count() <= decontaminate.RADIUS}


def test_language_profiles(spark):
    text = {"de": "die kinder spielen heute draußen und der hund schläft nicht", "en": "the children are playing outside while the dog sleeps there", "es": "los niños juegan fuera mientras el perro duerme en la casa"}
    rng = random.Random(5)
    rows = []
    for k in range(90):
        lang = rng.choice(sorted(text))
        said = text[lang].split()
        rows.append((k, " ".join(rng.choices(said, k=rng.randint(8, 30))), lang, "s", "b"))
    df = spark.createDataFrame(rows + awkward(), SCHEMA)
    profiles = language.fit(language.training_rows(df))
    for r in language.predict(df, profiles, ["doc_id", "lang", "text"]).collect():
        counts = Counter()
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            padded = f" {w} "
            counts.update([*w, *(padded[i : i + 2] for i in range(len(padded) - 1)), *(padded[i : i + 3] for i in range(len(padded) - 2))])
        if not counts:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 9000:
            assert r.lang_pred == r.lang and 0 < r.score <= 1
            code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
            own = sorted(counts, key=lambda g: (-counts[g], code(g)))[: language.PROFILE]
            best = []
            for k, name in enumerate(profiles.languages):
                ranks = dict(zip(profiles.grams.tolist(), profiles.ranks[:, k].tolist(), strict=True))
                best.append((sum(abs(i - ranks[code(g)]) if ranks.get(code(g), language.PROFILE) < language.PROFILE else language.PROFILE for i, g in enumerate(own)), name))
            assert min(best)[1] == r.lang_pred and abs(r.score - (1 - min(best)[0] / (language.PROFILE * len(own)))) < 1e-9
    kept = {r.doc_id for r in language.keep_determined(df, profiles).collect()}
    assert kept >= set(range(90)) and not kept & {9001, 9002, 9003, 9004}
    empty = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, empty, ["doc_id"]).collect()} == {"und"}


def test_quality_learns_and_scores_every_row(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(160):
        text = "\n".join(prose(rng, rng.randint(5, 40)).capitalize() + "." for _ in range(rng.randint(1, 6)))
        if k % 3 == 0:
            text += "\nBUY NOW!!! $$$ CLICK HERE!!! " * 3
        rows.append((k, text, "en", "s", "b"))
        labels.append((k, int(k % 3 != 0)))
    df = spark.createDataFrame(rows + awkward(), SCHEMA)
    model = quality.fit(df, spark.createDataFrame(labels[:120] + [(None, 1), (3, None)], "doc_id long, quality int"))
    found = {r.doc_id: r for r in quality.score(df, model, ["doc_id"]).collect()}
    assert len(found) == len(rows) + 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert sum(found[k].predicted == q for k, q in labels[120:]) >= 38
    plain = quality.fit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(df, plain, ["doc_id"]).collect()} == {0.5}


def test_attention_gradient():
    rng = np.random.default_rng(3)
    bags = [rng.standard_normal((n, quality.FEATURES)).astype(np.float32) for n in (1, 4, 2, 6)] * 20
    label = np.array([float(b[:, 0].max() > 0.5) for b in bags], np.float32)
    model = quality.train(bags, label, np.ones(len(bags), np.float32))
    x = np.concatenate([(b - model.mean) / model.scale for b in bags])
    p = model.forward(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]))["p"]
    assert ((p >= 0.5) == label).mean() > 0.95


def packed(rows, found, capacity):
    reference = Tokenizer.from_file(PATH)
    want = Counter()
    for key, text, *_ in rows:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), capacity):
            want[key, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want
    fill = 0
    for _, parts in itertools.groupby(sorted(found, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= capacity
        fill += packing.sequence_cost(at, capacity)
    return fill


def test_packing_holds_every_token_once(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.randint(0, 200)), "en", "s", "b") for k in range(300)] + awkward()
    rows += [rows[5]] * 40
    found = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, 256).collect()
    stored = packed(rows, found, 256)
    assert stored <= 1.08 * sum(r.length for r in found)
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_cover_their_histogram(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.choice((rng.randint(1, 63), rng.randint(20, 30))) for _ in range(rng.choice((0, 1, 50, 5000))))
    done = Counter()
    for p in packing.plan(dict(histogram), 64):
        assert sum(n * a for n, a in zip(p.lengths, p.counts, strict=True)) <= 64
        for n, a in zip(p.lengths, p.counts, strict=True):
            done[n] += a * p.times
    assert done == histogram


@pytest.mark.parametrize("seed", range(3))
def test_plans_store_no_more_than_best_fit_and_reach_the_gap(seed):
    rng = random.Random(seed)
    histogram = dict(Counter(min(255, int(rng.expovariate(1 / 90)) + 1) for _ in range((300, 3000, 200_000)[seed])))
    greedy, plan = packing.best_fit(histogram, 256), packing.plan(histogram, 256)
    for patterns in (greedy, plan):
        held = Counter()
        for p in patterns:
            for n, a in zip(p.lengths, p.counts, strict=True):
                held[n] += a * p.times
        assert held == histogram
    assert packing.stored(plan, 256) <= packing.stored(greedy, 256)
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[n] for n in lengths.tolist()])
    program = packing.solve(lengths, demand, 256, [])
    tokens = int(lengths @ demand)
    assert program.bound >= tokens and program.value >= tokens - 1e-6
    assert program.finished or program.value - program.bound <= packing.GAP * program.bound * 1.001
    for counts, _ in program.patterns:
        assert sum(int(lengths[i]) * a for i, a in counts.items()) <= 256


def test_columns_are_generated_on_small_inputs_too(monkeypatch):
    calls, price = [], packing.price
    monkeypatch.setattr(packing, "price", lambda *a: calls.append(1) or price(*a))
    rng = random.Random(4)
    better = 0
    for _ in range(12):
        whole = [sorted(rng.sample(range(1, 200), rng.choice((2, 3)))) for _ in range(40)]
        pieces = [n for cuts in whole for n in np.diff([0, *cuts, 200]).tolist()]
        histogram = dict(Counter(pieces))  # 40 sequences of 200 hold them all
        greedy, plan = (packing.stored(f(histogram, 200), 200) for f in (packing.best_fit, packing.plan))
        assert 40 * 200 <= plan <= greedy
        better += plan < greedy
    assert len(calls) > 12 and better >= 6


def test_best_fit_over_a_histogram_equals_piece_by_piece():
    rng = random.Random(8)
    for _ in range(50):
        pieces = sorted((rng.randint(1, 40) for _ in range(rng.randint(1, 200))), reverse=True)
        rooms = []
        for n in pieces:
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(40 - n)
            else:
                rooms[rooms.index(fit)] -= n
        assert sum(p.times for p in packing.best_fit(dict(Counter(pieces)), 40)) == len(rooms)


def test_a_benchmark_of_several_passes(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, prose(rng, 60), "en", "s", "b") for k in range(40)]
    items = [(k, " ".join(rows[k][1].split()[:25])) for k in range(0, 40, 4)]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, decontaminate.find(docs, bench).collect()))
    kept = sorted(map(str, decontaminate.drop_leaking(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    assert len(once) >= 10 and sorted(map(tuple, decontaminate.find(docs, bench).collect())) == once
    assert sorted(map(str, decontaminate.drop_leaking(docs, bench).collect())) == kept


def test_tables_go_when_discarded(spark):
    from quillmark.llm import _shared as S

    table = S.materialize(spark.range(5).toDF("x"), "five")
    path = S._WRITTEN[id(table)][1]
    assert table.count() == 5
    S.discard(table)
    with pytest.raises(Exception, match=r"(?i)not exist|FILE_NOT_EXIST|FAILED_READ_FILE|PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_links_of_drifting_groups_connect_as_all_pairs_do():
    for seed in range(200, 300):
        rng = np.random.default_rng(seed)
        size, sets = 100, []
        for _ in range(int(rng.integers(2, 5))):  # cores of close copies, with chains that drift from one to the next
            core = rng.integers(0, 1 << 60, size).astype(np.uint64) if not sets else sets[-1].copy()
            for _ in range(int(rng.integers(5, 20))):
                core[rng.integers(0, size, int(rng.integers(0, 14)))] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
                sets.append(core.copy())
        sets = [np.sort(sets[k]) for k in rng.permutation(len(sets))]
        count = [Counter(x.tolist()) for x in sets]
        near = lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values()) - 1e-9
        want = [(i, j) for i in range(len(sets)) for j in range(i) if near(count[i], count[j])]

        def classes(edges, n=len(sets)):
            label = list(range(n))
            for a, b in edges:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
            return {frozenset(k for k in range(n) if label[k] == c) for c in label}

        found = minhash.links(sets)
        assert set(map(frozenset, found)) <= set(map(frozenset, want)) and classes(found) == classes(want)
