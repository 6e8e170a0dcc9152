"""Alignment of two tokenizers, against a plain reading of whole texts by the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillmark.llm import _shared as S
from quillmark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["a", "the", "Inter", "nation", "ally", " ", " ", " ", "  ", "\n", "\t", "'s", "'ll", "1", "234", "é", "ß", "中文", ",", ".", "\U0001f600", "́", "_", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "\x00", "\xa0", "　", "\x1c", "\x85"]
SCHEMA = "doc_id long, text string, row string, n string, groups_sha256 int"


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(text, tools):
    """Ids, byte ranges, links and groups of a text, each by its definition."""
    a, b = tools
    whole = (" " + (text or "")).encode()
    if not text:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(byte[c] for c in a.id_to_token(k)) for k in ids_a]
    raw_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
    links = [(x, y) for x, ea, ra in zip(ids_a, ends_a, raw_a, strict=True) for y, eb, rb in zip(ids_b, ends_b, raw_b, strict=True) if max(ea - len(ra), eb - len(rb)) < min(ea, eb)]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return len(ids_a), len(ids_b), groups, links


def expected(rows, tools):
    told = [(k, plain(t, tools)) for k, t in rows]
    count = Counter(link for _, x in told if x for link in x[3])
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for k, x in told:
        if not x:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in x[2])
        out.append((k, x[0], x[1], len(x[2]), len(x[3]), sum(count[e] == best[e[1]] for e in x[3]), sum(count[e] for e in x[3]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("table", [500_000, 40, 0])
def test_digests_equal_a_plain_reading(spark, tools, monkeypatch, table):
    monkeypatch.setattr(alignment.most_linked, "__defaults__", (table,))
    rng = random.Random(table)
    texts = ["".join(rng.choices(PIECES[: rng.choice((12, 20, len(PIECES)))], k=rng.randint(0, 40))) for _ in range(400)]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[4]), (None, texts[5]), (900, None), (901, ""), (902, " "), (903, "a "), (904, " a"), (905, "long text of many words " * 40), (906, "x" * 2000), (907, "words ▁ " * 30)]
    docs = spark.createDataFrame([(k, t, "r", "n", 1) for k, t in rows], SCHEMA)
    assert sorted(str(tuple(r)) for r in alignment.digests(docs, A, B).collect()) == expected(rows, tools)


def test_groups_and_translation(spark, tools):
    texts = ["Internationally renowned archives, 1848", "x\ty", "▁", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in alignment.groups(docs, A, B).collect():
        x = plain(texts[r.doc_id], tools)
        a, b = iter(r.a), iter(r.b)
        found = [([next(a) for _ in range(m)], [next(b) for _ in range(n)]) for m, n in zip(r.a_sizes, r.b_sizes, strict=True)]
        assert found == (x[2] if x else []) and next(a, None) is None and next(b, None) is None
    links = Counter(e for t in texts for e in (plain(t, tools) or (0, 0, 0, []))[3])
    assert {(r.a, r.b): r.n for r in alignment.translation(docs, A, B).collect()} == dict(links)


def test_very_long_texts_are_read_in_windows(spark, tools):
    text = "archives of the city, \n\n page 12;  Überführung " * 25_000
    docs = spark.createDataFrame([(1, text), (2, "page 12;"), (3, text + "▁")], "doc_id long, text string")
    good, short, bad = sorted(alignment.digests(docs, A, B).collect())
    a, b = tools
    assert (good.n_a, good.n_b) == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))
    part = plain(text[: len(text) // 25_000], tools)
    whole = plain(text[: 2 * len(text) // 25_000], tools)
    assert good.n_links == len(part[3]) + 24_999 * (len(whole[3]) - len(part[3]))
    assert (bad.n_a, bad.n_links, bad.groups_sha256) == (0, 0, "") and short.n_best <= short.n_links and short.count_sum > 100_000


def test_windows_hold_all_atoms(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 300))) for _ in range(50)] + [None]
    for chars in (1, 20, 10_000):
        monkeypatch.setattr(S, "CHUNK_CHARS", chars)
        found = {}
        for window in alignment.windows(texts):
            for k, words in window:
                found.setdefault(k, []).extend(words)
        assert found == {k: alignment.atoms(" " + t) for k, t in enumerate(texts) if t}


def test_counts_of_atoms_outlive_the_cache(tools, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 30)
    rng = random.Random(2)
    words = [" ".join(rng.choices(["archive", "of", "the", "city", "ü", "page", *map(str, range(200))], k=40)) for _ in range(40)]
    aligner = alignment.Aligner(A, B, "pairs")
    counted, totals = alignment.Counted(aligner), Counter()
    for k, text in enumerate(words):
        codes = aligner.codes(alignment.atoms(" " + text))
        if k % 3:  # atoms that are learned, but not counted
            counted.add(codes)
            totals.update(plain(text, tools)[3])
    counted.settle()
    found = counted.taken().to_pydict()
    assert {(a, b): n for a, b, n in zip(found["a"], found["b"], found["n"], strict=True)} == dict(totals)


def test_empty_table(spark):
    assert alignment.digests(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_links_of_tokens_that_cross():
    links = alignment.align(np.array([2, 5, 6]), np.array([1, 3, 5, 6]))
    assert links.first.tolist() == [0, 1, 3] and links.last.tolist() == [2, 3, 4]
    assert links.a_end.tolist() == [2, 3] and links.b_end.tolist() == [3, 4]
