"""Pages of PDF files however they were saved."""

import itertools
import random
import re
import struct
import zlib

import pytest

from quillmark.sources import discovery, pdftree


def body(objects, data=b"%PDF-1.7\n%\xe2\xe3\n"):
    places = {}
    for number, value in objects.items():
        places[number] = len(data)
        data += b"%d 0 obj\n%s\nendobj\n" % (number, value)
    return data, places


def table(data, places, more=b"", free=()):
    at = len(data)
    data += b"xref\n"
    entries = {**{n: b"%010d 00000 n \n" % p for n, p in places.items()}, **dict.fromkeys(free, b"0000000000 00001 f \n")}
    for _, run in itertools.groupby(enumerate(sorted(entries)), lambda x: x[1] - x[0]):
        numbers = [n for _, n in run]
        data += b"%d %d\n" % (numbers[0], len(numbers)) + b"".join(entries[n] for n in numbers)
    return data + b"trailer\n<< /Size 99 /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (more, at)


def pages(n, first=3, count=True):
    kids = b" ".join(b"%d 0 R" % k for k in range(first, first + n))
    return {1: b"<</Type/Catalog /Pages 2 0 R>>", 2: b"<< /Type /Pages /Kids [%s] %s>>" % (kids, b"/Count %d" % n if count else b""), **{k: b"<</Type /Page /Parent 2 0 R /Title (a \\) (/Type /Page) b)>>" for k in range(first, first + n)}}


def packed(content, entries=b""):
    raw = zlib.compress(content)
    return b"<< %s /Filter /FlateDecode /Length %d >> stream\r\n%s\nendstream" % (entries, len(raw), raw)


def filtered(rows, kinds):
    """Rows through PNG filters of single bytes."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        done = []
        for k, v in enumerate(row):
            left, up, corner = (row[k - 1] if k else 0), above[k], (above[k - 1] if k else 0)
            paeth = min((left, up, corner), key=lambda x: abs(left + up - corner - x))
            done.append(v - (0, left, up, (left + up) // 2, paeth)[kind] & 255)
        out += bytes([kind, *done])
        above = row
    return out


def compressed(objects, kinds=(2,), data=b"%PDF-1.7\n", prev=b"", extra=b""):
    """All objects in one object stream, found through a cross-reference stream."""
    places, inner = [], b""
    for number, value in objects.items():
        places.append(b"%d %d" % (number, len(inner)))
        inner += value + b" "
    head = b" ".join(places) + b" "
    data, at = body({50: packed(head + inner, b"/Type /ObjStm /N %d /First %d" % (len(objects), len(head)))}, data)
    here = len(data)
    rows = {0: (0, 0, 65535), **{n: (2, 50, k) for k, n in enumerate(objects)}, 50: (1, at[50], 0), 51: (1, here, 0)}
    raw = filtered([struct.pack(">BIH", *r) for _, r in sorted(rows.items())], [kinds[k % len(kinds)] for k in range(len(rows))])
    index = b" ".join(b"%d 1" % n for n in sorted(rows))
    stream = packed(raw, b"/Type /XRef /W [1 4 2] /Size 99 /Root 1 0 R /Index [%s] /DecodeParms << /Predictor 12 /Columns 7 >> %s %s" % (index, prev, extra))
    return data + b"51 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (stream, here)


def test_plain_file():
    assert pdftree.page_count(table(*body(pages(3)))) == 3


def test_saved_once_more():
    data = table(*body(pages(3)))
    first = int(re.findall(rb"startxref\n(\d+)", data)[-1])
    new = {2: b"<< /Type /Pages /Kids [3 0 R 9 0 R] /Count 2 >>", 3: pages(1)[3], 9: pages(1)[3]}
    again = table(*body(new, data), more=b"/Prev %d" % first, free=(4, 5))
    assert pdftree.page_count(again) == 2 and len(re.findall(rb"/Type /Page /Parent", again)) == 5
    file = pdftree.File(again)
    assert file.get(pdftree.Ref(4)) is None and file.get(pdftree.Ref(9))["Type"] == "Page"


@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
def test_compressed_objects(kinds):
    data = compressed(pages(4), kinds)
    assert pdftree.page_count(data) == 4 and b"/Type /Page /Parent" not in data


def test_compressed_update_of_a_plain_file():
    data = table(*body(pages(3)))
    first = int(re.findall(rb"startxref\n(\d+)", data)[-1])
    new = compressed({2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"}, data=data, prev=b"/Prev %d" % first)
    assert pdftree.page_count(new) == 1


def test_objects_hidden_from_older_readers():
    objects = pages(2)
    stream = compressed(objects)
    at = int(re.findall(rb"startxref\n(\d+)", stream)[-1])
    data, places = body({60: b"null"}, stream + b"\n")
    assert pdftree.page_count(table(data, places, more=b"/XRefStm %d" % at, free=tuple(objects))) == 2


def test_count_is_missing_or_nested():
    assert pdftree.page_count(table(*body(pages(5, count=False)))) == 5
    nested = pages(2, count=False) | {2: b"<</Type/Pages /Kids [3 0 R 10 0 R 10 0 R 2 0 R]>>", 10: b"<</Type /Pages /Kids [4 0 R 11 0 R]>>", 11: b"<</Type /Page>>"}
    assert pdftree.page_count(table(*body(nested))) == 3
    told = pages(3) | {2: b"<</Type/Pages /Kids [3 0 R] /Count 7 0 R>>", 7: b"12 % as said"}
    assert pdftree.page_count(table(*body(told))) == 12


def test_damaged_files_are_searched():
    good = table(*body(pages(3)))
    assert pdftree.page_count(re.sub(rb"startxref\n\d+", b"startxref\n7", good)) == 3
    assert pdftree.page_count(b"junk" + good) == 3
    assert pdftree.page_count(good[: good.index(b"xref")]) == 3
    loose = compressed(pages(4))
    assert pdftree.page_count(re.sub(rb"startxref\n\d+", b"", loose)) == 4
    newer = good[: good.index(b"xref")] + b"2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj"
    assert pdftree.page_count(newer) == 1


def test_hostile_files_end_with_an_error():
    rng = random.Random(3)
    good = compressed(pages(4), (0, 1, 2, 3, 4))
    for data in (b"", b"%PDF", b"startxref 0", b"<<" * 5000, b"1 0 obj " + b"[" * 5000, table(*body({1: b"1 0 R"})), table(*body(pages(0) | {2: b"2 0 R"}))):
        with pytest.raises(ValueError):
            discovery.pdf_pages(data)
    for _ in range(300):
        k, n = rng.randrange(len(good)), rng.randint(1, 30)
        try:
            discovery.pdf_pages(good[:k] + rng.randbytes(n) + good[k + n :])
        except ValueError:
            pass


def test_counts_of_a_folder(spark, tmp_path):
    locked = table(*body(pages(3)), more=b"/Encrypt 9 0 R")
    files = {"a": table(*body(pages(3))), "b": compressed(pages(4)), "c": locked, "d": compressed(pages(2), extra=b"/Encrypt << /V 4 >>"), "e": b"no", "f": re.sub(rb"startxref\n\d+", b"", locked)}
    for name, content in files.items():
        (tmp_path / f"{name}.pdf").write_bytes(content)
    assert {r.path[-5]: r.pages for r in discovery.page_counts(spark, str(tmp_path)).collect()} == {"a": 3, "b": 4, "c": None, "d": None, "e": None, "f": None}
