"""TIFF frames: what was written comes back, whatever the layout of the file."""

import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import batch, commits
from quillmark.operators import recognizers as R
from quillmark.sources import discovery, tiff
from tests.test_archive import png, scan
from tests.test_batch import reader

LETTERS = {"H": 3, "I": 4, "Q": 16}


def pack_bits(data):
    out, at = b"", 0
    while at < len(data):
        same = next((n for n, b in enumerate(data[at : at + 128]) if b != data[at]), len(data[at : at + 128]))
        if same > 1:
            out, at = out + bytes([257 - same, data[at]]), at + same
        else:
            out, at = out + bytes([0, data[at]]), at + 1
    return out


def lzw(data):
    table, width, bits, word = {bytes([k]): k for k in range(256)}, 9, "", b""
    emit = lambda code: format(code, f"0{width}b")
    bits += emit(256)
    n = 258
    for k in range(len(data)):
        if word + data[k : k + 1] in table:
            word += data[k : k + 1]
            continue
        bits += emit(table[word])
        table[word + data[k : k + 1]] = n
        n += 1
        if n == 4094:
            bits += emit(256)
            table, width, n = {bytes([k]): k for k in range(256)}, 9, 258
        elif n >= 1 << width:
            width += 1
        word = data[k : k + 1]
    if word:
        bits += emit(table[word])
        n += 1
        if n >= 1 << width and width < 12:
            width += 1
    bits += emit(257)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


CODERS = {1: lambda d: d, 5: lzw, 8: zlib.compress, 32773: pack_bits}


def written(frames, order="<", big=False):
    """A file of frames (samples, options); options name tags, ``tile`` a tile's size."""
    out = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    links, place = [len(out) - (8 if big else 4)], "Q" if big else "I"
    for a, options in frames:
        h, w, s = a.shape
        bits, compression, predictor, planar = (options.get(k, 1 if k > 258 else 8) for k in (258, 259, 317, 284))
        across, down = options.get("tile", (w, options.get(278, h)))
        pieces = []
        for plane in range(s if planar == 2 else 1):
            for y, x in itertools.product(range(0, h, down), range(0, w, across)):
                part = a[y : y + down, x : x + across, plane : plane + 1] if planar == 2 else a[y : y + down, x : x + across]
                if "tile" in options:
                    part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1]), (0, 0)), mode="edge")
                if predictor == 2:
                    part = np.concatenate((part[:, :1], part[:, 1:] - part[:, :-1]), axis=1)
                rows = part.reshape(part.shape[0], -1)
                if bits < 8:
                    rows = np.packbits(((rows[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1).reshape(len(rows), -1).astype(np.uint8), axis=1)
                raw = CODERS[compression](rows.astype(order + "u2" if bits == 16 else "u1").tobytes())
                pieces.append((len(out), len(raw)))
                out += raw
        tiled = "tile" in options
        tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [bits] * s), 259: ("H", [compression]), 262: ("H", [2 if s >= 3 else 1]), 277: ("H", [s]), 284: ("H", [planar]), 317: ("H", [predictor])}
        tags |= {324 if tiled else 273: (place, [p for p, _ in pieces]), 325 if tiled else 279: ("I", [n for _, n in pieces])}
        tags |= {322: ("I", [across]), 323: ("I", [down])} if tiled else {278: ("I", [down])}
        tags |= {k: v if isinstance(v, tuple) else ("H", [v]) for k, v in options.items() if k in (262, 274, 320)}
        body, extra = b"", b""
        start = len(out)
        size = (8 if big else 2) + len(tags) * (20 if big else 12) + (8 if big else 4)
        for tag, (letter, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(raw) > (8 if big else 4):
                held = struct.pack(order + place, start + size + len(extra))
                extra += raw
            else:
                held = raw.ljust(8 if big else 4, b"\0")
            body += struct.pack(f"{order}HH{place}", tag, LETTERS[letter], len(values)) + held
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + body
        links.append(len(out))
        out += bytes(8 if big else 4) + extra
        at = links[-2]
        out = out[:at] + struct.pack(order + place, start) + out[at + (8 if big else 4) :]
    return out


def read(content):
    get = lambda place, size: content[place : place + size]
    return [tiff.picture(fields, get) for fields in tiff.directories(get)]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("compression", list(CODERS))
def test_frames_come_back(order, big, compression):
    rng = np.random.default_rng(compression)
    frames = []
    for samples, predictor, planar, shape in itertools.product((1, 3), (1, 2), (1, 2), ({}, {278: 7}, {"tile": (16, 32)})):
        a = np.cumsum(rng.integers(0, 3, (37, 45, samples)), axis=1).astype(np.uint8)
        frames.append((a, {259: compression, 317: predictor, 284: planar} | shape))
    back = read(written(frames, order, big))
    assert len(back) == len(frames)
    for (a, _), b in zip(frames, back, strict=True):
        assert np.array_equal(a, b)


def test_lzw_of_long_and_hostile_data():
    rng = np.random.default_rng(5)
    for data in (bytes(70_000), rng.integers(0, 256, 50_000).astype(np.uint8).tobytes(), rng.integers(0, 2, 90_000).astype(np.uint8).tobytes(), b"", b"a"):
        assert tiff.unpack_lzw(lzw(data), len(data)) == data


def test_bits_and_kinds_of_pictures():
    rng = np.random.default_rng(6)
    for bits, order in itertools.product((1, 2, 4, 8, 16), "<>"):
        a = rng.integers(0, 1 << bits, (9, 13, 1)).astype(np.uint16)
        whole = (a >> 8 if bits == 16 else a * (255 // ((1 << bits) - 1))).astype(np.uint8)
        dark, light = read(written([(a, {258: bits}), (a, {258: bits, 262: 0})], order))
        assert np.array_equal(dark, whole) and np.array_equal(light, 255 - whole)
    a = rng.integers(0, 16, (9, 13, 1)).astype(np.uint8)
    colours = rng.integers(0, 256, (3, 16))
    (shown,) = read(written([(a, {258: 4, 262: 3, 320: ("H", (colours * 257).reshape(-1).tolist())})]))
    assert np.array_equal(shown, colours[:, a[:, :, 0]].transpose(1, 2, 0))
    ink = rng.integers(0, 256, (5, 6, 4)).astype(np.uint8)
    (shown,) = read(written([(ink, {262: 5})]))
    assert np.array_equal(shown, ((255 - ink[:, :, :3].astype(int)) * (255 - ink[:, :, 3:].astype(int)) // 255))
    alpha = rng.integers(0, 256, (5, 6, 4)).astype(np.uint8)
    assert np.array_equal(read(written([(alpha, {})]))[0], alpha[:, :, :3])


#: What a viewer does to a stored picture, by its orientation.
TURNS = {1: lambda a: a, 2: np.fliplr, 3: lambda a: np.rot90(a, 2), 4: np.flipud, 5: lambda a: a.swapaxes(0, 1), 6: lambda a: np.rot90(a, -1), 7: lambda a: np.rot90(a.swapaxes(0, 1), 2), 8: np.rot90}


def test_all_orientations():
    a = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    back = read(written([(a, {274: k}) for k in TURNS]))
    for (k, turn), b in zip(TURNS.items(), back, strict=True):
        assert np.array_equal(b, turn(a)), k


def test_orientation_of_photographs():
    field = b"II*\0\x08\0\0\0" + struct.pack("<HHHIHH", 1, 274, 3, 1, 6, 0) + bytes(4)
    app = b"Exif\0\0" + field
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xda"
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + bytes(4)
    assert discovery.exif_orientation(jpeg) == 6
    assert discovery.exif_orientation(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", bytes(13)) + part(b"eXIf", field) + part(b"IEND", b"")) == 6
    for other in (b"", b"\xff\xd8", jpeg[:20], b"\x89PNG\r\n\x1a\n" + part(b"IEND", b""), b"\xff\xd8\xff\xe1\x00\x08Exif\0\0", jpeg.replace(b"\x12\x01\x03\0\x01\0\0\0\x06", b"\x12\x01\x03\0\x01\0\0\0\x0c")):
        assert discovery.exif_orientation(other) == 1


def test_turned_images_are_turned_back(spark, tmp_path):
    png(tmp_path / "a.png", scan())
    content = (tmp_path / "a.png").read_bytes()
    field = b"II*\0\x08\0\0\0" + struct.pack("<HHHIHH", 1, 274, 3, 1, 8, 0) + bytes(4)
    chunk = struct.pack(">I", len(field)) + b"eXIf" + field + struct.pack(">I", zlib.crc32(b"eXIf" + field))
    (tmp_path / "b ü%1+.png").write_bytes(content[:33] + chunk + content[33:])
    rows = {r.path.rpartition("/")[2]: r for r in discovery.load_images(spark, str(tmp_path)).collect()}
    a, b = (np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) for r in (rows["a.png"], rows["b ü%1+.png"]))
    assert np.array_equal(b, np.rot90(a))


def test_source_reads_files_in_shares(spark, tmp_path):
    rng = np.random.default_rng(9)
    frames = [rng.integers(0, 256, (20 + k, 30, 3)).astype(np.uint8) for k in range(7)]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "Band ü%1.TIF").write_bytes(written([(a, {259: 8}) for a in frames]))
    (tmp_path / "b.tiff").write_bytes(written([(frames[0][:, :, :1], {})]))
    (tmp_path / "c.txt").write_bytes(b"x")
    spark.dataSource.register(tiff.TiffSource)
    for share in (1000, 64 << 20):
        source = tiff.TiffReader({"path": str(tmp_path), "share": share})
        assert len(source.partitions()) == 1 if share > 1000 else len(source.partitions()) > 5
        found = spark.read.format("tiff").option("share", share).load(str(tmp_path)).orderBy("path", "frame").collect()
        assert [(r.path, r.frame) for r in found] == [(f"file:{tmp_path}/b.tiff", 0)] + [(f"file:{tmp_path}/deep/er/Band ü%1.TIF", k) for k in range(7)]
        for r, a in zip(found[1:], frames, strict=True):
            assert np.array_equal(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)[:, :, ::-1], a)
    assert spark.read.format("tiff").load(f"{tmp_path}/b.tiff").select("width", "error").collect() == [(30, None)]


def test_what_cannot_be_read(spark, tmp_path):
    good = written([(np.zeros((4, 4, 1), np.uint8), {}), (np.zeros((4, 4, 1), np.uint8), {})])
    fax = good.replace(struct.pack("<HHII", 259, 3, 1, 1), struct.pack("<HHII", 259, 3, 1, 4))
    for k, content in enumerate((good, fax, b"no", good[:-30], b"")):
        (tmp_path / f"{k}.tif").write_bytes(content)
    spark.dataSource.register(tiff.TiffSource)
    rows = spark.read.format("tiff").option("mode", "permissive").load(str(tmp_path)).orderBy("path", "frame").collect()
    assert [(r.path[-5:-4], r.frame, r.error is None) for r in rows] == [("0", 0, True), ("0", 1, True), ("1", 0, False), ("2", 0, False), ("3", 0, True), ("3", 1, False), ("4", 0, False)]
    with pytest.raises(Exception, match="compression 4"):
        spark.read.format("tiff").load(f"{tmp_path}/1.tif").collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("tiff").load(f"{tmp_path}/none").collect() == []


def test_job_over_a_folder_of_frames_and_images(spark, tmp_path):
    png(tmp_path / "in" / "B" / "x.png", scan())
    page = scan().astype(np.uint8)[:, :, None]
    (tmp_path / "in" / "Akte.tif").write_bytes(written([(page, {259: 5}), (np.rot90(page), {274: 6})]))
    archive = commits.Snapshots(spark, str(tmp_path / "archive"))
    job = batch.Job(spark, archive, str(tmp_path / "out"), [R.Recognizer("tesseract:deu", R.PAGE, reader(["den 3. Mai 1871"]))])
    job.run(batch.Request(str(tmp_path / "in")))
    pages = {(r.title, r.page_index): (r.width, r.height) for r in archive.read("pages").join(archive.read("documents").select("document_id", "title"), "document_id").collect()}
    assert pages == {("Akte", 0): (300, 200), ("Akte", 1): (300, 200), ("B", 0): (300, 200)}
    assert archive.read("lines").where(text.normalize(F.col("text")) == "den 3 mai 1871").count() == 3
