"""Frames of TIFF files as a data source: ``spark.read.format("tiff").load(folder)``.

A task gets whole files, or a share of the frames of a large one. It follows the
file's chain of directories and reads no more than the strips or tiles of its own
frames, so a file of many gigabytes is read by many tasks, each by parts.

Read are classic and big files, strips and tiles, both byte orders, 1, 2, 4, 8 and
16 bits a sample, grey, palette, RGB and CMYK pictures, chunky or planar, plain or
compressed by PackBits, LZW or Deflate, with or without horizontal differencing.
Others (fax codes, JPEG) are errors, or rows without data if so wished.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: tags, sizes of field types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL, STRIPS, ORIENTATION, SAMPLES, ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 266, 273, 274, 277, 278, 279
PLANAR, PREDICTOR, PALETTE, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 284, 317, 320, 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
SUFFIXES = (".tif", ".tiff")
#: Bytes of files in a task.
SHARE = 64 << 20

#: Reads bytes: (place, size) to the bytes there.
Read = Callable[[int, int], bytes]


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a count and that many bytes, or a negative count and one byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first, that widen one code early."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, length = list(first), bytearray(), 0
    held = bits = 0
    width, last = 9, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257 or length >= size:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out += entry
        length, last = len(out), entry
    return bytes(out)


def unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return unpack_lzw(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompress(data)
        except zlib.error as error:
            raise ValueError(f"TIFF strip: {error}") from error
    raise ValueError(f"TIFF compression {compression} is not read")


@dataclass(frozen=True)
class Layout:
    """Byte order and sizes of a file's numbers, and where its first directory is."""

    order: str
    big: bool
    first: int

    @classmethod
    def of(cls, read: Read) -> Layout:
        head = read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or len(head) < 8:
            raise ValueError("not a TIFF file")
        version = struct.unpack_from(order + "H", head, 2)[0]
        if version not in (42, 43) or version == 43 and len(head) < 16:
            raise ValueError("not a TIFF file")
        return cls(order, version == 43, struct.unpack_from(order + ("Q" if version == 43 else "I"), head, 8 if version == 43 else 4)[0])


def directories(read: Read) -> Iterator[dict[int, tuple]]:
    """The fields of every frame, in order: tag to its numbers. A chain that runs into itself ends there."""
    layout = Layout.of(read)
    place, entry, count = ("Q", 20, "Q") if layout.big else ("I", 12, "H")
    inline, at, seen = struct.calcsize(place), layout.first, set()

    def exactly(start: int, size: int) -> bytes:
        found = read(start, size)
        if len(found) < size:
            raise ValueError("TIFF file ends early")
        return found

    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(layout.order + count, exactly(at, struct.calcsize(count)))[0]
        begin = at + struct.calcsize(count)
        table = exactly(begin, n * entry + inline)
        fields = {}
        for k in range(n):
            tag, kind = struct.unpack_from(layout.order + "HH", table, k * entry)
            values = struct.unpack_from(layout.order + place, table, k * entry + 4)[0]
            if kind not in TYPES:
                continue
            form = f"{layout.order}{values}{TYPES[kind]}"
            size, here = struct.calcsize(form), k * entry + 4 + inline
            raw = table[here : here + size] if size <= inline else exactly(struct.unpack_from(layout.order + place, table, here)[0], size)
            fields[tag] = struct.unpack(form, raw)
        fields["order"] = layout.order
        yield fields
        at = struct.unpack_from(layout.order + place, table, n * entry)[0]


def oriented(a: np.ndarray, orientation: int) -> np.ndarray:
    """A picture (rows, columns, ...) turned and mirrored upright; unknown values leave it."""
    if orientation in (5, 6, 7, 8):
        a = a.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        a = a[::-1]
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1]
    return a


def _samples(raw: bytes, width: int, rows: int, samples: int, bits: int, order: str) -> np.ndarray:
    """Numbers of a strip or tile, in rows that each begin at a byte; missing ones are 0."""
    line = -(-width * samples * bits // 8)
    data = np.frombuffer(raw[: line * rows].ljust(line * rows, b"\0"), np.uint8).reshape(rows, line)
    if bits == 16:
        data = data.view(order + "u2").astype(np.uint16)
    elif bits < 8:
        per = 8 // bits
        shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * bits
        data = (data[:, :, None] >> shifts & ((1 << bits) - 1)).reshape(rows, -1)[:, : width * samples]
    return data.reshape(rows, width, samples)


def decoded(fields: dict, read: Read) -> np.ndarray:
    """Samples of one frame (rows, columns, samples), as they are stored."""

    def one(tag: int, default: int) -> int:
        return fields.get(tag, (default,))[0]

    if WIDTH not in fields or HEIGHT not in fields:
        raise ValueError("TIFF frame without a size")
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, compression, planar = one(BITS, 1), one(COMPRESSION, PLAIN), one(PLANAR, 1) == 2
    if bits not in (1, 2, 4, 8, 16) or len(set(fields.get(BITS, (1,)))) > 1 or one(FORMAT, 1) != 1:
        raise ValueError(f"TIFF samples of {fields.get(BITS)} bits, format {one(FORMAT, 1)}, are not read")
    if TILES in fields:
        across, down, places, sizes = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), fields[TILES], fields.get(TILE_SIZES, ())
    else:
        across, down, places, sizes = width, min(one(ROWS, height), height), fields.get(STRIPS, ()), fields.get(STRIP_SIZES, ())
    if not across or not down or len(places) != len(sizes):
        raise ValueError("TIFF frame without strips or tiles")
    deep, planes = (1, samples) if planar else (samples, 1)
    out = np.zeros((height, width, samples), np.uint16 if bits == 16 else np.uint8)
    columns, lines = -(-width // across), -(-height // down)
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        plane, rest = divmod(k, columns * lines)
        if plane >= planes:
            break
        y, x = rest // columns * down, rest % columns * across
        rows = down if TILES in fields else min(down, height - y)
        whole = rows * -(-across * deep * bits // 8)
        raw = read(place, size)
        if one(FILL, 1) == 2:
            raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).tobytes()
        part = _samples(unpacked(raw, compression, whole), across, rows, deep, bits, fields["order"])
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        elif one(PREDICTOR, 1) != 1:
            raise ValueError(f"TIFF predictor {one(PREDICTOR, 1)} is not read")
        part = part[: height - y, : width - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane if planar else slice(None)] = part[:, :, 0] if planar else part
    return out


def picture(fields: dict, read: Read) -> np.ndarray:
    """A frame upright, with 8 bits a sample: (rows, columns, 1) of grey or (rows, columns, 3) of red, green, blue."""
    a, bits, kind = decoded(fields, read), fields.get(BITS, (1,))[0], fields.get(PHOTOMETRIC, (1,))[0]
    if kind == 3:
        colours = np.array(fields[PALETTE], np.uint32).reshape(3, -1)
        a = (colours[:, a[:, :, 0]] >> 8).astype(np.uint8).transpose(1, 2, 0)
    else:
        a = (a >> 8).astype(np.uint8) if bits == 16 else a if bits == 8 else (a * (255 // ((1 << bits) - 1))).astype(np.uint8)
        if kind == 0:
            a = 255 - a[:, :, :1]
        elif kind == 1:
            a = a[:, :, :1]
        elif kind == 2 and a.shape[2] >= 3:
            a = a[:, :, :3]
        elif kind == 5 and a.shape[2] >= 4:
            light = 255 - a[:, :, :4].astype(np.uint16)
            a = (light[:, :, :3] * light[:, :, 3:] // 255).astype(np.uint8)
        else:
            raise ValueError(f"TIFF pictures of kind {kind} with {a.shape[2]} samples are not read")
    return oriented(a, fields.get(ORIENTATION, (1,))[0])


# ------------------------------------------------------------ data source

SCHEMA = "path string, frame int, width int, height int, channels int, data binary, error string"


def pixels(a: np.ndarray) -> bytes:
    """A picture's bytes as Spark's image source has them: grey, or blue, green and red."""
    return np.ascontiguousarray(a[:, :, ::-1]).tobytes()


def opened(path: str):
    """A file of any store that Arrow knows, for reading at any place."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def reader(file) -> Read:
    def read(place: int, size: int) -> bytes:
        file.seek(place)
        return file.read(size)

    return read


@dataclass
class Share(InputPartition):
    """Files, and which of ``of`` equal shares of their frames to read."""

    paths: list[str]
    share: int = 0
    of: int = 1


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a folder or file to load is needed")
        self.size, self.failing = int(options.get("share", SHARE)), options.get("mode", "fail").lower() != "permissive"

    def partitions(self) -> list[Share]:
        """Small files together, in shares of like size; a file larger than a share by frames. No file is opened."""
        from pyarrow import fs

        root = "/" + self.path[5:].lstrip("/") if self.path.startswith("file:") else self.path
        store, place = fs.FileSystem.from_uri(root)
        found = store.get_file_info(place)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        held = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
        prefix = "file:" if isinstance(store, fs.LocalFileSystem) else root.rstrip("/")[: -len(place.rstrip("/"))]
        shares, paths, size = [], [], 0
        for f in sorted((f for f in held if f.type == fs.FileType.File and f.path.lower().endswith(SUFFIXES)), key=lambda f: f.path):
            path = prefix + f.path
            if f.size > self.size:
                parts = -(-f.size // self.size)
                shares += [Share([path], k, parts) for k in range(parts)]
                continue
            if paths and size + f.size > self.size:
                shares.append(Share(paths))
                paths, size = [], 0
            paths.append(path)
            size += f.size
        return shares + ([Share(paths)] if paths or not shares else [])

    def read(self, share: Share) -> Iterator[tuple]:
        for path in share.paths:
            n = 0
            try:
                with opened(path) as file:
                    read = reader(file)
                    for fields in directories(read):
                        if n % share.of == share.share:
                            a = picture(fields, read)
                            yield path, n, a.shape[1], a.shape[0], a.shape[2], pixels(a), None
                        n += 1
            except (ValueError, KeyError, struct.error, OSError) as error:
                if self.failing:
                    raise ValueError(f"{path}, frame {n}: {error}") from error
                if n % share.of == share.share:
                    yield path, n, None, None, None, None, str(error)


class TiffSource(DataSource):
    """Options: ``path``; ``mode``, ``fail`` or ``permissive`` (an unreadable frame is a row with an ``error``, and
    ends its file); ``share``, bytes of files in a task."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))
