"""The number of pages of a PDF file, by its cross-references and the tree of its pages.

The newest cross-reference section is followed to the older ones, be they tables or
streams; the newest entry of an object holds. Objects may lie in compressed object
streams. A file whose cross-references are damaged is searched for its objects, of
which the last one of a number holds. Nothing is drawn or decrypted.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

#: Characters that separate tokens, and those that end a token by themselves.
BLANK, DELIMITERS = b"\0\t\n\x0c\r ", b"()<>[]{}/%"
_PLAIN = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\0\t\n\x0c\r ]|%[^\r\n]*)*")
_NUMBER, _REFERENCE = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$"), re.compile(rb"(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
_OBJECT = re.compile(rb"(?<!\d)(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+obj(?![A-Za-z])")
_DEEP = 100


class Encrypted(ValueError):
    pass


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    number: int


@dataclass
class Stream:
    entries: dict
    start: int


class Parser:
    """Reads the values that a file's bytes write down."""

    def __init__(self, data: bytes):
        self.data = data

    def skip(self, at: int) -> int:
        return _SKIP.match(self.data, at).end()

    def value(self, at: int, depth: int = 0):
        """The value at a place, and the place after it."""
        if depth > _DEEP:
            raise ValueError("PDF values nested too deep")
        data, at = self.data, self.skip(at)
        if data.startswith(b"<<", at):
            at, found = self.skip(at + 2), {}
            while not data.startswith(b">>", at):
                key, at = self.value(at, depth + 1)
                if not isinstance(key, Name):
                    raise ValueError("PDF dictionary without a name")
                found[key], at = self.value(at, depth + 1)
                at = self.skip(at)
            return found, at + 2
        if data.startswith(b"[", at):
            at, items = self.skip(at + 1), []
            while not data.startswith(b"]", at):
                item, at = self.value(at, depth + 1)
                items.append(item)
                at = self.skip(at)
            return items, at + 1
        if data.startswith(b"/", at):
            word = _PLAIN.match(data, at + 1)
            raw = word.group() if word else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1")), at + 1 + len(raw)
        if data.startswith(b"(", at):
            return self._string(at)
        if data.startswith(b"<", at):
            end = data.index(b">", at)
            return data[at + 1 : end], end + 1
        found = _REFERENCE.match(data, at)
        if found:
            return Ref(int(found[1])), found.end()
        word = _PLAIN.match(data, at)
        if not word:
            raise ValueError(f"PDF value expected at {at}")
        raw = word.group()
        if _NUMBER.match(raw):
            return (float(raw) if b"." in raw else int(raw)), word.end()
        return {b"true": True, b"false": False}.get(raw), word.end()

    def _string(self, at: int) -> tuple[bytes, int]:
        begin, open_ = at, 0
        while at < len(self.data):
            c = self.data[at]
            if c == 0x5C:
                at += 1
            elif c == 0x28:
                open_ += 1
            elif c == 0x29:
                open_ -= 1
                if not open_:
                    return self.data[begin + 1 : at], at + 1
            at += 1
        raise ValueError("PDF string without an end")


class File(Parser):
    """A file's objects. ``places``: number to its offset, or to (object stream, index), or None for a free one."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.places: dict[int, int | tuple[int, int] | None] = {}
        self.trailer: dict = {}
        self._streams: dict[int, list] = {}
        self._open: set[int] = set()
        try:
            self._sections()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise ValueError("PDF file without a catalog")
        except Encrypted:
            raise
        except (ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error, RecursionError):
            self._searched()
        if self.trailer.get("Encrypt") is not None:
            raise Encrypted("encrypted PDF file")

    # ---------------------------------------------------------- cross-references

    def _sections(self) -> None:
        found = self.data.rfind(b"startxref")
        if found < 0:
            raise ValueError("PDF file without cross-references")
        waiting, seen = [self.value(found + 9)[0]], set()
        while waiting:
            at = waiting.pop(0)
            if at in seen or not isinstance(at, int) or not 0 <= at < len(self.data):
                if at in seen:
                    continue
                raise ValueError("PDF cross-references out of place")
            seen.add(at)
            at = self.skip(at)
            table = self.data.startswith(b"xref", at)
            trailer, free = self._table(at + 4) if table else (self._stream_section(at), [])
            self.trailer = trailer | self.trailer
            if trailer.get("Encrypt") is not None:
                raise Encrypted("encrypted PDF file")
            if table and "XRefStm" in trailer:  # objects that older readers are to take for free ones
                self._stream_section(self.skip(trailer["XRefStm"]))
            for number in free:
                self.places.setdefault(number, None)
            if "Prev" in trailer:
                waiting.append(trailer["Prev"])

    def _table(self, at: int) -> tuple[dict, list[int]]:
        """Enters a table's objects; its trailer and free numbers."""
        free: list[int] = []
        while True:
            at = self.skip(at)
            if self.data.startswith(b"trailer", at):
                return self.value(at + 7)[0], free
            first, at = self.value(at)
            count, at = self.value(at)
            for number in range(first, first + count):
                place, at = self.value(at)
                _, at = self.value(at)
                at = self.skip(at)
                if self.data[at : at + 1] == b"n":
                    self.places.setdefault(number, place)
                else:
                    free.append(number)
                at += 1

    def _stream_section(self, at: int) -> dict:
        stream, _ = self._indirect(at)
        if not isinstance(stream, Stream) or stream.entries.get("Type") != "XRef":
            raise ValueError("PDF cross-reference stream expected")
        widths = stream.entries["W"]
        content = self.content(stream)
        index = stream.entries.get("Index", [0, stream.entries["Size"]])
        numbers = [n for first, count in zip(index[::2], index[1::2], strict=True) for n in range(first, first + count)]
        for k, number in enumerate(numbers):
            row, fields = content[k * sum(widths) : (k + 1) * sum(widths)], []
            if len(row) < sum(widths):
                break
            for w in widths:
                fields.append(int.from_bytes(row[:w], "big"))
                row = row[w:]
            kind = fields[0] if widths[0] else 1
            self.places.setdefault(number, fields[1] if kind == 1 else (fields[1], fields[2]) if kind == 2 else None)
        return stream.entries

    def _searched(self) -> None:
        """All objects that stand in the file, and those in its object streams; the last one of a number holds."""
        self.places, self._streams = {}, {}
        for found in _OBJECT.finditer(self.data):
            self.places[int(found[1])] = found.start()
        held: dict[int, tuple[int, int]] = {}
        root = None
        for number in list(self.places):
            try:
                value = self.get(Ref(number))
                if isinstance(value, Stream) and value.entries.get("Type") == "ObjStm":
                    held |= {n: (number, k) for k, (n, _) in enumerate(self._held(number))}
                if isinstance(value, Stream) and value.entries.get("Type") == "XRef" and value.entries.get("Encrypt") is not None:
                    raise Encrypted("encrypted PDF file")
            except Encrypted:
                raise
            except (ValueError, IndexError, KeyError, TypeError, zlib.error, RecursionError):
                continue
        self.places = held | self.places
        for number in self.places:
            try:
                value = self.get(Ref(number))
            except (ValueError, IndexError, KeyError, TypeError, zlib.error, RecursionError):
                continue
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                root = Ref(number)
        self.trailer = {"Root": root}
        for found in re.finditer(rb"trailer", self.data):
            try:
                said = self.value(found.end())[0]
                if isinstance(said, dict) and said.get("Encrypt") is not None:
                    raise Encrypted("encrypted PDF file")
            except Encrypted:
                raise
            except (ValueError, IndexError):
                continue

    # ---------------------------------------------------------- objects

    def get(self, value):
        """What a reference refers to; other values are themselves. A free or missing object is None."""
        if not isinstance(value, Ref):
            return value
        place = self.places.get(value.number)
        if place is None or value.number in self._open:
            return None
        self._open.add(value.number)
        try:
            if isinstance(place, tuple):
                return self._held(place[0])[place[1]][1]
            found, number = self._indirect(place)
            if number != value.number:
                raise ValueError("PDF object out of place")
            return self.get(found)
        finally:
            self._open.discard(value.number)

    def _indirect(self, at: int):
        head = _OBJECT.match(self.data, self.skip(at))
        if not head:
            raise ValueError("PDF object expected")
        value, end = self.value(head.end())
        end = self.skip(end)
        if isinstance(value, dict) and self.data.startswith(b"stream", end):
            end += 6
            end += 2 if self.data.startswith(b"\r\n", end) else 1
            value = Stream(value, end)
        return value, int(head[1])

    def _held(self, number: int) -> list[tuple[int, object]]:
        """Numbers and values of the objects in an object stream."""
        if number not in self._streams:
            stream = self.get(Ref(number))
            if not isinstance(stream, Stream):
                raise ValueError("PDF object stream expected")
            inner = Parser(self.content(stream))
            at, pairs = 0, []
            for _ in range(self.get(stream.entries["N"])):
                n, at = inner.value(at)
                offset, at = inner.value(at)
                pairs.append((n, offset))
            first = self.get(stream.entries["First"])
            self._streams[number] = [(n, inner.value(first + offset)[0]) for n, offset in pairs]
        return self._streams[number]

    def content(self, stream: Stream) -> bytes:
        """A stream's bytes, unpacked. A false length does no harm to packed ones."""
        length = self.get(stream.entries.get("Length"))
        filters, how = self.get(stream.entries.get("Filter")) or [], self.get(stream.entries.get("DecodeParms")) or {}
        filters = filters if isinstance(filters, list) else [filters]
        how = how if isinstance(how, list) else [how]
        if not filters:
            return self.data[stream.start : stream.start + length]
        if [self.get(f) for f in filters] != ["FlateDecode"]:
            raise ValueError(f"PDF filters {filters} are not read")
        raw = zlib.decompressobj().decompress(self.data[stream.start :])
        how = self.get(how[0]) or {}
        if how.get("Predictor", 1) < 10:
            return raw
        return unpredicted(raw, how.get("Columns", 1) * how.get("Colors", 1) * how.get("BitsPerComponent", 8) // 8)


def unpredicted(raw: bytes, width: int) -> bytes:
    """Rows of ``width`` bytes, each after the number of the PNG filter that it went through (of single bytes)."""
    above, out = np.zeros(width + 1, np.int64), bytearray()
    for at in range(0, len(raw) - width, width + 1):
        kind, row = raw[at], np.zeros(width + 1, np.int64)
        row[1:] = np.frombuffer(raw, np.uint8, width, at + 1)
        if kind == 1:
            row = np.cumsum(row) & 255
        elif kind == 2:
            row = (row + above) & 255
        elif kind in (3, 4):
            for k in range(1, width + 1):
                left, up, corner = int(row[k - 1]), int(above[k]), int(above[k - 1])
                guess = (left + up) // 2 if kind == 3 else min((left, up, corner), key=lambda v: abs(left + up - corner - v))  # noqa: B023
                row[k] = (row[k] + guess) & 255
        elif kind:
            raise ValueError(f"PNG filter {kind}")
        above = row
        above[0] = 0
        out += row[1:].astype(np.uint8).tobytes()
    return bytes(out)


def page_count(data: bytes) -> int:
    """Pages of a file: the count at the root of its tree of pages, or, without a usable one, the leaves of the tree."""
    file = File(data)
    catalog = file.get(file.trailer.get("Root"))
    pages = file.get(catalog.get("Pages")) if isinstance(catalog, dict) else None
    if not isinstance(pages, dict):
        raise ValueError("PDF file without pages")
    said = file.get(pages.get("Count"))
    if isinstance(said, int) and not isinstance(said, bool) and said >= 0:
        return said
    count, waiting, seen = 0, [pages], set()
    while waiting:
        node = waiting.pop()
        kids = file.get(node.get("Kids"))
        if not isinstance(kids, list):
            count += 1
            continue
        for kid in kids:
            if kid not in seen and isinstance(file.get(kid), dict):
                seen.add(kid)
                waiting.append(file.get(kid))
    return count
