"""Finding documents in folders: one per PDF or TIFF, one per folder of images, pages in natural order."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.sources import pdftree, tiff

#: File suffixes of each kind.
IMAGES = ("png", "jpg", "jpeg", "heic", "heif", "webp", "bmp")
TIFFS = ("tif", "tiff")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    s = suffix(path)
    return F.when(s == "pdf", "pdf").when(s.isin(*TIFFS), "tiff").when(s.isin(*IMAGES), "images")


def _stamp(size: Column, modified: Column) -> Column:
    return F.concat(size.cast("string"), F.lit(":"), F.unix_micros(modified).cast("string"), F.lit("000"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, modified of every file below a folder; the contents are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def documents(listing: DataFrame) -> DataFrame:
    """id, title, kind, source_paths, page_count (null where only a decoder knows) of a listing.

    Images of one folder are one document titled by the folder; PDF and TIFF
    files stand alone, titled by their name. Ids hash paths, sizes and times.
    """
    rows = listing.dropDuplicates(["path"]).withColumn("kind", kind(F.col("path"))).where("kind is not null")
    parts = F.split("path", "/")
    name, folder = F.element_at(parts, -1), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    stamped = F.concat("path", _stamp(F.col("size"), F.col("modified")))
    rows = rows.select("path", "kind", name.alias("name"), folder.alias("folder"), stamped.alias("stamp"), text.natural_key(name).alias("key"))
    images = rows.where("kind = 'images'").groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("key", "path", "stamp"))).alias("f"))
    images = images.select(F.element_at(F.split("folder", "/"), -1).alias("title"), F.lit("images").alias("kind"), "f")
    single = rows.where("kind <> 'images'").select(F.regexp_replace("name", r"\.[^.]+$", "").alias("title"), "kind", F.array(F.struct("key", "path", "stamp")).alias("f"))
    both = images.unionByName(single)
    digest = F.substring(F.sha2(F.array_join(F.transform("f", lambda x: x["stamp"]), ""), 256), 1, 20)
    pages = F.when(F.col("kind") == "images", F.size("f"))
    return both.select(digest.alias("id"), "title", "kind", F.transform("f", lambda x: x["path"]).alias("source_paths"), pages.alias("page_count")).orderBy(F.lower("title"), "id")


def image_pages(found: DataFrame) -> DataFrame:
    """document_id, page_index, source_path of the documents made of images; of a TIFF its first frame."""
    return found.where("kind in ('images', 'tiff')").select(F.col("id").alias("document_id"), F.posexplode("source_paths").alias("page_index", "source_path"))


def load_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, channels and interleaved bytes (blue, green, red) of PNG, JPEG and BMP files.

    Spark's image source decodes them; pictures that a camera marked as turned are turned upright.
    PDF and HEIC need decoders that are not bundled.
    """
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(folder).select("image.*")
    rows = rows.where(~suffix(F.col("origin")).isin(*TIFFS))  # of which the JVM gives the first frame
    plain = F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))
    return rows.select(plain.alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data").mapInPandas(_upright, "path string, width int, height int, channels int, data binary")


def load_scans(spark: SparkSession, folder: str) -> DataFrame:
    """``load_images`` and all frames of TIFF files, with ``frame`` (0 for images)."""
    spark.dataSource.register(tiff.TiffSource)
    frames = spark.read.format("tiff").load(folder).select("path", "frame", "width", "height", "channels", "data")
    return load_images(spark, folder).select("path", F.lit(0).alias("frame"), "width", "height", "channels", "data").unionByName(frames)


def exif_orientation(head: bytes) -> int:
    """How a JPEG or PNG file says its picture is turned, from 1 (upright) to 8; 1 where it does not say."""
    exif = b""
    try:
        if head[:2] == b"\xff\xd8":
            at = 2
            while head[at] == 0xFF and head[at + 1] not in (0xDA, 0xD9):
                size = int.from_bytes(head[at + 2 : at + 4], "big")
                if head[at + 1] == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
                    exif = head[at + 10 : at + 2 + size]
                    break
                at += 2 + size
        elif head[:8] == b"\x89PNG\r\n\x1a\n":
            at = 8
            while not exif:
                size = int.from_bytes(head[at : at + 4], "big")
                if head[at + 4 : at + 8] == b"eXIf":
                    exif = head[at + 8 : at + 8 + size]
                if head[at + 4] == 0 or head[at + 4 : at + 8] == b"IEND":
                    break
                at += 12 + size
        said = next(tiff.directories(lambda place, size: exif[place : place + size])).get(tiff.ORIENTATION, (1,))[0]
    except (ValueError, IndexError, struct.error):
        return 1
    return said if 1 <= said <= 8 else 1


#: Bytes at the beginning of a file in which its orientation is looked for.
HEAD = 1 << 17


def _upright(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k, path in zip(batch.index, batch["path"], strict=True):
            if path.lower().endswith((".jpg", ".jpeg", ".png")):
                with tiff.opened(path) as file:
                    said = exif_orientation(file.read(HEAD))
                if said > 1:
                    size = (batch.at[k, "height"], batch.at[k, "width"], batch.at[k, "channels"])
                    a = np.ascontiguousarray(tiff.oriented(np.frombuffer(batch.at[k, "data"], np.uint8).reshape(size), said))
                    batch.at[k, "height"], batch.at[k, "width"], batch.at[k, "data"] = a.shape[0], a.shape[1], a.tobytes()
        yield batch


def load_page(pages: DataFrame, document_id: str, index: int) -> DataFrame:
    """The one row of a page; a page that is not there is an IndexError."""
    found = pages.where((F.col("document_id") == document_id) & (F.col("page_index") == index))
    if found.isEmpty():
        raise IndexError(f"{document_id} has no page {index}")
    return found


def tiff_pages(content: bytes) -> int:
    """Frames of a TIFF file (classic or big): the length of its chain of directories, without decoding any."""
    return sum(1 for _ in tiff.directories(lambda place, size: content[place : place + size]))


_PDF_PAGE, _PDF_STREAM = re.compile(rb"/Type\s*/Page(?![A-Za-z])"), re.compile(rb"/ObjStm\b.{0,400}?stream\r?\n", re.S)


def pdf_pages(content: bytes) -> int:
    """Pages of a PDF file by its tree of pages, see ``pdftree``; of a file without one its page objects. Encrypted files are an error."""
    try:
        return pdftree.page_count(content)
    except pdftree.Encrypted:
        raise
    except (ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error, RecursionError) as error:
        count = len(_PDF_PAGE.findall(content))
        for found in _PDF_STREAM.finditer(content):
            try:
                count += len(_PDF_PAGE.findall(zlib.decompressobj().decompress(content[found.end() :])))
            except zlib.error:
                continue
        if not count:
            raise ValueError("PDF file without pages") from error
        return count


def page_counts(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, pages of every TIFF and PDF file below a folder; unreadable files have null."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for sort, content in zip(batch["kind"], batch["content"], strict=True):
                try:
                    found.append((tiff_pages if sort == "tiff" else pdf_pages)(content))
                except (ValueError, struct.error):
                    found.append(None)
            yield pd.DataFrame({"path": batch["path"], "kind": batch["kind"], "pages": pd.array(found, "Int64")})

    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).withColumn("kind", kind(F.col("path")))
    return held.where(F.col("kind").isin("tiff", "pdf")).select("path", "kind", "content").mapInPandas(count, "path string, kind string, pages long")
