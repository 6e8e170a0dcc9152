"""Helpers shared by the operators: shared-folder tables, text arrays, hashing."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised kernels, and rows in an Arrow batch; both bound Python memory.
CHUNK_CHARS = 500_000
BATCH_ROWS = 1000

U64 = np.uint64
_P1 = U64(0x9E3779B97F4A7C15)
_P2 = U64(0xBF58476D1CE4E5B9)
_P3 = U64(0x94D049BB133111EB)


# ---------------------------------------------------------------- tables


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in a local session without one, as in tests, its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"/tmp/quillmark-checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The reread table has known file sizes, so Catalyst itself decides from them
    whether a later join broadcasts it (autoBroadcastJoinThreshold) or shuffles.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(found)] = found, path
    return found


_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that no plan still to run reads."""
    for table in tables:
        _, path = _WRITTEN.pop(id(table))
        _delete(table.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables this application has materialised; results not yet read are lost."""
    _WRITTEN.clear()
    _delete(spark, f"{shared_dir(spark)}/quillmark/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small, where the session has Spark's default of 10,000 rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of a ``Bitmap``: its size, whatever the input's.
BITMAP_BITS = 1 << 25


class Bitmap:
    """A table of bits at places of a column's whole numbers: it says of a number "perhaps there" or "surely not".

    A filter before a shuffle join: however many values there are, it takes 4 MB,
    and more of them only let more rows pass to the join that decides.
    """

    def __init__(self, rows: DataFrame, column: str):
        value = F.col(column).cast("long")
        at = value.bitwiseXOR(F.shiftrightunsigned(value, 25)).bitwiseXOR(F.shiftrightunsigned(value, 50)).bitwiseAND(F.lit(BITMAP_BITS - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
        found = rows.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        self.words = np.zeros(BITMAP_BITS // 64, U64)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(U64)

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        value = values.view(U64)
        at = (value ^ (value >> U64(25)) ^ (value >> U64(50))) & U64(BITMAP_BITS - 1)
        return (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def crc_mod(column: str, modulus: int):
    """crc32(column as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# ---------------------------------------------------------------- batches


def _tidy() -> None:
    """Gives freed memory back: workers live long and change operators."""
    if "trim" not in _TABLES:
        import ctypes

        _TABLES["trim"] = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)
    _TABLES["trim"](0)
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of an Arrow batch whose texts sum to about ``limit`` bytes each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    group = (np.cumsum(sizes.astype(np.int64)) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
    _tidy()


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and the offset at which each begins (n + 1 offsets)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), offsets


_TABLES: dict = {}

#: Classes of a code point.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def classes() -> np.ndarray:
    """Class of every code point by Unicode general category; white space as Unicode's White_Space."""
    if "classes" not in _TABLES:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                table[c] = LETTER
            elif kind == "N":
                table[c] = NUMBER
            elif kind == "Z":
                table[c] = SPACE
        for c in (9, 10, 11, 12, 13, 0x85):
            table[c] = SPACE
        _TABLES["classes"] = table
    return _TABLES["classes"]


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> U64(30))) * _P2
    x = (x ^ (x >> U64(27))) * _P3
    return x ^ (x >> U64(31))


_BASE = U64(0x5851F42D4C957F2D)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _TABLES.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        _TABLES[name] = have = np.cumprod(have, dtype=U64)
    return have


def scattered(points: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit number for each code point."""
    if "scattered" not in _TABLES:
        _TABLES["scattered"] = mix(np.arange(0x110000, dtype=U64) + _P1)
    return _TABLES["scattered"][points]


class Rolling:
    """Hashes of any substrings of an array of code points, after one pass over it (polynomial modulo 2^64)."""

    def __init__(self, points: np.ndarray, values: np.ndarray | None = None):
        n = len(points)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((scattered(points) if values is None else values) * _powers("base", _BASE, n + 1)[:n], out=self.sums[1:])
        self.inverse = _powers("inverse", _INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw ^ ((end - start).astype(U64) * _P1))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-case word (run of letters and digits) and each text's offset in them."""
    points, offsets = code_points([t.lower() for t in texts])
    if not len(points):
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    inside = np.isin(classes()[points], (LETTER, NUMBER))
    first = np.zeros(len(points), bool)
    first[offsets[:-1][offsets[:-1] < len(points)]] = True
    start = np.flatnonzero(inside & (first | ~np.concatenate(([False], inside[:-1]))))
    last = np.zeros(len(points), bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    end = np.flatnonzero(inside & (last | ~np.concatenate((inside[1:], [False])))) + 1
    return Rolling(points)(start, end), np.searchsorted(start, offsets)


#: Words in a shingle, and the similarity from which texts are near-duplicates.
SHINGLE, SIMILAR = 5, 0.8


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash for each window of ``size`` words; a shorter text is one shingle, no words none."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, U64)
    size = min(size, n)
    out = np.zeros(n - size + 1, U64)
    for k in range(size):
        out = mix(out * _P1 + hashes[k : n - size + 1 + k])
    return out
