"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)
#: The bytes that separate words: [\x20\x09-\x0D].
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Lower-cases A-Z and leaves every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("millrace.scratch.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.scratch.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application has materialised: for when its results are written and nothing reads them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: it cuts the lineage and survives lost executors.

    What was shuffled for it goes when it is written, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if name.startswith(shared_dir(spark)) or shared_dir(spark).removeprefix("file://") in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_fold(column: str, n: int) -> Column:
    """crc32 of the id written in decimal, modulo n; a null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def share_of(share: float, *columns: Column | str) -> Column:
    """Whether a row is in a share (0 to 1) of all, by a 64-bit hash of the columns: shares far below a millionth keep their meaning."""
    return F.xxhash64(*columns) <= share_bound(share)


def share_bound(share: float) -> Column:
    """The highest 64-bit hash in a share of all."""
    return F.lit(max(-(1 << 63), min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))))


def in_slices(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` over the batches cut into slices of so many rows, so that what it makes of long texts at once stays small. A Python worker lives on
    from stage to stage: at the end what it has freed goes back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return freed memory to the system, where its library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser, the same in every process."""
    with np.errstate(over="ignore"):
        x = x + MIX_A
        x = (x ^ (x >> np.uint64(30))) * MIX_B
        x = (x ^ (x >> np.uint64(27))) * MIX_C
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)))) for b in (self.base, self.inverse))


_POWERS: dict[int, Powers] = {}
_TABLES: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base, and of its inverse."""
    p = _POWERS.setdefault(base, Powers(base))
    p.need(n)
    return p.up, p.down


def prefix_sums(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): the bytes [i, j) hash to (sums[j] - sums[i]) * inverse[i], wherever they stand."""
    up, down = powers(len(data) + 1, base)
    if base not in _TABLES:
        _TABLES[base] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_TABLES[base][data] * up[: len(data)], out=sums[1:])
    return sums, down


BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xD1342543DE82EF95 | 1


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of other bytes than white space."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACES[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: Long texts are hashed in pieces of about so many bytes; a word's hash doesn't depend on its place.
SEGMENT = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(raw: bytes) -> Iterator[bytes]:
    """The bytes in pieces that end before white space."""
    at = 0
    while at < len(raw):
        found = _SPACE.search(raw, at + SEGMENT)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the bytes, in order."""
    if len(raw) > SEGMENT:
        return np.concatenate([_hashes(piece) for piece in pieces(raw)])
    return _hashes(raw)


def _hashes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    start, end = word_bounds(data)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    sums, inverse = prefix_sums(data, BASE)
    return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words; of the whole sequence where there are fewer; none without words."""
    if not len(words):
        return words
    m = min(n, len(words))
    out = np.zeros(len(words) - m + 1, dtype=np.uint64)
    for k in range(m):
        out = mix64(out + words[k : len(words) - m + 1 + k])
    return out
