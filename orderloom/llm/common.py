"""Shared helpers: scratch tables, Arrow text buffers, word and byte hashing.

Every operator reads ``documents`` through :func:`columns`, which selects the
columns it needs by name, so extra columns (whatever they are called) never
clash with internal names.
"""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that one numpy step works on; bounds a Python worker's memory.
SLICE_BYTES = 2 << 20
#: Bytes hashed at a time.
BLOCK = 1 << 18
#: The word pattern of the contracts: runs of bytes other than these.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


# --------------------------------------------------------------- scratch tables
def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a fresh one if unset.

    Unset happens in tests and in local mode only; a cluster without the setting
    gets a folder in the warehouse, which its executors share.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    app = spark.sparkContext.applicationId  # the setting cannot be changed in a running session
    if app not in _UNSET:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        _UNSET[app] = "file://" + tempfile.mkdtemp(prefix="checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return _UNSET[app]


def written(df: DataFrame, name: str, fmt: str = "parquet", parts: int | None = None, group_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back; ``parts`` merges its partitions
    to so many, for results much smaller than what they are made of. ``group_rows``: rows of
    a Parquet row group at most, for rows of some MB; both writer and reader hold a row
    group whole, and its size is looked at only every hundred rows.

    Cuts the lineage, so that a lost executor costs a re-read and not a
    recomputation, and lets Spark drop the shuffle files of the steps before.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if spark.conf.get(CLEANUP, "false") != "true":
        spark.conf.set(CLEANUP, "true")  # once a session, so that queries that run side by side agree
    writer = (df.coalesce(parts) if parts else df).write.format(fmt).option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).save(path)
    out = spark.read.schema(df.schema).format(fmt).load(path)
    out._scratch_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing lazily pending still reads."""
    for df in tables:
        path = df._scratch_path
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only ``names``; a missing one reads as null text (documents without a source)."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names])


def quoted(df: DataFrame) -> list:
    """All columns of ``df``, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def held_out(col: str = "doc_id"):
    """The fold rule of the contracts: crc32 of the id as text, remainder 2 of 4."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: crc32 of a text's bytes in SQL; 3988292384 is the reversed polynomial.
CRC32_SQL = (
    "xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT), lambda s, b: "
    "list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[], lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END, xor(s, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT"
)


# --------------------------------------------------------------- memory of workers
def give_back() -> None:
    """Returns freed memory to the system. Workers live on between tasks and two or more share
    an executor's memory with Spark, so what one only keeps for later is missing there."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(fn: Callable) -> Callable:
    """The function of a task (of batches, of a group, of two groups) with ``give_back`` now and then and at its end."""
    if inspect.isgeneratorfunction(fn):

        def batches(parts):
            last = time.monotonic()
            for out in fn(parts):
                yield out
                del out
                if time.monotonic() - last > 0.5:
                    give_back()
                    last = time.monotonic()
            give_back()

        return batches

    def group(table):
        try:
            return fn(table)
        finally:
            give_back()

    def groups(left, right):
        try:
            return fn(left, right)
        finally:
            give_back()

    return group if len(inspect.signature(fn).parameters) == 1 else groups


# --------------------------------------------------------------- Arrow buffers
def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n+1) of a string or binary array; null reads as empty."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    values = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``size`` bytes; a longer row is alone in its range."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def binaries(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], type=pa.binary())


# --------------------------------------------------------------- hashing
U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = (_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1), _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1))
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses modulo 2^64
_INV = tuple(pow(b, -1, 1 << 64) for b in _BASE)
_POW: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; grows by doubling and is kept per worker."""
    key = (which, inverse)
    have = _POW.get(key)
    if have is None or len(have) < n:
        b = _INV[which] if inverse else _BASE[which]
        have = np.ones(1, U) if have is None else have
        while len(have) < n:
            step = U(pow(b, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        if len(have) <= 4 * SLICE_BYTES:
            _POW[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all 64 (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of values[i] * base^i, from which any range's hash follows."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values), which), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end], alike wherever the range lies."""
    return mix((sums[end] - sums[start]) * powers(len(sums), which, True)[start])


def byte_values(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _BYTE[which][data]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of word bytes; runs never cross rows."""
    mask = is_word[data]
    if not len(mask):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut = begin[begin > 0]
    first[begin] |= mask[begin]
    last[cut - 1] |= mask[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def content_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes of each range, the ranges in order of ``start``; works on ``BLOCK`` bytes at a time."""
    out = np.zeros(len(start), U)
    for b in range(0, len(data), BLOCK):
        a, z = np.searchsorted(start, [b, b + BLOCK])
        if a < z:
            top = int(end[a:z].max())
            out[a:z] = range_hash(prefix_sums(byte_values(data[b:top], which), which), start[a:z] - b, end[a:z] - b, which)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, which: int = 0):
    """(hash, row) of every word in order, with the spans."""
    start, end, row = word_spans(data, offsets, is_word)
    return content_hashes(data, start, end, which), row, start, end


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Index in a row-sorted array at which each of n rows begins (n+1 values)."""
    return np.searchsorted(row, np.arange(n + 1))
