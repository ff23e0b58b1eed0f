"""What the operators share: row identity, staged tables, and vectorized kernels over the bytes of many texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.session import new_path

#: Bytes of text that a kernel takes at once; bounds its temporaries, not what it sees.
BLOCK_BYTES = 1 << 20

#: Bytes of rows that Spark hands to Python at once; rows of texts differ too much in size to be counted.
BATCH_BYTES = 4 << 20

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\f\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE.encode())] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ODD = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches between Spark and Python by ``BATCH_BYTES``, for this session's plans from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``h``: rows that share both are equal, whatever columns ``docs`` has besides."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return base.withColumn("h", F.xxhash64(F.lit("row"), "text"))


def keyed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``keyed``, with the whole row in the struct ``row``."""
    small_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), whole
    )
    return base.withColumn("h", F.xxhash64(F.lit("row"), "text"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["h"] == right["h"])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again; a lost executor costs nothing that was written."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables made by ``stage`` that nothing reads any more."""
    for df in staged:
        remove_path(df.sparkSession, df.staged_path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, beside the next stage's tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


# --- Arrow batches ------------------------------------------------------------------------------------------------


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` has about ``limit`` bytes each; a longer text comes by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string or binary column in a row, and where each value begins (and the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


# --- hashes -------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers that look random; the same everywhere."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * ODD + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03))


#: The base of all polynomial hashes, which differ by their tables, and its inverse.
BASE = 0x5851F42D4C957F2D
UNBASE = pow(BASE, -1, 1 << 64)

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the power 0 .. n-1, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if size <= 2 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> pa.DictionaryArray:
    """The bytes of spans that follow each other without overlapping: each distinct value once, and where it comes."""
    edges = np.zeros(len(buf) + 1, np.int8)
    full = ends > starts
    edges[starts[full]] += 1
    edges[ends[full]] -= 1
    data = (LOWER[buf] if lower else buf)[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span; the spans follow each other without overlapping. Each distinct value is hashed once."""
    found = distinct_spans(buf, starts, ends, lower)
    values = found.dictionary.to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(v, seed) for v in values), np.uint64, len(values))[found.indices.to_numpy()]


def line_digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each span, as two signed numbers; the spans follow each other without overlapping."""
    found = distinct_spans(buf, starts, ends, lower)
    whole = b"".join(map(xxhash.xxh3_128_digest, found.dictionary.to_pylist()))
    both = np.frombuffer(whole, ">i8").astype(np.int64).reshape(-1, 2)[found.indices.to_numpy()]
    return both[:, 0], both[:, 1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span ``buf[starts:ends]``, which may overlap; equal bytes give equal hashes wherever they lie.

    All seeds share the base, and strings made for it collide from 1024 bytes on: for short spans and features only.
    """
    table = random_words(seed, 256)
    if lower:
        table = table[LOWER]
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(table[buf] * powers(BASE, len(buf)), out=sums[1:])
    back = powers(UNBASE, len(buf) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * ODD)


def word_spans(buf: np.ndarray, offsets: np.ndarray, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of all texts begin and end, and each text's first word (and the number of all).

    ``outside`` says of each byte whether it separates words.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~outside[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(buf)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)
