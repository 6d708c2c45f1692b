"""What the operators share: the shared folder, text slices, ASCII words, hashes."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the word definition: ASCII white space separates words.
SPACES = " \t\n\x0b\x0c\r"
WORD_JAVA = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: By byte: whether it belongs to a word; by n: a mask of the first n bytes of eight.
_IN_WORD = ~np.isin(np.arange(256), list(SPACES.encode()))
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 6 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the warehouse where it names none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return where.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Later steps then start from files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of settled steps now: its cleaner acts when the driver collects garbage,
    which a driver with little to do may not do for half an hour. The second round takes what the first let go of.
    Nothing depends on it but disk; a session without a driver's JVM at hand, as in Spark Connect, goes on without."""
    for _ in range(2):
        gc.collect()
        if not hasattr(spark, "_jvm"):
            return
        spark._jvm.System.gc()
        time.sleep(0.6)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column; sizes shards so that they grow in number, not in size."""
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def shards_for(n_bytes: int, per_shard: int = 8 << 20) -> int:
    return max(16, -(-n_bytes // per_shard))


def release() -> None:
    """Gives the memory that Arrow and malloc hold for later back to the system. Spark keeps workers between tasks and
    stages, and what they hold counts beside the executor's heap. Where the C library has no malloc_trim, Arrow's alone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most `most` bytes of text, or one row. Memory is released before and after."""
    release()
    for batch in batches:
        yield from cuts(batch, text, most)
    release()


def cuts(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The slices of one batch."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < len(size):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def plain(column: pa.Array) -> pa.Array:
    """A string column without nulls, as large_string (a long text has no 2 GB limit)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    # Joined with nothing, so that the offsets start at 0: kernels that change texts misread those of a slice.
    column = pa.concat_arrays([column, column.slice(0, 0)])
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array; offsets start at 0."""
    column = pa.concat_arrays([column]) if column.offset == 0 else pa.concat_arrays([column, column.slice(0, 0)])
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(column: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words of each text, one after another, and where each text's words start (n + 1 offsets)."""
    texts = plain(column)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, off = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    off = off - off[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        seen = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
        flat, off = flat.filter(pa.array(full)), seen[off]
    return flat, off


def word_ids(column: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, an id for each word of the texts, and the texts' offsets."""
    flat, off = words(column, lower)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), off


def spread(h: np.ndarray) -> np.ndarray:
    """Mix the bits of uint64 values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash for each word, the same in every task."""
    from pandas.util import hash_array

    if not len(dictionary):
        return np.zeros(0, np.uint64)
    return hash_array(dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the texts, one after another, the same in every task, and the texts' offsets in
    words. Works on bytes, eight of a word at a time, so neither words nor a dictionary are made."""
    raw, off = buffers(plain(column))
    black = _IN_WORD[raw]
    begins, ends = black.copy(), black.copy()
    begins[1:] &= ~black[:-1]
    ends[:-1] &= ~black[1:]
    full = np.diff(off) > 0
    for mask, at in ((begins, off[:-1][full]), (ends, off[1:][full] - 1)):
        mask[at] = black[at]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    eight = np.ndarray(len(raw), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    h = spread(eight[start] & _FIRST_BYTES[np.minimum(length, 8)] ^ (length.astype(np.uint64) * _ODD))
    done, left = 8, np.flatnonzero(length > 8)
    while len(left):
        rest = length[left] - done
        h[left] = spread(h[left] * _ODD + (eight[start[left] + done] & _FIRST_BYTES[np.minimum(rest, 8)]))
        done, left = done + 8, left[rest > 8]
    return h, np.searchsorted(start, off)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` consecutive word hashes: multilinear with odd factors, then mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = spread(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.full(n, np.uint64(width), np.uint64)
    for j in range(width):
        out += hashes[j : j + n] * factors[j]
    return spread(out)


def inside(off: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n window starts lie, whole window, within one text."""
    ok = np.ones(max(n, 0), bool)
    for back in range(1, width):
        cut = off[1:-1] - back
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def owners(off: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
