"""Packed postings: (hash, document) pairs of many texts, dealt to shards by the hash's top bits.

A task packs the pairs of a slice of texts into one row for each shard, so the engine moves a few large rows rather than
one row for each window. A slice sends each distinct hash once, which keeps frequent windows from filling a shard. The
number of shards is a power of two that grows with the text, so a shard's size does not.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from tidemark.llm import common as C

#: At least as many shards: the shard then stands for 8 bits of the hash, and 7 stored bytes make up the rest.
LEAST_SHARDS = 256
SHARED = np.uint16(0xFFFF)
#: Rows of a slice: a document's place in it fits in 16 bits.
MOST_ROWS = 60_000


def n_shards(n_bytes: int) -> int:
    return max(LEAST_SHARDS, 1 << (C.shards_for(n_bytes) - 1).bit_length())


def slice_number(count: int) -> int:
    """A number for a task's slice, the same when the task runs again."""
    at = TaskContext.get()
    return ((at.partitionId() if at else 0) << 32) + count


def pack_ids(ids: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids.astype(np.int64), prepend=np.int64(0)).tobytes(), 1)


def unpack_ids(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.int64))


def pack_hashes(h: np.ndarray) -> bytes:
    """The low 7 bytes of each hash."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpack_hashes(blob: bytes, shard: int, shards: int) -> np.ndarray:
    """The hashes again, the top byte from the shard: the top bits of the shard number are the top bits of the hash."""
    out = np.zeros((len(blob) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    top = shard >> (shards.bit_length() - 9)
    out[:, 7] = top
    return out.reshape(-1).view("<u8")


def segments(h: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of sorted hashes starts, and the end."""
    step = np.uint64(64 - (shards.bit_length() - 1))
    return np.concatenate([np.searchsorted(h, np.arange(shards, dtype=np.uint64) << step), [len(h)]])


def runs(h: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in sorted h."""
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)


def rows(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], names=list(types))
