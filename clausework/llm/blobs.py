"""Compact shuffles: many small fixed-width entries travel as a few compressed blobs for each bucket of a 64-bit key."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.session import shuffle_partitions

SCHEMA = "bucket int, n int, payload binary"
FLUSH_ENTRIES = 1 << 20
BUCKETS_PER_PARTITION = 2
_CODEC = pa.Codec("zstd", 1)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Columns as byte planes, which compress where high bytes repeat."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return _CODEC.compress(planes, asbytes=True)


def unpack(payload: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    width = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(_CODEC.decompress(payload, n * sum(width), asbytes=True), np.uint8)
    out, at = [], 0
    for k, w in zip(kinds, width, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


def pack_with_ids(arrays: list[np.ndarray]) -> bytes:
    """Like ``pack``, with the values of the second column once each, and their places in the rows."""
    key, ids, *rest = arrays
    own, at = np.unique(ids, return_inverse=True)
    head = pack([own])
    return len(own).to_bytes(4, "little") + len(head).to_bytes(4, "little") + head + pack([key, at.astype(np.uint32), *rest])


def unpack_with_ids(payload: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    size = 8 + int.from_bytes(payload[4:8], "little")
    own = unpack(payload[8:size], int.from_bytes(payload[:4], "little"), kinds[1:2])[0]
    key, at, *rest = unpack(payload[size:], n, [kinds[0], "<u4", *kinds[2:]])
    return [key, own[at], *rest]


def release() -> None:
    """Give freed memory back, so that idle workers hold little."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    pa.default_memory_pool().release_unused()


def buckets_of(df: DataFrame) -> int:
    return BUCKETS_PER_PARTITION * shuffle_partitions(df.sparkSession)


class Sender:
    """Collects entries, keys first, and gives batches of blobs."""

    def __init__(self, buckets: int, pack: Callable[[list[np.ndarray]], bytes] = pack):
        self.buckets, self.held, self.n, self.pack = buckets, [], 0, pack

    def add(self, key: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            self.held.append((key, *columns))
            self.n += len(key)
        if self.n >= FLUSH_ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        arrays = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.n = [], 0
        order = np.argsort(arrays[0], kind="stable")
        arrays = [a[order] for a in arrays]
        bucket = ((arrays[0] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        rows = [(i, int(b - a), self.pack([x[a:b] for x in arrays])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "n", "payload"])


def deal(df: DataFrame, *order: str) -> DataFrame:
    """Rows by bucket, the same number of buckets in each partition."""
    n = shuffle_partitions(df.sparkSession)
    return df.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n))).sortWithinPartitions("bucket", *order)


def reduce_buckets(sent: DataFrame, kinds: list[str], start: Callable[[], tuple[Callable[..., Iterator[pa.RecordBatch]], Callable[[], Iterator[pa.RecordBatch]]]], schema: str, unpack: Callable[[bytes, int, list[str]], list[np.ndarray]] = unpack) -> DataFrame:
    """``start()`` gives, for each task, a function of a bucket's entries, sorted by key, and one for the end; one bucket at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        work, end = start()

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                arrays = [np.concatenate(c) for c in zip(*held, strict=True)]
                held.clear()
                order = np.argsort(arrays[0], kind="stable")
                yield from work([a[order] for a in arrays])

        for b in batches:
            for bucket, n, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != at:
                    yield from done()
                    at = bucket
                held.append(unpack(payload.as_py(), n, kinds))
        yield from done()
        yield from end()
        release()

    return deal(sent).mapInArrow(run, schema)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of runs of equal values."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return begin, np.diff(np.append(begin, len(key)))
