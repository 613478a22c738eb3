"""Documents and notes about them, brought together by document bucket.

Texts travel as compressed Arrow batches of the rows of a bucket, notes as blobs. In each bucket notes come first,
then the ids of copies, then the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm import blobs
from clausework.llm.session import cut

SCHEMA = "bucket int, kind int, n int, payload binary"
NOTES, COPIES, ROWS = 0, 1, 2
FLUSH_BYTES = 16 << 20
VISIT_BYTES = 1 << 20
_NAMES = ["bucket", "kind", "n", "payload"]


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (doc ^ (doc >> 7) ^ (doc >> 15)) % buckets


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=_NAMES)


class Notes:
    """Collects arrays about documents and gives blobs for the documents' buckets."""

    def __init__(self, buckets: int, kind: int = NOTES):
        self.buckets, self.kind, self.held, self.n = buckets, kind, [], 0

    def add(self, doc: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(doc):
            self.held.append((doc, *columns))
            self.n += len(doc)
        if self.n >= blobs.FLUSH_ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        doc, *columns = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        home = _bucket(doc, self.buckets)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(self.buckets + 1))
        yield _batch([(i, self.kind, int(b - a), blobs.pack([x[order[a:b]] for x in columns])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a])


def copies_of(docs: DataFrame) -> DataFrame:
    """doc_id, uid of rows whose whole text a smaller id has, too; texts are compared by SHA-256."""
    digests = cut(docs.select("doc_id", "uid", F.sha2("text", 256).alias("digest")))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return cut(digests.join(first, "digest").where("doc_id > first").select("doc_id", "uid").distinct())


def gather(docs: DataFrame, copies: DataFrame, notes: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``docs`` (with doc_id, uid and text), ids of copies and notes, by bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            home = _bucket(table.column("doc_id").to_numpy(), buckets)
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(buckets + 1))
            table = table.take(pa.array(order)).combine_chunks()
            out = []
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, table.schema, options=options) as w:
                        w.write_table(table.slice(a, b - a))
                    out.append((i, ROWS, int(b - a), sink.getvalue().to_pybytes()))
            yield _batch(out)

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                if part.num_rows:
                    held.append(part)
                    size += part.get_total_buffer_size() if b.num_rows <= 4096 else b.nbytes * part.num_rows // b.num_rows
                if size >= FLUSH_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        blobs.release()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Notes(buckets, COPIES)
        for b in batches:
            yield from sender.add(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "uid")))
        yield from sender.flush()

    every = notes.unionAll(copies.mapInArrow(ids, SCHEMA)).unionAll(docs.mapInArrow(rows, SCHEMA))
    return blobs.deal(every, "kind")


def visits(batches: Iterator[pa.RecordBatch], kinds: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray, pa.RecordBatch]]:
    """For each group of rows: its bucket's notes, sorted by their first column, and a mark of rows that are copies.

    With many buckets a payload has a few rows only, so payloads of a bucket are put together up to ``VISIT_BYTES``.
    """
    at, held, copies, notes = None, [], [], None
    tables: list[pa.Table] = []
    size = 0

    def group() -> Iterator[tuple[list[np.ndarray], np.ndarray, pa.RecordBatch]]:
        nonlocal size
        if tables:
            for rows in pa.concat_tables(tables).combine_chunks().to_batches():
                yield notes, np.isin(rows.column("uid").to_numpy(), same), rows
        tables.clear()
        size = 0

    for b in batches:
        for bucket, kind, n, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if bucket != at:
                yield from group()
                at, held, copies, notes = bucket, [], [], None
            if kind == NOTES:
                held.append(blobs.unpack(payload.as_py(), n, kinds))
            elif kind == COPIES:
                copies.append(blobs.unpack(payload.as_py(), n, ["<i8"])[0])
            else:
                if notes is None:
                    notes = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.dtype(t)) for t in kinds]
                    order = np.argsort(notes[0], kind="stable")
                    notes, held = [a[order] for a in notes], []
                    same = np.concatenate(copies) if copies else np.zeros(0, np.int64)
                tables.append(pa.ipc.open_stream(payload.as_buffer()).read_all())
                size += tables[-1].nbytes
                if size >= VISIT_BYTES:
                    yield from group()
    yield from group()
