"""A bitmap of document ids of bounded size: it tells in place which rows a join could want, so that only these are shuffled.

A row that it does not hold is certainly not wanted; an exact join must follow for the others. Beyond ``MOST_BITS`` / 8 ids
more and more rows pass, at last all, which costs a shuffle of them but loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.words import U64, mix

if TYPE_CHECKING:
    from pyspark import Broadcast

LEAST_BITS, MOST_BITS = 1 << 13, 1 << 26
BITS_PER_ID = 16


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15))
    return (h & U64(bits - 1)).astype(np.int64), (h >> U64(32) & U64(bits - 1)).astype(np.int64)


class Bitmap:
    def __init__(self, words: Broadcast, bits: int):
        self.words, self.bits = words, bits

    def might_hold(self, ids: np.ndarray) -> np.ndarray:
        words, yes = self.words.value, np.ones(len(ids), bool)
        for at in _places(ids, self.bits):
            yes &= (words[at >> 6] >> (at & 63).astype(U64) & U64(1)).astype(bool)
        return yes

    def narrow(self, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
        """Rows of ``docs`` (ids not null) that might be held."""
        where = docs.columns.index(doc_id)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                some = b.filter(pa.array(self.might_hold(b.column(where).to_numpy(zero_copy_only=False))))
                if some.num_rows:
                    yield some

        return docs.mapInArrow(run, docs.schema)


def build(ids: DataFrame) -> Bitmap:
    """The bitmap of the one column of ``ids`` (long, not null), merged by tasks; at most ``MOST_BITS`` bits reach the driver."""
    spark = ids.sparkSession
    bits = LEAST_BITS
    n = ids.count()
    while bits < MOST_BITS and bits < BITS_PER_ID * n:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, U64)
        for b in batches:
            for at in _places(b.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(words, at >> 6, U64(1) << (at & 63).astype(U64))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], names=["at", "word"])

    merged = ids.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, U64)
    words[merged.column("at").to_numpy()] = merged.column("word").to_numpy().view(U64)
    return Bitmap(spark.sparkContext.broadcast(words), bits)
