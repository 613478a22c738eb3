"""Caches of embeddings and answers, as what an access log would have found in them.

A cache is dealt into shards by a hash of the key, each of which forgets by itself: the least recently used key when it is full, any key whose value
is older than the time to live. A shard's accesses are read in order by one task, which holds no more than the shard's keys; with one shard the cache
is a single one. A hit is when the key is held; a miss puts it there, if its value is worth keeping.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBEDDINGS_KEPT, ANSWER_LEAST = 10_000, 0.5  # fixed values
DAY = 86_400  # fixed value: seconds that a shared cache keeps a value


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key, from its md5."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % shards).cast("int")


class Shard:
    """Keys by last use, with the time at which each was put."""

    def __init__(self, size: int | None, ttl: float | None):
        self.size, self.ttl, self.put = size, ttl, OrderedDict()

    def access(self, key: str, at: float, keep: bool) -> bool:
        """Whether the key is held; puts it where it is not."""
        since = self.put.get(key)
        if since is not None and (self.ttl is None or at - since < self.ttl):
            self.put.move_to_end(key)
            return True
        self.put.pop(key, None)
        if keep:
            if self.size is not None and len(self.put) >= self.size:
                self.put.popitem(last=False)
            self.put[key] = at
        return False


def replay(log: DataFrame, key: str, at: str, order: str, size: int | None = EMBEDDINGS_KEPT, ttl: float | None = None, shards: int = 64, keep: Column | None = None) -> DataFrame:
    """``log`` with ``shard`` and ``hit``: whether a cache of ``size`` keys a shard would have held the key.

    ``at`` is a time in seconds, ``order`` what orders accesses of one time. ``keep`` says whether a value is worth keeping, all are by default. Accesses without a
    key are never held. Without a size nothing is forgotten but by age: then a shard's keys are all in its task.
    """
    if (size is not None and size < 1) or shards < 1:
        raise ValueError("a cache has at least one place and one shard")
    cols = [c for c in log.columns if c not in ("shard", "hit")]
    d = log.select(*cols, F.coalesce(shard_of(F.col(key), shards), F.lit(-1)).alias("shard"), F.col(key).cast("string").alias("__key"), F.col(at).cast("double").alias("__at"), (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("__keep"))
    d = d.repartition(shards, "shard").sortWithinPartitions("shard", "__at", order)
    names = [*cols, "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        for b in batches:
            hits = []
            for s, k, t, good in zip(*(b.column(c).to_pylist() for c in ("shard", "__key", "__at", "__keep")), strict=True):
                if s != shard:
                    shard, held = s, Shard(size, ttl)
                hits.append(k is not None and t is not None and held.access(k, t, good))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(hits, pa.bool_())], names=[*names, "hit"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*names).schema.fields)
    return d.mapInArrow(run, f"{kinds}, hit boolean")


def hit_rates(replayed: DataFrame) -> DataFrame:
    """shard, accesses, hits and hit_rate."""
    d = replayed.groupBy("shard").agg(F.count("*").alias("accesses"), F.count_if("hit").alias("hits"))
    return d.withColumn("hit_rate", F.try_divide("hits", "accesses"))
