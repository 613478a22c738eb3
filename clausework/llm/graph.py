"""Connected components by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.session import cut


def _ordered(e: DataFrame) -> DataFrame:
    return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component: the least node that links reach, for every node of ``links`` (a, b)."""
    e = cut(_ordered(links))
    last = None
    for _ in range(most_rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e = cut(_ordered(small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")))))
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
