"""Exact top-k by inner product with KD-trees, one per shard.

Vectors become integers floor(1024 x); scores are integer inner products, held exactly in doubles where they stay under 2^53.
Each shard builds a KD-tree by median splits by rank on the widest axis (equal vectors split evenly, too) and keeps a
tight bounding box per node. A query walks the tree best first by the largest inner product that a box allows, and
prunes by its kth score so far. One shard goes first, for all queries; the kth score found there goes with the query to all other shards, whose
trees are pruned by it from their roots on. The shards' lists are then merged. Queries meet the shards in blocks.

Integers and scores beyond the range of a long count as its ends; shards that hold vectors for which doubles are not exact are compared in whole
numbers of any size, without a tree.
Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id. Only
vectors of equal length are compared. Of a repeated query id one row asks (the least vector); every repeated row is a
candidate, except rows with the query's own id. Equal scores go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.llm.session import cut, table

QUERY = "op5_exact_topk"
SCALE = 1024
LEAF = 128
SHARD_ROWS = 8192
QUERY_BLOCK = 2048
_LOW, _HIGH = -(2**63), 2**63 - 1


class KDTree:
    """Median splits by rank; node i has rows order[lo:hi] and the box box_lo[i], box_hi[i]."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        stack = [(0, len(points), -1, 0)] if len(points) else []
        while stack:
            lo, hi, parent, side = stack.pop()
            rows = self.order[lo:hi]
            low, high = points[rows].min(axis=0), points[rows].max(axis=0)
            me = len(self.nodes)
            self.nodes.append((lo, hi, -1, -1))
            self.low.append(low)
            self.high.append(high)
            if parent >= 0:
                a, b, left, right = self.nodes[parent]
                self.nodes[parent] = (a, b, me, right) if side == 0 else (a, b, left, me)
            if hi - lo > leaf:
                mid = (hi - lo) // 2
                split = np.argpartition(points[rows, int(np.argmax(high - low))], mid)
                self.order[lo:hi] = rows[split]
                stack += [(lo + mid, hi, me, 1), (lo, lo + mid, me, 0)]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that each node's box allows, for each query."""
        return np.maximum(queries, 0) @ np.array(self.high).T + np.minimum(queries, 0) @ np.array(self.low).T


def search(tree: KDTree, ids: np.ndarray, q: np.ndarray, q_id: int, k: int, bounds: np.ndarray, best: list[tuple[float, int]], floor: float = -np.inf) -> None:
    """Best-first walk; ``best`` is a heap of (score, -id) that keeps the kth bound, ``floor`` a kth score from elsewhere: lesser ones are not wanted."""
    if not tree.nodes:
        return
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < floor:
            return
        lo, hi, left, right = tree.nodes[node]
        if left >= 0:
            for x in (left, right):
                if bounds[x] >= floor:
                    heapq.heappush(heap, (-bounds[x], x))
            continue
        rows = tree.order[lo:hi]
        scores = tree.points[rows] @ q
        near = np.flatnonzero(scores >= floor)
        for j in near[np.argsort(-scores[near], kind="stable")]:
            i = int(ids[rows[j]])
            if i == q_id:
                continue
            item = (float(scores[j]), -i)
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
            elif scores[j] < best[0][0]:
                break
        if len(best) == k:
            floor = max(floor, best[0][0])


def compare(points: np.ndarray, ids: np.ndarray, q: np.ndarray, q_id: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, -id) in whole numbers of any size."""
    mine = [int(x) for x in q]
    scores = [(max(_LOW, min(_HIGH, sum(int(x) * y for x, y in zip(p, mine, strict=True)))), -int(i)) for p, i in zip(points, ids, strict=True) if i != q_id]
    return heapq.nlargest(k, scores)


def topk(vectors: DataFrame, query_filter, k: int = 10, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best for every row that meets ``query_filter``."""
    vec = F.col("v")
    ok = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), query_filter.alias("asks"))
    base = base.where(F.col("vec_id").isNotNull() & ok).withColumn("v", F.transform("v", lambda x: F.when(F.abs(x * SCALE) < F.lit(2.0**63), F.floor(x * SCALE)).when(x > 0, F.lit(_HIGH)).otherwise(F.lit(_HIGH) * -1 - 1))).withColumn("dim", F.size("v"))
    base = cut(base)
    n, n_q = base.agg(F.count("*"), F.count_if(F.coalesce("asks", F.lit(False)))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-(n_q or 0) // query_block))
    data = base.select("dim", (F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))).cast("int").alias("shard"), "vec_id", "v")
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = base.where("asks").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("s")).select(F.col("vec_id").alias("asker"), "s.dim", "s.v")
    asks = asks.withColumn("block", F.pmod(F.xxhash64("asker"), F.lit(blocks)).cast("int"))

    def one(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(rows) and len(queries):
            points, ids = np.array(rows["v"].tolist(), dtype=np.int64), rows["vec_id"].to_numpy()
            asked, names, floors = np.array(queries["v"].tolist(), dtype=np.int64), queries["asker"].to_numpy(), queries["floor"].to_numpy(np.float64)
            if float(np.abs(points.astype(np.float64)).max()) * float(np.abs(asked.astype(np.float64)).max()) * points.shape[1] >= 2.0**53:
                for q, q_id in zip(asked, names, strict=True):
                    out += [(int(q_id), -i, s) for s, i in compare(points, ids, q, int(q_id), k)]
                return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")
            tree, asked = KDTree(points.astype(np.float64)), asked.astype(np.float64)
            for at in range(0, len(asked), 256):
                part = asked[at : at + 256]
                every = tree.bounds(part)
                for q, q_id, bound, floor in zip(part, names[at : at + 256], every, floors[at : at + 256], strict=True):
                    best: list[tuple[float, int]] = []
                    search(tree, ids, q, int(q_id), k, bound, best, floor if floor == floor else -np.inf)
                    out += [(int(q_id), -i, int(s)) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    def found(rows: DataFrame, queries: DataFrame) -> DataFrame:
        keys = ["dim", "shard", "block"]
        return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(one, "query_id long, vec_id long, score long")

    local = cut(found(data.where("shard = 0"), asks.withColumns({"shard": F.lit(0), "floor": F.lit(None).cast("double")})))
    if shards > 1:
        kth = local.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
        rest = asks.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1)))).join(kth, F.expr("asker = query_id"), "left").select("asker", "dim", "v", "block", "shard", "floor")
        local = local.unionAll(found(data.where("shard > 0"), rest))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
