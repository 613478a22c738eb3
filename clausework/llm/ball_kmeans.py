"""Exact k-means by balls: clusters are a centroid and a radius, and members are compared only with centroids that can be nearer.

Vectors become integers floor(1024 x). They lie in blocks; in each block a cluster's members are a ball whose radius is its farthest member's distance to the
new centroid. A centroid is a neighbour of the ball if half its distance to the ball's centroid is within the radius. Neighbours in order of
distance cut the ball into a stable core, whose members keep their cluster, and annuli: a member in the mth annulus is compared
exactly with the m nearest neighbours only (those with D <= 2 d, in whole numbers D^2 <= 4 d^2). Neither a ball nor a neighbour that
has not moved is compared again. The result is that of comparing all.

Each round writes the blocks with their clusters to the shared folder, with sums by cluster and component, from which the driver reads
k times the number of components; the round before is deleted. So a lost executor costs a part of one round. Centroids are held by every task:
k and the number of components are parameters, not grown by the data. Rounds end early where no centroid changes.

Vectors take part that have ``dim`` components, none of them null or non-finite. Those without an id do, too; they come last as starting
centroids. Repeated rows count each; among equal ids the lesser vector starts. Fewer vectors than ``k`` make fewer clusters, empty tables
give no rows. Integers, distances and sums beyond the range of a long count as its ends. Equal distances go to the smaller
cluster. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.session import ensure_checkpoint_dir, table

QUERY = "op13_ball_kmeans"
SCALE = 1024
CLUSTERS, DIM, ROUNDS, SEED = 8, 64, 10, 3
BLOCK = 8192
_LOW, _HIGH = -(2**63), 2**63 - 1
_EXACT = 2.0**51
_CODEC = pa.Codec("zstd", 1)
_STATE = "n int, ids binary, missing binary, points binary, kind string, own binary, cluster int, component int, total decimal(38,0)"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.decimal128(38, 0)]
DISTANCE, MEMBERS = -1, -2  # what stands for a component in rows of sums of distances and members


def _clip(x: int) -> int:
    return max(_LOW, min(_HIGH, x))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(1024 x): int32 or int64 where the type holds all of them, else Python's whole numbers within the range of a long."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    most = float(np.abs(scaled).max(initial=0))
    if most < 2.0**31:
        return scaled.astype(np.int32)
    if most < 2.0**62:
        return scaled.astype(np.int64)
    out = [_clip(int(x)) if np.isfinite(x) else (_HIGH if x > 0 else _LOW) for x in scaled.ravel()]
    return np.array(out, dtype=object).reshape(values.shape)


def comparable(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Points and centroids as doubles where squared distances are exact in them, else as Python's whole numbers."""
    most = int(np.abs(points).max(initial=0)) if points.dtype != object else max((abs(x) for x in points.ravel()), default=0)
    most += max((abs(x) for c in centroids for x in c), default=0)
    exact = most * most * max(1, points.shape[1]) < _EXACT
    kind = np.float64 if exact else object
    return points.astype(kind), np.array(centroids, dtype=object).astype(kind).reshape(len(centroids), points.shape[1])


def squares(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = rows - centroid
    return (d * d).sum(axis=1)


class Centroids:
    """Centroids with their neighbours in order of distance."""

    def __init__(self, values: list[list[int]], before: list[list[int]] | None = None):
        self.values = values
        self.moved = np.array([before is None or v != b for v, b in zip(values, before or values, strict=True)], dtype=bool)
        gaps = [[sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for b in values] for a in values]
        self.order = [sorted((j for j in range(len(values)) if j != i), key=lambda j: (gaps[i][j], j)) for i in range(len(values))]  # noqa: B023
        self.gaps = [[gaps[i][j] for j in o] for i, o in enumerate(self.order)]


def settle(points: np.ndarray, own: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of every point, from ``own``, which was nearest before; and how many distances were taken."""
    points, at = comparable(points, centroids.values)
    cluster, distance, taken = own.copy(), np.zeros(len(points), dtype=points.dtype), 0
    for i in np.unique(own):
        rows = np.flatnonzero(own == i)
        best, who = squares(points[rows], at[i]), np.full(len(rows), i)
        taken += len(rows)
        annulus = np.searchsorted(np.array(centroids.gaps[i], dtype=points.dtype), 4 * best, side="right")
        for m, j in enumerate(centroids.order[i][: int(annulus.max())]):
            if not (centroids.moved[i] or centroids.moved[j]):
                continue
            near = np.flatnonzero(annulus > m)
            d = squares(points[rows[near]], at[j])
            taken += len(near)
            nearer = (d < best[near]) | ((d == best[near]) & (j < who[near]))
            best[near[nearer]], who[near[nearer]] = d[nearer], j
        cluster[rows], distance[rows] = who, best
    return cluster, distance, taken


def _zip(a: np.ndarray) -> bytes:
    return _CODEC.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), asbytes=True) if a.size else b""


def _unzip(b: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_CODEC.decompress(b, n * size, asbytes=True), np.uint8).reshape(size, n).T).view(kind).reshape(n) if n else np.zeros(0, kind)


class _Block:
    """Ids, points and clusters of a block. Points that no integer type holds are kept as their doubles (kind f8)."""

    def __init__(self, row: dict, dim: int):
        n = row["n"]
        self.row, self.ids, self.missing, self.own = row, _unzip(row["ids"], "<i8", n), _unzip(row["missing"], "|b1", n), _unzip(row["own"], "<i4", n)
        values = _unzip(row["points"], row["kind"], n * dim).reshape(n, dim)
        self.points = whole(values) if row["kind"] == "<f8" else values

    @staticmethod
    def row(ids: np.ndarray, missing: np.ndarray, values: np.ndarray) -> dict:
        points = whole(values)
        kept = values if points.dtype == object else points.astype(np.int16) if np.abs(points).max(initial=0) < 2**15 else points
        return {"n": len(ids), "ids": _zip(ids.astype("<i8")), "missing": _zip(missing.astype(bool)), "points": _zip(kept.ravel()), "kind": kept.dtype.str, "own": _zip(np.zeros(len(ids), "<i4"))}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def _blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows of vec_id and v as blocks, all in cluster 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                ids, values = part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                yield _batch([_Block.row(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), values.astype(np.float64))])

    return vectors.mapInArrow(run, _STATE)


def _round(state: DataFrame, centroids: Centroids, dim: int) -> DataFrame:
    """The blocks with their points' nearest centroids, and each task's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.values)
        total, far, members = np.zeros((k, dim), dtype=object), [0] * k, [0] * k
        for b in batches:
            for row in b.to_pylist():
                block = _Block(row, dim)
                own, distance, _ = settle(block.points, block.own, centroids)
                for i in np.unique(own):
                    mine = own == i
                    points = block.points[mine]
                    total[i] += (points if points.dtype == object else points.astype(np.float64) if points.dtype.itemsize < 8 else points.astype(object)).sum(axis=0).astype(object)
                    far[i] += sum(min(_HIGH, int(x)) for x in distance[mine]) if distance.dtype == object else int(distance[mine].astype(np.int64).sum())
                    members[i] += int(mine.sum())
                yield _batch([row | {"own": _zip(own.astype("<i4"))}])
        sums = [{"cluster": i, "component": c, "total": Decimal(int(v))} for i in range(k) if members[i] for c, v in ((DISTANCE, far[i]), (MEMBERS, members[i]), *enumerate(total[i]))]
        if sums:
            yield _batch(sums)

    return state.where("n IS NOT NULL").mapInArrow(run, _STATE)


def _start(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    named = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()
    return [[int(x) for x in whole(np.array([r.v], dtype=np.float64))[0]] for r in rows]


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ball_kmeans(vectors: DataFrame, k: int = CLUSTERS, dim: int = DIM, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = rows.where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    now, before = _start(kept, k, seed), None
    if not now:
        return spark.createDataFrame([], shape)
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/balls-{uuid.uuid4().hex}"
    state = _blocks(kept, dim)
    for r in range(rounds + 1):
        _round(state, Centroids(now, before), dim).write.parquet(f"{base}/{r}")
        if r:
            _drop(spark, f"{base}/{r - 1}")
        state = spark.read.schema(_STATE).parquet(f"{base}/{r}")
        found = {(s.cluster, s.component): int(s.total) for s in state.where("cluster IS NOT NULL").groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()}
        before, at = now, now
        now = [[found[i, c] // found[i, MEMBERS] for c in range(dim)] if (i, MEMBERS) in found else old for i, old in enumerate(before)]
        if now == before:
            break
    inertia = [min(_HIGH, found.get((i, DISTANCE), 0)) for i in range(len(at))]
    every, digests = min(_HIGH, sum(found.get((i, DISTANCE), 0) for i in range(len(at)))), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = _Block(row, dim)
                points, centroids = comparable(block.points, at)
                d = squares(points, centroids[block.own])
                shown = np.array([min(_HIGH, int(x)) for x in d], np.int64) if d.dtype == object else d.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids, mask=block.missing), pa.array(block.own, pa.int32()), pa.array(shown), pa.array(np.array(inertia)[block.own]), pa.array(np.full(len(d), every)), pa.array([digests[i] for i in block.own])],
                    names=[x.split()[0] for x in shape.split(", ")],
                )

    return state.where("n IS NOT NULL").select(*_NAMES[:6]).mapInArrow(result, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(table(spark, sf_dir, "embeddings"))


def oracle(k: int = CLUSTERS, dim: int = DIM, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The rounds one after another, every vector compared with every centroid."""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT rn - 1 AS cluster, e AS c FROM (SELECT e, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, e) AS rn FROM v) WHERE rn <= {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT row_id, vec_id, e, cluster, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, cluster) AS rn FROM (
    SELECT row_id, vec_id, e, cluster, list_sum(list_transform(range(1, {dim + 1}), lambda i: (e[i] - c[i]) * (e[i] - c[i])))::BIGINT AS distance FROM v CROSS JOIN c{r})) WHERE rn = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
    SELECT cluster, i, sum(e[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY cluster, i) GROUP BY cluster) n USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE_SQL = oracle()
