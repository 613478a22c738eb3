"""Exact cosine joins and leader clustering of vectors, by cells of pivots.

Two unit vectors reach a cosine of t where their distance is at most r = sqrt(2 - 2 t). A sample of the rows, chosen by hash and of bounded size, gives
the pivots of each kind; a row's home is the cell of its nearest pivot. A row y of cell q can reach a row of cell p only if y lies within r of the half
space that is nearer to p, (|y p|^2 - |y q|^2) / (2 |p q|) <= r, so it is sent to those cells and no others. The number of pivots is the one
with the least work by the sample. Where a threshold is so low that every row reaches every cell, one cell is left and all rows of the kind meet, in tiles.

No task holds more than ``GROUP`` rows of a side: larger cells are cut into tiles, or taken in order of arrival.

Only rows of one kind and of equal length are compared. Vectors that are null, empty, without length or with null or non-finite components are like
none. A cosine within 1e-9 of the threshold is taken again in the order in which ``scores.cosine`` adds it up, so it counts as there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.plans.lineage import cut

GROUP = 4096
SAMPLE = 2048
_EPS = 1e-9
_LAST = 2**63 - 1
_ROW = "uid long, kind string, ord long, id string, v array<double>, t double"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def usable(v: Column) -> Column:
    """Whether a vector has a direction."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)


def _matrix(t: pa.Table | pa.RecordBatch, column: str = "v") -> np.ndarray:
    c = t.column(column)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])


class _Side:
    """Vectors with their lengths, compared with one or all vectors of another side."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.norm = raw, _norms(raw)
        self.unit = raw / self.norm[:, None]

    def cosines(self, rows: np.ndarray, other: _Side, cols: np.ndarray) -> np.ndarray:
        """Cosines of rows with cols, one by one, added up in order."""
        return np.add.accumulate(self.raw[rows] * other.raw[cols], axis=1)[:, -1] / (self.norm[rows] * other.norm[cols])

    def near(self, i: int, later: np.ndarray, t: float) -> np.ndarray:
        """Those of ``later`` that reach the threshold with row i."""
        s = self.unit[later] @ self.unit[i]
        hit = s >= t - _EPS
        edge = np.flatnonzero(hit & (s < t + _EPS))
        hit[edge] = self.cosines(later[edge], self, np.full(len(edge), i)) >= t
        return later[hit]

    def pairs(self, other: _Side, t: float, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, rows of ``other`` and cosines that reach the threshold."""
        for lo in range(0, len(self.raw), step):
            a, b = np.nonzero(self.unit[lo : lo + step] @ other.unit.T >= t - _EPS)
            a = a + lo
            c = self.cosines(a, other, b)
            yield a[c >= t], b[c >= t], c[c >= t]


class Cells:
    """Pivots of the kinds that have more than one cell."""

    def __init__(self, pivots: dict[str, np.ndarray]):
        self.pivots = pivots
        self.gaps = {k: np.sqrt(np.maximum(0, 2 - 2 * p @ p.T)) for k, p in pivots.items()}

    def places(self, kind: str, unit: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of every row, and a mark for each cell that the row is sent to."""
        if kind not in self.pivots:
            return np.zeros(len(unit), np.int64), np.ones((len(unit), 1), bool)
        far = 2 - 2 * unit @ self.pivots[kind].T
        home = far.argmin(axis=1)
        gap = self.gaps[kind][home]
        beyond = (far - far[np.arange(len(unit)), home][:, None]) / np.where(gap > 0, 2 * gap, 1)
        sent = (beyond <= np.sqrt(max(0.0, 2 - 2 * t)) + 1e-7) | (gap < 1e-3)  # pivots that near have no exact plane between them
        return home, sent


def choose_cells(rows: DataFrame, group: int = GROUP, sample: int = SAMPLE) -> Cells:
    """Pivots for kinds of more than ``group`` rows, as many as take the least work on the sample."""
    sizes = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).where(F.col("n") > group).orderBy(F.desc("n")).limit(sample).collect()}
    if not sizes:
        return Cells({})
    taken = rows.where(F.col("kind").isin(list(sizes))).orderBy(F.xxhash64("uid"), "uid").limit(sample).select("kind", "v", "t").collect()
    pivots = {}
    for kind, n in sizes.items():
        own = [r for r in taken if r.kind == kind]
        if len(own) < 2:
            continue
        unit, t = _Side(np.array([r.v for r in own])).unit, own[0].t
        unit = unit[np.sort(np.unique(np.round(unit, 9), axis=0, return_index=True)[1])]
        best = (float(n) * n, 1)
        p = 2
        while p <= len(unit):
            sent = Cells({kind: unit[:p]}).places(kind, unit, t)[1].sum(axis=1).mean()
            best = min(best, (float(n) * p + (sent * n) ** 2 / p, p))
            p *= 2
        if best[1] > 1:
            pivots[kind] = unit[: best[1]]
    return Cells(pivots)


def routed(rows: DataFrame, cells: Cells, half: bool = False) -> DataFrame:
    """``rows`` once for each cell they are sent to, with ``cell`` and ``home``; ``half`` sends a row only to cells before its own."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                kinds = np.array(part.column("kind").to_pylist(), dtype=object)
                for kind in dict.fromkeys(kinds):
                    own = part.filter(pa.array(kinds == kind))
                    home, to = sent.value.places(kind, _Side(_matrix(own)).unit, own.column("t")[0].as_py())
                    if half:
                        to = to & (np.arange(to.shape[1])[None] <= home[:, None])
                    to[np.arange(len(home)), home] = True
                    row, cell = np.nonzero(to)
                    out = own.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell), pa.array(home[row] == cell)], names=[*_NAMES, "cell", "home"])

    return rows.select(*_NAMES).mapInArrow(run, f"{_ROW}, cell long, home boolean")


def _rows(vectors: DataFrame, kind: Column, threshold: Column, id_col: str, vector: str, order: Column) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    d = vectors.select(kind.cast("string").alias("__kind"), order.cast("long").alias("ord"), F.col(id_col).cast("string").alias("id"), v.alias("v"), threshold.cast("double").alias("t")).where(usable(F.col("v")))
    d = d.withColumn("kind", F.concat_ws("/", F.size("v").cast("string"), F.coalesce(F.concat(F.lit("k"), "__kind"), F.lit("none"))))
    return d.withColumn("uid", F.monotonically_increasing_id()).select(*_NAMES)


def _tiled(left: DataFrame, right: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by kind and cell in blocks (i, j) of about ``group`` rows, each row of a side beside each block of the other."""
    def blocks(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("kind", "cell").agg(F.ceil(F.count("*") / group).cast("int").alias(name))

    size = blocks(left, "ni").join(blocks(right, "nj"), ["kind", "cell"])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    a = left.join(size, ["kind", "cell"]).withColumn("i", own("ni")).withColumn("j", spread("nj")).drop("ni", "nj")
    b = right.join(size, ["kind", "cell"]).withColumn("j", own("nj")).withColumn("i", spread("ni")).drop("ni", "nj")
    return a, b.select([F.col(c).alias(c) for c in b.columns])  # both sides may be parts of one table


def cosine_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", block: str | None = None, vector: str = "embedding", group: int = GROUP, sample: int = SAMPLE) -> DataFrame:
    """id_a < id_b (by number) and the cosine of all pairs within a ``block`` that reach the threshold, which is above 0.

    Rows without an id or a block and pairs of equal ids are left out; of a repeated id each row is compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    kind = F.col(block) if block else F.lit("")
    rows = cut(_rows(vectors.where(F.col(key).isNotNull() & kind.isNotNull()), kind, F.lit(threshold), key, vector, F.col(key)))
    sent = cut(routed(rows, choose_cells(rows, group, sample), half=True))
    a, b = _tiled(sent.where("home"), sent, group)
    names = ["kind", "cell", "i", "j"]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = [], []
        if left.num_rows and right.num_rows:
            x, y, home = left.column("ord").to_numpy(), right.column("ord").to_numpy(), right.column("home").to_numpy()
            for i, j, c in _Side(_matrix(left)).pairs(_Side(_matrix(right)), threshold):
                # a pair within a cell is met from both of its rows
                once = (x[i] < y[j]) | (~home[j] & (x[i] != y[j]))
                ids.append(np.stack([np.minimum(x[i], y[j]), np.maximum(x[i], y[j])])[:, once])
                found.append(c[once])
        both = np.concatenate(ids, axis=1) if ids else np.zeros((2, 0), np.int64)
        return pa.table({"id_a": both[0].astype(np.int64), "id_b": both[1].astype(np.int64), "kind": pa.array([left.column("kind")[0].as_py() if ids else ""] * both.shape[1], pa.string()), "cosine": np.concatenate(found) if found else np.zeros(0)})

    found = a.groupBy(*names).cogroup(b.groupBy(*names)).applyInArrow(one, "id_a long, id_b long, kind string, cosine double")
    if block is None:
        return found.drop("kind")
    return found.select("id_a", "id_b", F.regexp_replace("kind", "^[0-9]+/k", "").cast(vectors.schema[block].dataType).alias(block), "cosine")


def compared_rows(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", group: int = GROUP, sample: int = SAMPLE) -> int:
    """How many pairs of rows ``cosine_pairs`` compares."""
    rows = _rows(vectors, F.lit(""), F.lit(threshold), key, vector, F.col(key))
    size = routed(rows, choose_cells(rows, group, sample), half=True).groupBy("kind", "cell").agg((F.count_if("home") * F.count("*")).alias("n"))
    return int(size.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _settle(side: _Side, home: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of arrival: which are leaders for certain, and of which leader each other row is.

    A row that is not at home here, or has an earlier row whose part is not known, is not decided, nor are later rows near it.
    """
    n = len(home)
    leader, blocked, is_leader = np.full(n, -1), np.zeros(n, bool), np.zeros(n, bool)
    for i in range(n):
        if leader[i] >= 0:
            continue
        later = np.arange(i + 1, n)
        if home[i] and not blocked[i]:
            is_leader[i], leader[i] = True, i
            near = side.near(i, later, t)
            leader[near[leader[near] < 0]] = i
        else:
            blocked[side.near(i, later[leader[later] < 0], t)] = True
    return is_leader, leader


def leader_clusters(entities: DataFrame, kind: Column, threshold: Column, embedding: str = "embedding", group: int = GROUP, sample: int = SAMPLE, most_rounds: int = 10_000) -> DataFrame:
    """id, ord, leader_id: each row that no earlier leader of its kind is near is a leader, and every other one belongs to the first leader near it.

    Leaders are the lexicographically first maximal independent set of the rows in order of ``ord`` (then id): they do not depend on how the work is cut. Kinds
    of up to ``group`` rows are settled in one task. Larger ones go by rounds over their cells: each cell takes its first ``group`` undecided rows, those at
    home and those sent to it, and settles what they decide among themselves; then new leaders claim the rows near them everywhere. The
    first undecided row of all is always settled, so rounds end; a cell of many rows with one leader takes two. Rows without a usable
    vector lead themselves; rows without an id take no part, those without a place in the order come last.
    """
    entities = entities.where(F.col("id").isNotNull())
    bare = entities.select(F.col("id").cast("string").alias("id"), F.coalesce(F.col("ord").cast("long"), F.lit(_LAST)).alias("ord"), F.col(embedding).cast("array<double>").alias("v"))
    alone = bare.where(~F.coalesce(usable(F.col("v")), F.lit(False))).select("id", "ord", F.col("id").alias("leader_id"))
    rows = cut(_rows(entities, kind, threshold, "id", embedding, F.coalesce("ord", F.lit(_LAST))))
    low = rows.where("t IS NULL OR t <= 0 OR t > 1").limit(1).count()
    if low:
        raise ValueError("thresholds must be above 0 and at most 1")
    big = rows.groupBy("kind").agg(F.count("*").alias("n")).where(F.col("n") > group).select("kind")

    def small(part: pa.Table) -> pa.Table:
        part = part.sort_by([("ord", "ascending"), ("id", "ascending"), ("uid", "ascending")])
        _, leader = _settle(_Side(_matrix(part)), np.ones(part.num_rows, bool), part.column("t")[0].as_py())
        return pa.table({"id": part.column("id"), "ord": part.column("ord"), "leader_id": part.column("id").take(pa.array(leader))})

    shape = "id string, ord long, leader_id string"
    settled = rows.join(big, "kind", "left_anti").select(*_NAMES).groupBy("kind").applyInArrow(small, shape)
    large = cut(rows.join(big, "kind", "left_semi").select(*_NAMES))
    if large.isEmpty():
        return settled.unionByName(alone)
    sent = cut(routed(large, choose_cells(large, group, sample)))
    open_rows, leaders = sent, None
    w = Window.partitionBy("kind", "cell").orderBy("ord", F.col("id").asc_nulls_last(), "uid")

    def first(part: pa.Table) -> pa.Table:
        part = part.sort_by("rn")
        sure, _ = _settle(_Side(_matrix(part)), part.column("home").to_numpy(), part.column("t")[0].as_py())
        return pa.table({"uid": part.column("uid").filter(pa.array(sure))})

    def claimed(left: pa.Table, right: pa.Table) -> pa.Table:
        near = []
        if left.num_rows and right.num_rows:
            near = [np.unique(i) for i, _, _ in _Side(_matrix(left)).pairs(_Side(_matrix(right)), left.column("t")[0].as_py())]
        return pa.table({"uid": left.column("uid").to_numpy()[np.concatenate(near)] if near else np.zeros(0, np.int64)})

    def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
        uid, ord_, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        if left.num_rows and right.num_rows:
            right = right.sort_by([("ord", "ascending"), ("id", "ascending"), ("uid", "ascending")])
            for i, j, _ in _Side(_matrix(left)).pairs(_Side(_matrix(right)), left.column("t")[0].as_py()):
                rows_, at = np.unique(i, return_index=True)
                uid.append(left.column("uid").to_numpy()[rows_])
                ord_.append(right.column("ord").to_numpy()[j[at]])
                ids += right.column("id").take(pa.array(j[at])).to_pylist()
        return pa.table({"uid": np.concatenate(uid), "leader_ord": np.concatenate(ord_), "leader_id": pa.array(ids, pa.string())})

    names = ["kind", "cell", "i", "j"]

    def meet(a: DataFrame, b: DataFrame, f, schema: str) -> DataFrame:
        a, b = _tiled(a, b, group)
        return a.groupBy(*names).cogroup(b.groupBy(*names)).applyInArrow(f, schema)

    for _ in range(most_rounds):
        ahead = open_rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= group)
        new = cut(ahead.groupBy("kind", "cell").applyInArrow(first, "uid long").distinct())
        leaders = new if leaders is None else cut(leaders.unionAll(new))
        undecided = cut(open_rows.join(new, "uid", "left_anti"))
        gone = meet(undecided.where("home"), open_rows.join(new, "uid", "left_semi"), claimed, "uid long").distinct()
        open_rows = cut(undecided.join(gone, "uid", "left_anti"))
        if open_rows.isEmpty():
            break
    else:
        raise RuntimeError("leaders did not settle")
    lead = sent.join(leaders, "uid", "left_semi")
    others = sent.where("home").join(leaders, "uid", "left_anti")
    best = meet(others, lead, chosen, "uid long, leader_ord long, leader_id string").groupBy("uid").agg(F.min(F.struct("leader_ord", "leader_id")).alias("b")).select("uid", "b.leader_id")
    own = lead.where("home").select("uid", F.col("id").alias("leader_id"))
    return settled.unionByName(large.join(best.unionAll(own), "uid").select("id", "ord", "leader_id")).unionByName(alone)
