"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded by fixed text statistics and a trained layer; gated attention,
learned from document labels alone, weighs the passages, and a logistic unit scores the weighted sum. The model is
trained in numpy on at most ``max_train_docs`` labelled rows, taken in order of a hash, with all passages of each, however long: the driver holds
60 bytes a passage of these. No feature looks beyond its passage. Scoring reads every passage of every text.

Empty and null texts are one passage without words and get a score. Rows of ``labels`` whose label is null are not used;
without usable labels of both classes every score is the share of label 1 (0.5 without labels). Repeated rows score alike; input columns named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.llm.session import cut, table, without
from clausework.llm.words import documents, mix

QUERY = "op8_quality_classifier"
ORACLE_SQL = None
PASSAGE_WORDS = 64
MAX_TRAIN_DOCS = 6000
HELD_OUT_MOD = 5
THRESHOLD = 0.3
HIDDEN, ATTENTION, LEAST_STEPS = 16, 8, 900
_CLASS = np.zeros((256, 7), dtype=np.float32)
for _k, _chars in enumerate((b"#*$%&|<>@^~_=+{}[]\\/", b".", b",", b"!?", b"0123456789")):
    _CLASS[list(_chars), _k] = 1
_CLASS[65:91, 5] = 1
_CLASS[97:123, 6] = 1
_CLASS[128:, 6] = 0.5
N_FEATURES = 7 + 8


def passage_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of documents: their rows, the first passage of each, and a row of features for each passage."""
    for d in documents(column):
        n = d.n_words
        passages = np.maximum(1, -(-n // PASSAGE_WORDS))
        first = np.concatenate([[0], np.cumsum(passages)])
        x = np.zeros((int(first[-1]), N_FEATURES), dtype=np.float32)
        if len(d.start):
            place = np.arange(len(d.start)) - np.repeat(d.first[:-1], n)
            of = np.repeat(first[:-1], n) + place // PASSAGE_WORDS
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            at = of[begins]
            size = np.diff(np.append(begins, len(of))).astype(np.float32)
            lengths = (d.end - d.start).astype(np.float32)
            lo = int(d.start[0])
            part = d.data[lo : int(d.end[-1])]
            ink_at = d.start - lo
            chars = np.add.reduceat(lengths, begins)
            for k in range(7):
                run = np.concatenate([[0], np.cumsum(_CLASS[part, k], dtype=np.float64)])
                x[at, k] = np.add.reduceat(run[d.end - lo] - run[ink_at], begins) / chars
            x[at, 7] = np.log1p(size) / 4
            x[at, 8] = chars / size / 10
            x[at, 9] = np.sqrt(np.maximum(0, np.add.reduceat(lengths**2, begins) / size - (chars / size) ** 2)) / 10
            pair = np.zeros(len(of), dtype=bool)
            pair[1:] = (d.hashes[1:] == d.hashes[:-1]) & (of[1:] == of[:-1])
            x[at, 10] = np.add.reduceat(pair.astype(np.float32), begins) / size
            x[at, 11] = _repeated(d.hashes, of, len(x))[at] / size
            tri = d.hashes.copy()
            if len(tri) > 2:
                inside = of[2:] == of[:-2]
                tri[:-2][inside] = mix(d.hashes[:-2] * np.uint64(3) + d.hashes[1:-1] * np.uint64(5) + d.hashes[2:] * np.uint64(7))[inside]
            x[at, 12] = _repeated(tri, of, len(x))[at] / size
            last = part[d.end - lo - 1]
            marked = np.isin(last, np.frombuffer(b"!#*$%&|", np.uint8))
            x[at, 13] = np.add.reduceat(marked.astype(np.float32), begins) / size
            x[at, 14] = np.add.reduceat((lengths == 1).astype(np.float32), begins) / size
        yield d.rows, first, x


def _repeated(h: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """For each group, how many items are equal to another one of the group."""
    key = mix(h ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    s = key[order]
    same = np.zeros(len(s), dtype=bool)
    eq = s[1:] == s[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    return np.bincount(group[order[same]], minlength=n).astype(np.float32)


class AttentionModel:
    """Passage layer, gated attention and logistic unit, trained by Adam on document labels."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        s = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        self.p = {"W": s(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": s(HIDDEN, ATTENTION), "U": s(HIDDEN, ATTENTION), "a": s(ATTENTION), "o": s(HIDDEN), "c": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["a"]
        begins, n = first[:-1], np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begins), n))
        w = e / np.repeat(np.add.reduceat(e, begins), n)
        z = np.add.reduceat(h * w[:, None], begins, axis=0)
        return h, v, u, w, z, 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self._forward((x - self.mean) / self.scale, first)[-1]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, rate: float = 0.01, batch: int = 128, seed: int = 11) -> AttentionModel:
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        n = sum(map(len, bags))
        self.mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / n
        self.scale = np.sqrt(sum(((b - self.mean) ** 2).sum(axis=0) for b in bags) / n) + 1e-3
        bags = [((b - self.mean) / self.scale).astype(np.float32) for b in bags]
        r, step = np.random.default_rng(seed), 0
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(bags) // batch)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                n = np.array([len(bags[i]) for i in own])
                grad = self._gradient(np.concatenate([bags[i] for i in own]).astype(np.float64), np.concatenate([[0], np.cumsum(n)]), y[own])
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(first)
        h, v, u, w, z, out = self._forward(x, first)
        d = (out - y) / len(y)
        dz = np.repeat(d[:, None] * p["o"], n, axis=0)
        dw = (dz * h).sum(axis=1)
        de = w * (dw - np.repeat(np.add.reduceat(w * dw, first[:-1]), n))
        dv, du = de[:, None] * p["a"] * u * (1 - v * v), de[:, None] * p["a"] * v * u * (1 - u)
        dh = (dz * w[:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh + 1e-4 * p["W"], "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ de, "o": z.T @ d + 1e-4 * p["o"], "c": np.array([d.sum()])}


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % HELD_OUT_MOD == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, text: str = "text", label: str = "quality") -> AttentionModel:
    """Fit on labelled rows outside the held-out fold; labels of one id that disagree count as 1."""
    rows = labels.where(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    joined = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(rows), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, y = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("y").to_numpy(zero_copy_only=False)
            for own, first, x in passage_features(b.column("text")):
                bags = [x[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(y[own]), pa.array(bags, pa.binary())], names=["doc_id", "y", "x"])

    found = cut(joined.mapInArrow(run, "doc_id long, y double, x binary").withColumn("h", F.xxhash64("doc_id", "x")))
    ends = found.select("h", "doc_id").distinct().orderBy("h", "doc_id").limit(max_train_docs)
    got = found.join(F.broadcast(ends), ["h", "doc_id"]).dropDuplicates(["h", "doc_id"]).select("doc_id", "y", "x").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    return AttentionModel().fit([np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in got], np.array([r.y for r in got]))


def score(docs: DataFrame, model: AttentionModel, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the model's score in place of the column of that name."""
    kept = without(docs, column)
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for own, first, x in passage_features(b.column(text)):
                out[own] = model.score(x.astype(np.float64), first)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, column])

    return kept.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
