"""Hybrid retrieval: BM25, vectors, rank fusion, and context for answers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import scores, text
from clausework.operators.similarity import usable

K1, B = 1.5, 0.75
MOST_TERMS = 200_000  # query terms that are broadcast, so that other terms are left out before the postings are counted
MOST_QUERIES = 500_000  # queries whose vectors are broadcast
QUERY_BLOCK, ROW_BLOCK = 2048, 8192
SLACK = 1e-9


def bm25(corpus: DataFrame, queries: DataFrame, k: int | None = 16) -> DataFrame:
    """query_id, id, score, rank of the k best (or all) for each query; idf is ln(1 + (N - n + 0.5) / (n + 0.5)).

    Words that no query has go first: by a broadcast of the queries' terms if these are ``MOST_TERMS`` at most, else by a join. The others are dealt
    by document once; counts, scores and each task's best lists need no further shuffle, for terms, with their weights and queries, are broadcast again.
    """
    d = corpus.select("id", text.tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    size = d.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    terms = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    wanted = terms.select("term").distinct()
    few = wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    hinted = F.broadcast if few else (lambda x: x)
    every = d.select("id", "dl", F.explode("t").alias("term")).join(hinted(wanted), "term", "left_semi").repartition("id")
    hits = every.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = df.select("term", idf.alias("idf"), "avgdl").join(terms.groupBy("term").agg(F.collect_list("query_id").alias("asks")), "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(hinted(weighed), "term").select("id", part.alias("part"), F.explode("asks").alias("query_id"))
    s = scored.groupBy("query_id", "id").agg(F.sum("part").alias("score")).where("score > 0").withColumn("score", F.round("score", 9))
    if k is None:
        return s
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 32, skip_empty: bool = True, own: bool = False, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, id, score, rank of the k most similar vectors for each query; its own id only if ``own``.

    Vectors without length are skipped (or score 0), a query without length finds none; null vectors and those with null or non-finite components take no
    part. Only vectors of equal length are compared. Vectors stay where they are read, packed into blocks; the blocks of queries are joined to them, and a
    task passes on its k best of all its blocks for each query. With ``own`` queries of one vector are asked once.
    """
    e = F.col("embedding").cast("array<double>")
    names = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": vectors.schema["id"].dataType.simpleString()}
    asked = queries.where(usable(e)).select("query_id", e.alias("e"))
    told = asked.groupBy("e").agg(F.min("query_id").alias("query_id")) if own else asked
    q = _packed(told, "query_id", query_block).withColumnRenamed("block", "wanted")
    few = F.broadcast if queries.count() <= MOST_QUERIES else (lambda x: x)
    d = _packed(vectors.select("id", e.alias("e")), "id", row_block, skip_empty).join(few(q), "dim").select("block", "wanted")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = d.mapInArrow(_nearest(k, own), f"query_id {names['query_id']}, id {names['id']}, score double")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if own:
        as_one = asked.join(told.withColumnRenamed("query_id", "__one"), "e").select("__one", "query_id")
        best = best.withColumnRenamed("query_id", "__one").join(as_one, "__one")
    return best.select("query_id", "id", "score", "rank")


def _packed(rows: DataFrame, name: str, size: int, skip_empty: bool = True) -> DataFrame:
    """Rows of ``name`` and ``e`` as blocks of ``size`` at most, each of vectors of one length, where they are.

    Vectors that take no part are left out here and not by a filter, which would work out a derived vector anew for each of its conditions.
    """

    def taken(t: pa.Table) -> pa.Table:
        x = pc.list_flatten(t.column("e")).combine_chunks().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        ok = np.isfinite(x).all(axis=1)
        return t.filter(pa.array(ok & ((x != 0).any(axis=1)) if skip_empty else ok))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = defaultdict(list)

        def flush(dim: int) -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held.pop(dim)).combine_chunks()
            for lo in range(0, t.num_rows, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(t.slice(lo, size))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["dim", "block"])

        for b in batches:
            t = pa.Table.from_batches([b])
            dims = pc.list_value_length(t.column("e"))  # null for null, which no length equals
            for dim in pc.unique(dims).drop_null().to_pylist():
                held[dim].append(taken(t.filter(pc.equal(dims, dim))))
                if sum(x.num_rows for x in held[dim]) >= size:
                    yield from flush(dim)
        for dim in list(held):
            yield from flush(dim)

    return rows.select(name, "e").mapInArrow(run, "dim int, block binary")


def _nearest(k: int, own: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best vectors of a task's blocks for each query that meets them; what is below a query's kth score so far goes at once."""

    def opened(block: bytes) -> tuple[pa.Array, np.ndarray]:
        t = pa.ipc.open_stream(block).read_all().combine_chunks()
        return t.column(0).combine_chunks(), _normal(t.column("e").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))

    class Asked:
        """A block of queries with its best so far."""

        def __init__(self, block: bytes):
            self.names, self.unit = opened(block)
            self.floor, self.held, self.n = np.full(len(self.unit), -np.inf), [], 0

        def meet(self, ids: pa.Array, unit: np.ndarray) -> None:
            same = None
            if not own and ids.type.equals(self.names.type):
                codes = pa.chunked_array([self.names, ids]).combine_chunks().dictionary_encode().indices.to_numpy()
                same = codes[: len(self.names)], codes[len(self.names) :]
            for lo in range(0, len(self.unit), 256):
                score = self.unit[lo : lo + 256] @ unit.T
                if same is not None:
                    score[same[0][lo : lo + 256, None] == same[1]] = -np.inf
                least = self.floor[lo : lo + 256]
                if np.isneginf(least).any() and len(unit) >= k:
                    least = np.maximum(least, np.partition(score, len(unit) - k, axis=1)[:, len(unit) - k])
                # scores are rounded before they are compared
                i, j = np.nonzero((score >= least[:, None] - SLACK) & (score > -np.inf))
                self.held.append(pa.table({"q": i + lo, "id": ids.take(pa.array(j)), "score": np.round(score[i, j], 9) + 0.0}))
                self.n += len(i)
            if self.n > 4 * k * len(self.unit):
                self.best()

        def best(self) -> pa.Table:
            t = pa.concat_tables(self.held).combine_chunks().sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
            q = t.column("q").to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q)
            t = t.filter(pa.array(place < k))
            full = place == k - 1
            self.floor[q[full]] = t.column("score").to_numpy()[np.flatnonzero(place[place < k] == k - 1)]
            self.held, self.n = [t], 0
            return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks: dict[bytes, Asked] = {}
        last, rows = None, None
        for b in batches:
            for block, wanted in zip(b.column("block"), b.column("wanted"), strict=True):
                block, wanted = block.as_py(), wanted.as_py()
                if block != last:
                    last, rows = block, opened(block)
                if wanted not in asks:
                    asks[wanted] = Asked(wanted)
                asks[wanted].meet(*rows)
        for a in asks.values():
            t = a.best()
            yield from pa.table({"query_id": a.names.take(t.column("q").combine_chunks()), "id": t.column("id"), "score": t.column("score")}).combine_chunks().to_batches(65536)

    return run


def _normal(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1.0, norm)


def find_similar(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """The k best of all vectors, and of these those that reach the threshold; vectors without length score 0."""
    return vector_topk(vectors, queries, k, skip_empty=False).where(F.col("score") >= threshold)


def search_kind(semantic: DataFrame, keyword: DataFrame, kinds: DataFrame, kind: str | None, limit: int = 10, threshold: float = 0.0, k: int = 16) -> DataFrame:
    """Fused search among items of one kind: the semantic list is cut before its kind is asked for, the keyword list after.

    ``semantic`` holds the 2 k best, ``keyword`` all scored items, ``kinds`` id and kind.
    """
    wanted = kinds if kind is None else kinds.where(F.col("kind") == kind)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def best(d: DataFrame) -> DataFrame:
        return d.drop("rank").join(wanted.select("id"), "id", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    return fuse(best(semantic), best(keyword), limit, threshold)


def fuse(semantic: DataFrame, keyword: DataFrame, limit: int | None = 10, threshold: float = 0.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    a, b = semantic.select("query_id", "id", F.col("rank").alias("ra")), keyword.select("query_id", "id", F.col("rank").alias("rb"))
    d = a.join(b, ["query_id", "id"], "full_outer").withColumn("score", scores.rrf(F.col("ra"), F.col("rb"))).where(F.col("score") >= threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    d = d.withColumn("rank", F.row_number().over(w))
    return (d if limit is None else d.where(F.col("rank") <= limit)).select("query_id", "id", "score", "rank")


def context(fused: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id and the found texts in order, as one string."""
    d = fused.join(texts.select("id", "text"), "id")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("- "), x["text"]))
    return d.groupBy("query_id").agg(F.array_join(lines, "\n").alias("context"))


def grounded_context(entities: DataFrame, triples: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id and the found entities and relationships as one text, each part in order of rank and empty where nothing was found."""
    parts = []
    for name, found in (("e", entities), ("t", triples)):
        said = found.join(texts.select("id", "text"), "id")
        lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("\n  - "), x["text"]))
        parts.append(said.groupBy("query_id").agg(F.array_join(lines, "").alias(name)))
    d = parts[0].join(parts[1], "query_id", "full_outer")
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    return d.select("query_id", F.concat(F.lit("Relevant Entities:"), said("e"), F.lit("\n\nRelevant Relationships:"), said("t")).alias("context"))
