"""Masked pseudo-likelihood of documents under a bidirectional window network with a memory of the corpus.

The probability of a token given its neighbours on both sides has three parts.

* Class: words are mapped to a closed vocabulary, the most frequent words by counts over all documents, then classes of the rest by shape. How
  often each class stands between each pair of neighbours is counted over all documents; on these counts, which are all that the network's loss
  depends on, a network trained in numpy learns to predict every class from those on both sides.
* Word: a word's share of its class, by its count over all documents for the ``MOST_WORDS`` most frequent words, for rarer ones the mean share of what is left.
* Memory: for windows of ``REACH`` words on each side, a table by word identity over the whole corpus of what stands between them. It grows with
  the corpus and stays distributed, and holds every window of every document. A document is judged by
  the other documents' entries alone; with n of them, of d different words, they have the weight n / (n + d), the network has the rest.

A document's score is the sum of the log-probabilities of all its tokens, and that sum per token. Texts that stand in the corpus twice score higher than
others, as they should under a model of the whole corpus.

Null and empty texts have no tokens and score 0. Repeated rows count as often as they occur; rows of equal id and text are one document to
the memory. An empty corpus gives an empty result. Texts of any length are scored whole; columns named like results are replaced, others kept. Counts are exact,
words and windows are told by 64-bit and 32-bit hashes; a blob of windows holds each document's id once, and a task
sends each document one sum of gains; memory weights are summed as integers (2^-16), so that order does not matter. The
tables that reach the driver have at most VOCABULARY^3 and MOST_WORDS rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.llm import blobs
from clausework.llm.session import cut, table, without
from clausework.llm.words import U64, Docs, documents, mix

QUERY = "op4_lm_score"
ORACLE_SQL = None
TOP_WORDS = 79
SHAPES = 16
VOCABULARY = 1 + TOP_WORDS + SHAPES  # 0 marks a document's edge
MOST_WORDS = 1 << 14
REACH = 2
_STEP = U64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, text: str, most: int = TOP_WORDS + MOST_WORDS) -> DataFrame:
    """h, shape, n of each task's ``most`` most frequent words, by counts over all documents; with a null h, the words and different words of each shape.

    Words are dealt out by hash, so a task's counts are the whole corpus', and all words that are among the ``most`` first are there.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = blobs.Sender(buckets)
        for b in batches:
            for d in documents(b.column(0), lower=True):
                h, first, n = np.unique(d.hashes, return_index=True, return_counts=True)
                yield from sender.add(h, shapes(d)[first].astype(np.uint8), n.astype(np.uint32))
        yield from sender.flush()
        blobs.release()

    def start() -> tuple:
        best, total = [np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)], np.zeros((2, SHAPES), np.int64)

        def work(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal best
            begin, _ = blobs.runs(arrays[0])
            found = [arrays[0][begin], arrays[1][begin].astype(np.int64), np.add.reduceat(arrays[2].astype(np.int64), begin)]
            np.add.at(total[0], found[1], found[2])
            total[1] += np.bincount(found[1], minlength=SHAPES)
            best = [np.concatenate(x) for x in zip(best, found, strict=True)]
            first = np.lexsort((best[0].view(np.int64), -best[2]))[:most]
            best = [x[first] for x in best]
            yield from ()

        def end() -> Iterator[pa.RecordBatch]:
            names = ["h", "shape", "n", "types"]
            yield pa.RecordBatch.from_arrays([pa.array(best[0].view(np.int64)), pa.array(best[1], pa.int32()), pa.array(best[2]), pa.nulls(len(best[0]), pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(SHAPES, pa.int64()), pa.array(np.arange(SHAPES), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=names)

        return work, end

    buckets = blobs.buckets_of(docs)
    return blobs.reduce_buckets(docs.select(text).mapInArrow(send, blobs.SCHEMA), ["<u8", "u1", "<u4"], start, "h long, shape int, n long, types long")


def shapes(d: Docs) -> np.ndarray:
    """Classes of words by length and last byte."""
    if not len(d.hashes):
        return np.zeros(0, np.int64)
    length = np.minimum((d.end - d.start - 1) // 3, 7)
    last = d.data[d.end - 1]
    letter = ((last >= 97) & (last < 123)) | (last >= 128)
    return length * 2 + ~letter


class Vocabulary:
    """Token ids of words: known hashes, else a class by shape; and the log-share of each word in its class."""

    def __init__(self, known: np.ndarray, words: np.ndarray | None = None, share: np.ndarray | None = None, rest: np.ndarray | None = None):
        self.sorted = np.sort(known.astype(U64))
        order = np.argsort(words) if words is not None else np.zeros(0, np.int64)
        self.words = words[order] if words is not None else np.zeros(0, U64)
        self.share = share[order] if share is not None else np.zeros(0)
        self.rest = rest if rest is not None else np.zeros(SHAPES)

    def tokens(self, d: Docs) -> np.ndarray:
        shape = 1 + TOP_WORDS + shapes(d)
        if not len(self.sorted) or not len(shape):
            return shape
        at = np.minimum(np.searchsorted(self.sorted, d.hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == d.hashes, 1 + at, shape)

    def shares(self, d: Docs, tokens: np.ndarray) -> np.ndarray:
        """Log-share of each word in its class: 0 for the known words, which are classes of their own."""
        out = np.where(tokens > TOP_WORDS, self.rest[np.maximum(tokens - 1 - TOP_WORDS, 0)], 0.0)
        own = np.flatnonzero(tokens > TOP_WORDS)
        if len(self.words) and len(own):
            at = np.minimum(np.searchsorted(self.words, d.hashes[own]), len(self.words) - 1)
            hit = self.words[at] == d.hashes[own]
            out[own[hit]] = self.share[at[hit]]
        return out

    def triples(self, d: Docs) -> tuple[np.ndarray, np.ndarray]:
        """For each token left, middle and right as one number; and the middle tokens' documents."""
        t = self.tokens(d)
        n = d.n_words
        left, right = np.zeros_like(t), np.zeros_like(t)
        left[1:], right[:-1] = t[:-1], t[1:]
        full = n > 0
        left[d.first[:-1][full]] = 0
        right[d.first[1:][full] - 1] = 0
        return (left * VOCABULARY + t) * VOCABULARY + right, np.repeat(np.arange(len(n)), n)


def triple_counts(docs: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY**3, np.int64)
        for b in batches:
            for d in documents(b.column(0), lower=True):
                k, n = np.unique(vocabulary.triples(d)[0], return_counts=True)
                total[k] += n
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    return docs.select(text).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def train(keys: np.ndarray, counts: np.ndarray, size: int = VOCABULARY, dim: int = 12, hidden: int = 24, epochs: int = 12, rate: float = 0.01, seed: int = 3) -> np.ndarray:
    """Log-probabilities [left, right, middle] of the trained network."""
    r = np.random.default_rng(seed)
    p = {"L": r.standard_normal((size, dim)) * 0.3, "R": r.standard_normal((size, dim)) * 0.3, "W": r.standard_normal((2 * dim, hidden)) / np.sqrt(2 * dim), "b": np.zeros(hidden), "O": r.standard_normal((hidden, size)) * 0.1, "c": np.zeros(size)}
    target = np.zeros((size * size, size))
    left, middle, right = keys // (size * size), keys // size % size, keys % size
    np.add.at(target, (left * size + right, middle), counts)
    seen = target.sum(axis=1)
    contexts = np.flatnonzero(seen)
    if len(contexts):
        p["c"] = np.log(target.sum(axis=0) + 0.5)
        p["c"] -= np.log(np.exp(p["c"]).sum())
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        for own in np.array_split(r.permutation(contexts), max(1, len(contexts) // 256)) if len(contexts) else []:
            a, c = own // size, own % size
            x = np.concatenate([p["L"][a], p["R"][c]], axis=1)
            h = np.tanh(x @ p["W"] + p["b"])
            z = h @ p["O"] + p["c"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            d = (q * seen[own, None] - target[own]) / seen[own].sum()
            dh = d @ p["O"].T * (1 - h * h)
            dx = dh @ p["W"].T
            g = {"O": h.T @ d, "c": d.sum(axis=0), "W": x.T @ dh, "b": dh.sum(axis=0), "L": np.zeros_like(p["L"]), "R": np.zeros_like(p["R"])}
            np.add.at(g["L"], a, dx[:, :dim])
            np.add.at(g["R"], c, dx[:, dim:])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    out = np.empty((size * size, size), np.float32)
    for at in range(0, size * size, 4096):
        own = np.arange(at, min(at + 4096, size * size))
        z = np.tanh(np.concatenate([p["L"][own // size], p["R"][own % size]], axis=1) @ p["W"] + p["b"]) @ p["O"] + p["c"]
        z -= z.max(axis=1, keepdims=True)
        out[own] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out.reshape(size, size, size)


def _by_shape(words: pd.DataFrame) -> np.ndarray:
    shape, n = words["shape"].to_numpy(np.int64), words["n"].to_numpy(np.float64)
    return np.stack([np.bincount(shape, weights=n, minlength=SHAPES), np.bincount(shape, minlength=SHAPES)])


def fit(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and network of a corpus."""
    counts = cut(word_counts(docs, text))
    each = counts.where("h IS NOT NULL")
    have, least = 0, 1
    for r in sorted(each.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("n")).collect(), reverse=True):
        have, least = have + r["n"], 1 << r["bits"] - 1
        if have >= TOP_WORDS + MOST_WORDS:
            break  # so few words are this frequent that tasks need to send no more than about as many as are wanted
    top = each.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(TOP_WORDS + MOST_WORDS).toPandas()
    every = {r["shape"]: (r["n"], r["types"]) for r in counts.where("h IS NULL").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()}
    total = np.array([[every.get(k, (0, 0))[j] for k in range(SHAPES)] for j in range(2)], np.float64)
    first, rest = top.iloc[:TOP_WORDS], top.iloc[TOP_WORDS:]
    total -= _by_shape(first)
    left = total - _by_shape(rest)
    words = rest["h"].to_numpy(np.int64).view(U64)
    share = np.log(rest["n"].to_numpy(np.float64) / total[0][rest["shape"].to_numpy(np.int64)])
    unseen = np.log(np.maximum(left[0], 0.5) / np.maximum(left[1], 1) / np.maximum(total[0], 1))
    vocabulary = Vocabulary(first["h"].to_numpy(np.int64).view(U64), words, share, unseen)
    rows = triple_counts(docs, text, vocabulary).toPandas().sort_values("k")
    return vocabulary, train(rows["k"].to_numpy(np.int64), rows["n"].to_numpy(np.float64))


def windows(d: Docs) -> np.ndarray:
    """A hash of the ``REACH`` words on each side of every word, with its place in the window; a document's edge is a word of its own."""
    n = len(d.hashes)
    of = np.repeat(np.arange(len(d.first) - 1), d.n_words)
    out = np.zeros(n, U64)
    for k in (*range(-REACH, 0), *range(1, REACH + 1)):
        near = np.zeros(n, U64)
        a, z = max(0, -k), min(n, n - k)
        if a < z:
            near[a:z] = np.where(of[a + k : z + k] == of[a:z], d.hashes[a + k : z + k], U64(0))
        out = out * _STEP + mix(near + U64(k + REACH))
    return mix(out)


def remembered(docs: DataFrame, vocabulary: Vocabulary, flat: Broadcast, text: str) -> DataFrame:
    """uid, gain: how much the other documents' windows add to a document's log-probability, in 2^-16."""
    buckets = blobs.buckets_of(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, network = blobs.Sender(buckets, blobs.pack_with_ids), flat.value
        for b in batches:
            uids = b.column("uid").to_numpy(zero_copy_only=False)
            for d in documents(b.column(text), lower=True):
                key, of = vocabulary.triples(d)
                window = windows(d)
                log = network[key] + vocabulary.shares(d, vocabulary.tokens(d))
                yield from sender.add(window, uids[d.rows][of], (d.hashes >> U64(32)).astype(np.uint32), np.minimum(-log * 1024, 65535).astype(np.uint16))
        yield from sender.flush()
        blobs.release()

    def start() -> tuple:
        sender, held = blobs.Sender(buckets), []

        def meet(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            window, uid, word, log = arrays
            many = np.repeat(*(lambda r: (r[1] > 1, r[1]))(blobs.runs(window)))
            window, uid, word, log = window[many], uid[many], word[many], log[many]
            if len(window):
                own, gain = gains(window, uid, word, -log.astype(np.float64) / 1024)
                held.append(sums(uid.view(U64)[own], gain))
            yield from ()

        def end() -> Iterator[pa.RecordBatch]:
            if held:
                yield from sender.add(*sums(*(np.concatenate(x) for x in zip(*held, strict=True))))
            yield from sender.flush()

        return meet, end

    def total() -> tuple:
        def work(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            uid, gain = arrays
            own, gain = sums(uid, gain)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(gain)], names=["uid", "gain"])

        return work, lambda: iter(())

    met = blobs.reduce_buckets(docs.mapInArrow(send, blobs.SCHEMA), ["<u8", "<i8", "<u4", "<u2"], start, blobs.SCHEMA, blobs.unpack_with_ids)
    return blobs.reduce_buckets(met, ["<u8", "<i8"], total, "uid long, gain long")


def sums(uid: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each uid once, with the sum of its gains."""
    order = np.argsort(uid, kind="stable")
    begin, _ = blobs.runs(uid[order])
    return uid[order][begin], np.add.reduceat(gain[order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)


def gains(window: np.ndarray, uid: np.ndarray, word: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose window other documents have, too, and what these add to the entry's log-probability ``log``, in 2^-16."""
    order = np.lexsort((uid, word, window))
    window, uid, word, log = window[order], uid[order], word[order], log[order]

    def size(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry the number of entries that agree with it in ``keys``, which are sorted, and where they begin."""
        new = np.ones(len(window), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(new)))
        return np.repeat(n, n), np.repeat(begin, n)

    in_window, at_window = size(window)
    in_word, at_word = size(window, word)
    mine_word, _ = size(window, word, uid)
    by_document = np.lexsort((uid, at_window))
    mine_window = np.empty(len(window), np.int64)
    same = np.ones(len(window), bool)
    same[1:] = (uid[by_document][1:] != uid[by_document][:-1]) | (at_window[by_document][1:] != at_window[by_document][:-1])
    begin = np.flatnonzero(same)
    n = np.diff(np.append(begin, len(same)))
    mine_window[by_document] = np.repeat(n, n)
    # different words of the window, and those that only this document has there
    first = np.zeros(len(window), bool)
    first[at_word] = True
    words = np.add.reduceat(first.astype(np.int64), np.unique(at_window)) if len(window) else np.zeros(0, np.int64)
    words = np.repeat(words, np.diff(np.append(np.unique(at_window), len(window))))
    alone = (in_word == mine_word) & first
    number = np.cumsum(same) - 1
    only = np.empty(len(window), np.int64)
    only[by_document] = np.bincount(number, weights=alone[by_document], minlength=len(begin)).astype(np.int64)[number]
    others, kinds = in_window - mine_window, words - only
    own = np.flatnonzero(others > 0)
    weight = others[own] / (others[own] + kinds[own])
    new = np.log(weight * (in_word - mine_word)[own] / others[own] + (1 - weight) * np.exp(log[own]))
    return order[own], np.round((new - log[own]) * 65536).astype(np.int32)


def score(docs: DataFrame, vocabulary: Vocabulary, network: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``pseudo_loglik`` and ``mean_loglik``; the memory is that of ``docs``."""
    kept = without(docs, *{"n_tokens", "pseudo_loglik", "mean_loglik"} - {text})
    names = [c for c in kept.columns if c != text]
    own = "uid"
    while own in names or own == text:
        own += "_"
    schema = T.StructType([kept.schema[c] for c in names] + [T.StructField(own, T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("pseudo_loglik", T.DoubleType())])
    flat = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(network.transpose(0, 2, 1)).reshape(-1))  # 3.5 MB at any size of the corpus
    ids = [F.col("doc_id").cast("string")] if "doc_id" in kept.columns else []
    kept = kept.withColumn(own, F.xxhash64(*ids, F.coalesce(F.col(text), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = flat.value
        for b in batches:
            total, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for d in documents(b.column(text), lower=True):
                key, of = vocabulary.triples(d)
                n[d.rows] = d.n_words
                total[d.rows] = np.bincount(of, weights=table_[key] + vocabulary.shares(d, vocabulary.tokens(d)), minlength=len(d.rows))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in [*names, own]] + [pa.array(n), pa.array(total)], names=[*names, own, "n_tokens", "pseudo_loglik"])

    gain = remembered(kept.select(F.col(own).alias("uid"), text), vocabulary, flat, text)
    scored = kept.mapInArrow(run, schema).join(gain.withColumnRenamed("uid", own), own, "left")
    out = scored.withColumn("pseudo_loglik", F.col("pseudo_loglik") + F.coalesce(F.col("gain"), F.lit(0)) / F.count("*").over(Window.partitionBy(own)) / F.lit(65536.0))
    return out.select(*names, "n_tokens", "pseudo_loglik", (F.col("pseudo_loglik") / F.greatest(F.col("n_tokens"), F.lit(1))).alias("mean_loglik"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, *fit(docs))
