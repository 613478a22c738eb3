"""Alignment of two tokenizers over the same bytes, by a dangling-suffix transducer.

The transducer reads the tokens of both sides over a text's bytes. Its state is the side that leads and that side's unmatched bytes; the other
side's next token either falls short of them, meets their end, or runs past it and leads from there on. Transitions are memoised by state and token;
above them a tree of the groups met so far, by the tokens read in turn, gives a known group's number at its last token.
Each token read with bytes unmatched is a link between the leader's last token and itself; an empty residual closes a group.
Bytes that differ end the walk: the text has no tokens.

Texts are cut at places where neither tokenizer's tokens can span (a letter, then white space that no piece of B joins to it), where every group
closes, too; the groups of a short segment are kept by its text, so that common words are encoded and walked once a worker.

One pass encodes and walks all texts and writes each one's numbers and id pairs, with how often it holds each, as compressed blobs to the shared
folder. Counts of id pairs over the corpus are summed from these, first in each task. The ``hot`` most frequent pairs, at most that many rows,
go to all tasks, which sum them for each text; the links of all other pairs, at most a ``hot``-th of all links each, are joined with the counts
by a shuffle. So no id pair, however common, meets in one task.

Null and empty texts have no tokens, nor have texts whose tokens' bytes differ from a space and the text (those with U+2581, which
sentencepiece reads as a space). Rows without an id and repeated rows are counted as they come; the links of each count. Other columns are not
read, whatever their names. A text's segments are held whole in a task, as its row is. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import blobs, packing, token_counts
from clausework.llm.session import cut, table
from clausework.llm.token_counts import SPACE, WHITE

QUERY = "op12_token_alignment"
ORACLE_SQL = None
HOT = 1 << 17
KEPT_SEGMENTS, KEPT_GROUPS = 100_000, 200_000
SHORT = 48  # characters of a segment that is kept
DEEP = 16  # tokens of a group that the tree of groups holds
MEMO = 1 << 18
GROUP_CHARS = 1 << 20
BLOB_ENTRIES = 1 << 19
_FIELDS = ("n_a", "n_b", "n_groups", "n_links")
_KINDS = ["<i8", "<i8", "<i4"]  # a blob's columns: uid, pair, times


class Transducer:
    """Walks two token sequences over the same bytes; ``a_bytes`` and ``b_bytes`` give a token's bytes by id. Groups have numbers."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.clear()

    def clear(self) -> None:
        self.moves: dict[tuple[int, bytes, int], tuple[int, bytes] | None] = {}
        self.tree = _Node(1, b"", None, ())
        self.texts: list[bytes] = []
        self.links: list[list[int]] = []
        self.sizes = array("q")  # of A's tokens, then of B's

    def _move(self, lead: int, rest: bytes, token: int) -> tuple[int, bytes] | None:
        """The side that leads after the other one's token, and its unmatched bytes; None where bytes differ."""
        key = (lead, rest, token)
        if key not in self.moves:
            if len(self.moves) > MEMO:
                self.moves.clear()
            read = self.bytes[1 - lead][token]
            to = (lead, rest[len(read) :]) if rest.startswith(read) else (1 - lead, read[len(rest) :]) if read.startswith(rest) else None
            self.moves[key] = to
        return self.moves[key]

    def _group(self, read: list[tuple[int, int]]) -> int:
        """A number for the group of these (side, token), in the order in which they were read."""
        last, links = [0, 0], []
        for k, (side, token) in enumerate(read):
            last[side] = token
            if k:
                links.append(last[1] << 32 | last[0])
        sides = [[str(t) for s, t in read if s == side] for side in (0, 1)]
        self.texts.append("|".join(map(",".join, sides)).encode())
        self.links.append(links)
        self.sizes.extend(map(len, sides))
        return len(self.texts) - 1

    def walk(self, a: list[int], b: list[int]) -> list[int] | None:
        """The numbers of the groups, or None where bytes differ."""
        tree, out, i, j = self.tree, [], 0, 0
        try:
            while i < len(a):
                node = tree.get(a[i])
                if node is None:
                    node = self._grow(tree, a[i])
                i += 1
                while True:
                    if node.lead:
                        token = a[i]
                        i += 1
                    else:
                        token = b[j]
                        j += 1
                    to = node.get(token)
                    if to is None:
                        to = self._grow(node, token)
                        if to is None:
                            return None
                        if to is _FAR:
                            number, i, j = self._far(node, token, a, b, i, j)
                            if number < 0:
                                return None
                            out.append(number)
                            break
                    if type(to) is int:
                        out.append(to)
                        break
                    node = to
        except IndexError:
            return None
        return out if j == len(b) else None

    def _grow(self, node: _Node, token: int) -> _Node | int | object | None:
        """The node after a token, or its group's number where it closes one; _FAR where the tree ends."""
        to = self._move(node.lead, node.rest, token)
        if to is None:
            return None
        read = (*node.read, (1 - node.lead, token))
        if not to[1]:
            node[token] = self._group(read)
        elif len(read) > DEEP:
            return _FAR
        else:
            node[token] = _Node(*to, node, read)
        return node[token]

    def _far(self, node: _Node, token: int, a: list[int], b: list[int], i: int, j: int) -> tuple[int, int, int]:
        """A group longer than the tree is deep: its number (below 0 where bytes differ), and where both sides go on."""
        read, (lead, rest) = [*node.read], (node.lead, node.rest)
        while True:
            read.append((1 - lead, token))
            to = self._move(lead, rest, token)
            if to is None:
                return -1, i, j
            lead, rest = to
            if not rest:
                return self._group(read), i, j
            if lead:
                token, i = a[i], i + 1
            else:
                token, j = b[j], j + 1


class _Node(dict):
    """Next nodes by token, with the side that leads, its unmatched bytes, and what has been read of the group."""

    __slots__ = ("lead", "read", "rest")

    def __init__(self, lead: int, rest: bytes, parent: _Node | None, read: tuple[tuple[int, int], ...]):
        super().__init__()
        self.lead, self.rest, self.read = lead, rest, read


_FAR = object()


class Segments:
    """Groups of segments, by a segment's text if it is short."""

    def __init__(self, a_path: str, b_path: str):
        self.bpe = packing.encoder(a_path).bpe
        pieces = token_counts.tokenizer(b_path)
        if not isinstance(pieces, token_counts.Pieces) or not pieces.plain:
            raise ValueError("the second tokenizer must be a sentencepiece model that keeps texts as they are")
        self.pieces = pieces.rest
        white = re.compile(f"[{WHITE}{SPACE}]")
        joined = {p[1] for p in pieces.inside if not white.match(p[0])}
        starts = "".join(c for c in map(chr, range(0x3001)) if white.match(c) and (SPACE if c == " " else c) not in joined | {SPACE})
        self.split = re.compile(f"(?<=[^{WHITE}])(?=[{re.escape(starts)}])").split
        self.transducer = Transducer(_a_bytes(a_path), _b_bytes(pieces.first))
        self.kept: dict[str, list[int] | None] = {}

    def tidy(self) -> None:
        """Forget all, groups and their numbers too, if it has grown large."""
        if len(self.kept) > KEPT_SEGMENTS or len(self.transducer.texts) > KEPT_GROUPS:
            self.kept.clear()
            self.transducer.clear()

    def groups(self, texts: list[str | None]) -> list[list[int] | None]:
        """The numbers of each text's groups; None for a text whose bytes differ."""
        cut_up = [self.split(" " + t) if t and SPACE not in t else [] for t in texts]
        new = list({x for part in cut_up for x in part} - self.kept.keys())
        encode, walk = self.bpe.encode_ordinary, self.transducer.walk
        now = {x: walk(encode(x), b) for x, b in zip(new, self.pieces.encode(new, num_threads=1), strict=True)}
        self.kept.update((x, g) for x, g in now.items() if len(x) <= SHORT)
        now = _Both(now, self.kept)
        out = []
        for part in cut_up:
            found = list(map(now.__getitem__, part))
            out.append(None if None in found else list(chain.from_iterable(found)))
        return out


class _Both(dict):
    def __init__(self, first: dict, second: dict):
        super().__init__(first)
        self.second = second

    def __missing__(self, key: str) -> list[int] | None:
        return self.second[key]


def _a_bytes(path: str) -> list[bytes]:
    letters = packing._byte_letters()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for word, i in vocab.items():
        out[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
    return out


def _b_bytes(model) -> list[bytes]:
    named = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(named)]


_OPEN: dict[tuple[str, str], Segments] = {}


def segments(a_path: str, b_path: str) -> Segments:
    if (a_path, b_path) not in _OPEN:
        _OPEN[a_path, b_path] = Segments(a_path, b_path)
    return _OPEN[a_path, b_path]


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows in groups of about GROUP_CHARS characters, one row at least."""
    for b in batches:
        held, size, begin = [], 0, 0
        for i, value in enumerate(b.column("text")):
            text = value.as_py()
            held.append(text)
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield b.slice(begin, len(held)), held
                held, size, begin = [], 0, i + 1
        if held:
            yield b.slice(begin, len(held)), held


def walked(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each text's numbers as a row, and blobs of (uid, pair, times): a pair has B's id in the high 32 bits, A's in the low ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = segments(a_path, b_path)
        walk = known.transducer
        for b, held in _in_groups(batches):
            known.tidy()
            uid = b.column("uid").to_numpy()
            groups = known.groups(held)
            sums, digests = np.zeros((4, len(held)), np.int64), []
            flat = np.fromiter(chain.from_iterable(g or () for g in groups), np.int64)
            n = np.array([len(g or ()) for g in groups], np.int64)
            sizes, links = np.array(walk.sizes, np.int64).reshape(-1, 2), np.array([len(x) for x in walk.links], np.int64)
            row = np.repeat(np.arange(len(held)), n)
            sums[2] = n
            for k, of in ((0, sizes[:, 0]), (1, sizes[:, 1]), (3, links)):
                sums[k] = np.bincount(row, weights=of[flat], minlength=len(held)).astype(np.int64)
            for g in groups:
                digests.append(hashlib.sha256(b";".join(map(walk.texts.__getitem__, g))).hexdigest() if g else "")
            pair = np.fromiter(chain.from_iterable(map(walk.links.__getitem__, flat.tolist())), np.int64, int(sums[3].sum()))
            owner = np.repeat(row, links[flat])
            order = np.lexsort((pair, owner))
            owner, pair = owner[order], pair[order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])])[: len(owner)])
            times = np.diff(np.append(new, len(owner))).astype(np.int32)
            made = [(uid[owner[new]][lo : lo + BLOB_ENTRIES], pair[new][lo : lo + BLOB_ENTRIES], times[lo : lo + BLOB_ENTRIES]) for lo in range(0, len(new), BLOB_ENTRIES)]
            none = pa.nulls(len(held), pa.int32()), pa.nulls(len(held), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(uid), b.column("doc_id"), *(pa.array(x) for x in sums), pa.array(digests, pa.string()), *none], names=names)
            for x in made:
                empty = [pa.nulls(1, pa.int64())] * 6
                yield pa.RecordBatch.from_arrays([*empty, pa.nulls(1, pa.string()), pa.array([len(x[0])], pa.int32()), pa.array([blobs.pack(list(x))], pa.binary())], names=names)
        blobs.release()

    names = ["uid", "doc_id", *_FIELDS, "groups_sha256", "n", "payload"]
    kinds = f"uid long, doc_id long, {', '.join(f'{c} long' for c in _FIELDS)}, groups_sha256 string, n int, payload binary"
    return rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "text").mapInArrow(run, kinds)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for b in batches:
        for n, payload in zip(b.column("n").to_pylist(), b.column("payload"), strict=True):
            yield blobs.unpack(payload.as_py(), n, _KINDS)


def _grouped(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Keys once each, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    begin, _ = blobs.runs(key[order])
    return [key[order][begin], *(np.add.reduceat(v[order], begin) if len(begin) else v[:0] for v in values)]


def pair_counts(payloads: DataFrame) -> DataFrame:
    """pair and n: how many links of all texts hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            parts = [(pair, n), *waiting]
            return tuple(_grouped(*(np.concatenate(x) for x in zip(*parts, strict=True))))

        for _, p, times in _entries(batches):
            waiting.append(_grouped(p, times.astype(np.int64)))
            size += len(waiting[-1][0])
            if size > max(len(pair), BLOB_ENTRIES):
                pair, n = merge()
                waiting, size = [], 0
        pair, n = merge()
        for lo in range(0, len(pair), BLOB_ENTRIES):
            yield pa.RecordBatch.from_arrays([pa.array(pair[lo : lo + BLOB_ENTRIES]), pa.array(n[lo : lo + BLOB_ENTRIES])], names=["pair", "n"])

    return payloads.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot: int = HOT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    a_path, b_path = a_path or packing.default_tokenizer(), b_path or token_counts.default_model()
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    stored = cut(walked(rows, a_path, b_path))
    payloads = stored.where("payload IS NOT NULL").select("n", "payload")
    counts = cut(pair_counts(payloads))
    most = counts.groupBy(F.shiftright("pair", 32).alias("b")).agg(F.max("n").alias("most"))  # one row for each of B's ids
    counts = counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    frequent = counts.orderBy(F.desc("n")).limit(hot).orderBy("pair").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(tuple(frequent.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the frequent pairs by uid, and a row for each other pair."""
        hot_pair, hot_n, hot_best = (np.append(x, e) for x, e in zip(sent.value, (-1, 0, 0), strict=True))
        for uid, pair, times in _entries(batches):
            at = np.searchsorted(hot_pair[:-1], pair)
            known = hot_pair[at] == pair
            own = times[known].astype(np.int64)
            who, best, total = _grouped(uid[known], own * hot_best[at[known]], own * hot_n[at[known]])
            rare = np.flatnonzero(~known)
            zero = np.zeros(len(rare), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(who, uid[rare])), pa.array(np.append(best, zero)), pa.array(np.append(total, zero)), pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(pair[rare])]), pa.array(np.append(np.zeros(len(who), np.int64), times[rare].astype(np.int64)))], names=["uid", "n_best", "count_sum", "pair", "times"])

    found = payloads.mapInArrow(run, "uid long, n_best long, count_sum long, pair long, times long")
    sums = found.select("uid", "n_best", "count_sum")
    if frequent.num_rows == hot:  # there may be others
        sums = found.where("pair IS NULL").select("uid", "n_best", "count_sum")
        other = found.where("pair IS NOT NULL").select("uid", "pair", "times").join(counts.withColumnRenamed("best", "is_best"), "pair")
        sums = sums.unionAll(other.select("uid", (F.col("times") * F.col("is_best")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")))
    every = stored.where("payload IS NULL")
    zero = F.lit(0).cast("long")
    both = every.select("uid", "doc_id", *_FIELDS, "groups_sha256", zero.alias("n_best"), zero.alias("count_sum"))
    both = both.unionByName(sums, allowMissingColumns=True)
    total = [F.sum(c).alias(c) for c in (*_FIELDS, "n_best", "count_sum")]
    return both.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *total, F.max("groups_sha256").alias("groups_sha256")).drop("uid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
