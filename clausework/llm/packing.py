"""Best-fit packing of token sequences by a linear grouping scheme.

Documents become byte-pair ids plus an end id; longer ones than a sequence are cut, the shorter piece first. Only the
number of pieces of each length reaches the driver, at most as many numbers as a sequence has places. There the large lengths are sorted into
groups of equal cardinality and rounded up to their group's largest; a linear program over few-size configurations
(column generation, its knapsacks solved by dynamic programming) is rounded down and completed; actual lengths then
take the places of the rounded ones, and small pieces go best-fit into what is left. The plan is a list of runs, from
which every piece reads its place by its rank among the pieces of its length. Ranks come from counts per length and bucket, so no
length, however common, meets in one task.

Column generation ends when no configuration improves the program, or after a number of rounds (``rounds``, 900); it is a valid packing then, too, if
not the tightest. Encoding is a word cache before a byte-pair encoder built from the tokenizer's file; ids are those of ``tokenizers``.

Null and empty texts are the end id alone. Repeated rows and rows without an id are packed once each. Only id and text of the input are read, whatever
its other columns are named. Empty tables give empty results.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.llm.session import cut, shuffle_partitions, table

QUERY = "op6_best_fit_packing"
ORACLE_SQL = None
SEQUENCE = 1024
END_ID = 2
GROUPS = 128
SMALL_PARTS = (4, 2)  # pieces up to a sequence's quarter or half count as small; the plan with fewer sequences is used
CACHE_WORDS = 400_000
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ODD = re.compile(r"\s\s|[^\S \n]|^\s|\s\Z|\x00")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + k)] = b
    return out


class Encoder(dict):
    """Text to little-endian ids by a byte-level BPE file.

    Ids of a space-led word do not depend on its surroundings, so words are looked up, and encoded when missing;
    texts with other white space than single spaces and newlines are encoded whole. Added tokens of the file stand for themselves wherever a text
    holds them, as ``tokenizers`` reads them by default; the text between them is encoded part by part.
    """

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, vocab = _byte_letters(), file["model"]["vocab"]
        added = {t["content"]: t for t in file.get("added_tokens") or ()}
        if any(t.get(k) for t in added.values() for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip or ask for word bounds are not supported")
        self.added = {c: int(t["id"]).to_bytes(4, "little") for c, t in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        ranks = {bytes(letters[c] for c in k): i for k, i in vocab.items() if k not in added and all(c in letters for c in k)}
        self.bpe = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.asarray(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[word] = self.whole(word)
        return ids

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return b"".join(self.added[x] if x in self.added else self.plain(x) for x in self.split.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_pieces(n: int, sequence: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids, the shorter one first."""
    first = n % sequence or min(n, sequence)
    return [(0, first), *((s, sequence) for s in range(first, n, sequence))]


def pieces(docs: DataFrame, text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as binary."""
    path = tokenizer or default_tokenizer()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(value.as_py() or "") + end
                for k, (start, length) in enumerate(cut_pieces(len(ids) // 4, sequence)):
                    own = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (doc_id, k, start, length, zlib.crc32(own), own if with_ids else None), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)  # noqa: B905

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, largest first, in groups of equally many pieces: (length, count) runs."""
    each = max(1, -(-sum(counts.values()) // groups))
    out: list[list[tuple[int, int]]] = [[]]
    room = each
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = each
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return [g for g in out if g]


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 900) -> list[tuple[np.ndarray, int]]:
    """Patterns of size counts and how often to use them; together they meet the demand exactly."""
    k = len(sizes)
    s, d = np.array(sizes), np.array(demand, dtype=np.float64)
    basis = np.diag([float(capacity // x) for x in sizes])
    for _ in range(rounds):
        try:
            x, price = np.linalg.solve(basis, d), np.linalg.solve(basis.T, np.ones(k))
        except np.linalg.LinAlgError:
            break
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(s.min()), capacity + 1):
            fits = s <= c
            value = np.where(fits, best[np.maximum(c - s, 0)] + price, -1.0)
            j = int(value.argmax())
            if value[j] > best[c - 1] + 1e-12:
                best[c], pick[c] = value[j], j
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= s[pick[c]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.maximum(np.linalg.solve(basis, d), 0)
    left, out = np.array(demand), []
    for j in np.argsort(-x):
        column = basis[:, j].astype(int)
        n = int(x[j] + 1e-9)
        while n and (column * n > left).any():
            n -= 1
        if n:
            out.append((column, n))
            left = left - column * n
    while left.any():
        column, room = np.zeros(k, int), capacity
        for j in np.argsort(-s, kind="stable"):
            take = min(int(left[j]), room // int(s[j]))
            column[j], room = take, room - take * int(s[j])
        n = min(int(left[j] // column[j]) for j in np.flatnonzero(column))
        out.append((column, n))
        left = left - column * n
    return out


class Plan:
    """Runs of places: pieces of a length with ranks from rank on fill count bins, each at the same offset."""

    def __init__(self, counts: dict[int, int], capacity: int = SEQUENCE, groups: int = GROUPS, small: int | None = None):
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # length, rank, bins, per bin, first sequence, offset
        self.next: dict[int, int] = defaultdict(int)
        self.n_sequences = 0
        self.capacity = capacity
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, bins)
        small = capacity // SMALL_PARTS[0] if small is None else small
        counts = {k: n for k, n in counts.items() if n}
        full = counts.pop(capacity, 0)
        if full:
            self._put(capacity, full, 1, self._new(full), 0)
        self._large({k: n for k, n in counts.items() if k > small}, groups)
        for length in sorted((k for k in counts if k <= small), reverse=True):
            self._small(length, counts[length])

    def _new(self, bins: int) -> int:
        self.n_sequences += bins
        return self.n_sequences - bins

    def _put(self, length: int, bins: int, each: int, first: int, offset: int) -> None:
        self.runs.append((length, self.next[length], bins, each, first, offset))
        self.next[length] += bins * each

    def _large(self, counts: dict[int, int], groups: int) -> None:
        if not counts:
            return
        queues = linear_groups(counts, groups)
        made = configurations([g[0][0] for g in queues], [sum(n for _, n in g) for g in queues], self.capacity)
        for column, bins in made:
            slots = []
            for j in np.flatnonzero(column):
                for _ in range(column[j]):
                    runs, need = [], bins
                    while need:
                        length, n = queues[j][0]
                        take = min(need, n)
                        runs.append((length, take))
                        need -= take
                        queues[j][0] = (length, n - take)
                        if n == take:
                            queues[j].pop(0)
                    slots.append(runs)
            first, done = self._new(bins), 0
            ends = [np.cumsum([n for _, n in r]) for r in slots]
            for stop in sorted({int(e) for x in ends for e in x}):
                offset = 0
                for runs, e in zip(slots, ends, strict=True):
                    length = runs[int(np.searchsorted(e, done, side="right"))][0]
                    self._put(length, stop - done, 1, first + done, offset)
                    offset += length
                self.open[self.capacity - offset].append((first + done, stop - done))
                done = stop

    def _small(self, length: int, left: int) -> None:
        while left:
            room = next((r for r in range(length, self.capacity + 1) if self.open.get(r)), None)
            if room is None:
                room = self.capacity
                bins = -(-left // (room // length))
                self.open[room].append((self._new(bins), bins))
            first, bins = self.open[room].pop()
            each = min(room // length, left)
            use = min(bins, left // each)
            self._put(length, use, each, first, self.capacity - room)
            left -= use * each
            self.open[room - each * length].append((first, use))
            if bins > use:
                self.open[room].append((first + use, bins - use))

    def arrays(self) -> np.ndarray:
        """Runs sorted by length and rank."""
        return np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 6)


def places(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    key = lambda a, b: a * (1 << 44) + b
    at = np.searchsorted(key(runs[:, 0], runs[:, 1]), key(length, rank), side="right") - 1
    r = runs[at]
    k = rank - r[:, 1]
    return r[:, 4] + k // r[:, 3], r[:, 5] + k % r[:, 3] * length


def pack(made: DataFrame, sequence: int = SEQUENCE, groups: int = GROUPS) -> DataFrame:
    """``made`` (of ``pieces``) with ``sequence_id`` and ``offset``."""
    spark = made.sparkSession
    buckets = 4 * shuffle_partitions(spark)
    made = cut(made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")))
    counts = cut(made.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    lengths = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = min((Plan(lengths, sequence, groups, sequence // part) for part in SMALL_PARTS), key=lambda p: p.n_sequences)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = made.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    names = [c for c in made.columns if c != "bucket"]
    runs = plan.arrays()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = places(runs, b.column("length").to_numpy(), b.column("rank").to_numpy()) if b.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{n} {t}" for n, t in made.dtypes if n != "bucket")
    return ranked.select(*names, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
