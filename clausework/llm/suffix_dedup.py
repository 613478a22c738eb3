"""Exact removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Strings are found in
four steps. (1) Every string of that length is named by its least hashed 16-byte mer, so equal strings have equal names;
names that occur in one document only are set aside. (2) For the rest, maximal runs of strings with one name are cut out
of the texts and dealt out by name. (3) Of the runs of each share, the distinct ones that have a string's hash in common with another are concatenated, suffix-sorted and transformed; breadth-first backward
extension of intervals sets common-prefix values in increasing order and stops at ``length``: positions still unset
then join suffixes that share at least ``length`` bytes. The least document of each such block decides for all its
strings. (4) Removed intervals go back to their documents, which are cut and digested.

Documents equal to one with a smaller id are removed whole if they are long enough, without passing through steps 2 and
3. What is removed is told by bytes, but for SHA-256 of whole texts and a 64-bit hash of id and text that brings removed intervals back to their rows. Matches never cross documents. Null texts are empty. Rows of the same id
do not remove each other; rows without an id remove nothing and lose nothing. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import blobs, home
from clausework.llm.session import table
from clausework.llm.words import _BYTE, CHUNK_BYTES, U64, mix, string_parts

QUERY = "op9_suffix_dedup"
LENGTH = 50
MER = 16
RUN = 60  # strings per run, so that a run and its end are sorted in five rounds
SLICE_BYTES = 1 << 19
_P = U64(0xD1342543DE82EF95)
_P_INVERSE = U64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        up, down = np.full(size, _P), np.full(size, _P_INVERSE)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mer_hashes(part: np.ndarray, mer: int = MER) -> np.ndarray:
    """Hash of the ``mer`` bytes from each place on."""
    up, down = _powers(len(part))
    run = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[part] * up, dtype=U64)])
    return mix((run[mer:] - run[:-mer]) * down[: len(part) - mer + 1]) if len(part) >= mer else np.zeros(0, U64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def string_names(part: np.ndarray, bounds: np.ndarray, length: int, mer: int = MER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of ``length`` bytes that share their name: start and number of strings, name, document."""
    n = len(part)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    least = sliding_min(mer_hashes(part, mer), length - mer + 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    ok = np.arange(len(least)) + length <= bounds[1:][doc]
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new & ok)
    ends = np.append(np.flatnonzero(new), len(least))
    stop = np.minimum(ends[np.searchsorted(ends, begin, side="right")], bounds[1:][doc[begin]] - length + 1)
    return begin, stop - begin, mix(least[begin]), doc[begin]


def text_groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, bytes and bounds of groups of about a megabyte of whole texts."""
    data, bounds = string_parts(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK_BYTES, side="right")) - 1))
        yield np.arange(i, j), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def tag(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(name ^ mix(doc.astype(np.int64).view(U64)))


def shared_names(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Blobs, by document bucket, of tags of each document and name that occurs in other documents, too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = blobs.Sender(buckets)
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for rows, part, bounds in text_groups(b.column("text")):
                _, _, name, doc = string_names(part, bounds, length)
                order = np.lexsort((doc, name))
                name, doc = name[order], doc[order]
                keep = np.ones(len(name), dtype=bool)
                keep[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
                yield from sender.add(name[keep], ids[rows][doc[keep]])
        yield from sender.flush()

    return home_tags(docs.mapInArrow(send, blobs.SCHEMA), buckets)


def home_tags(sent: DataFrame, buckets: int) -> DataFrame:
    """Notes for documents: tags of the names that they share with others."""

    def start() -> tuple:
        notes = home.Notes(buckets)

        def meet(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            name, doc = arrays
            begin, n = blobs.runs(name)
            own = np.repeat(np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin), n)
            yield from notes.add(doc[own], tag(name[own], doc[own]))

        return meet, notes.flush

    return blobs.reduce_buckets(sent, ["<u8", "<i8"], start, home.SCHEMA)


def runs_by_name(gathered: DataFrame, length: int, buckets: int) -> DataFrame:
    """Blobs, by name, of runs: name, document, row, start, number of strings, and the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            name, doc, uid, start, count = (np.concatenate([h[k] for h in held]) for k in range(5))
            strings = np.concatenate([h[5] for h in held])
            width = count.astype(np.int64) + length - 1
            first = np.cumsum(width) - width
            order = np.argsort(name, kind="stable")
            bucket = ((name[order] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if z > a:
                    own = order[a:z]
                    w = width[own]
                    at = np.repeat(first[own] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
                    head = blobs.pack([x[own] for x in (name, doc, uid, start, count)])
                    body = pa.Codec("zstd", 1).compress(strings[at].tobytes(), asbytes=True)
                    rows.append((i, z - a, len(head).to_bytes(4, "little") + head + body))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([int(r[1]) for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "n", "payload"])

        for (tags,), copy, rows in home.visits(batches, ["<u8"]):
            rows = rows.filter(pa.array(~copy)) if len(tags) else rows.slice(0, 0)
            if not rows.num_rows:
                continue
            ids, uids = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "uid"))
            for own, part, bounds in text_groups(rows.column("text")):
                begin, count, name, doc = string_names(part, bounds, length)
                mine = tag(name, ids[own][doc])
                hit = tags[np.minimum(np.searchsorted(tags, mine), len(tags) - 1)] == mine
                begin, count, name, doc = begin[hit], count[hit], name[hit], doc[hit]
                pieces = -(-count // RUN)
                k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin, name, doc = np.repeat(begin, pieces) + k * RUN, np.repeat(name, pieces), np.repeat(doc, pieces)
                count = np.minimum(np.repeat(count, pieces) - k * RUN, RUN)
                if len(begin):
                    w = count + length - 1
                    at = np.repeat(begin - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
                    held.append((name, ids[own][doc], uids[own][doc], (begin - bounds[:-1][doc]).astype(np.uint32), count.astype(np.uint8), part[at]))
                    size += len(at)
                if size >= 16 << 20:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return gathered.mapInArrow(run, blobs.SCHEMA)


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of all suffixes; ``left`` is how many symbols stand before each one's end, which sorts first, ties by place."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key * 512 + np.where(left > k, padded[k : n + k], 0)
    depth, most = 7, int(left.max()) + 1
    while True:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        if depth >= most or rank[order[-1]] == n - 1:
            return np.argsort(rank * n + np.arange(n))
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - depth)] = rank[depth:] + 1
        key = rank * (n + 1) + np.where(left > depth, ahead, 0)
        depth *= 2


def common_prefix_blocks(order: np.ndarray, symbols: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """For each place of the order, whether it shares fewer than ``length`` symbols with the one before.

    Intervals are extended backwards breadth first: those of value l give common prefixes of l, until ``length``.
    """
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.zeros(n, np.int64)
    before[1:] = symbols[:-1]
    start = np.ones(n, dtype=bool)
    start[1:] = left[:-1] == 0  # the first symbol of a string has none before it
    letter = np.where(start, 0, before)[order]
    target = np.where(start[order], -1, place[order - 1])
    by = np.argsort(letter * (n + 1) + np.arange(n))
    same = letter[by[1:]] == letter[by[:-1]]
    previous, following = np.full(n, -1), np.full(n, n)
    previous[by[1:][same]] = by[:-1][same]
    following[by[:-1][same]] = by[1:][same]
    ends = int((left == 0).sum())  # suffixes that are an end alone come first
    lcp = np.full(n + 1, -1, np.int64)
    lcp[: ends + 1] = 0
    lcp[n] = 0
    low, high = np.array([0]), np.array([n - 1])
    for value in range(length):
        size = high - low + 1
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        has = letter[at] > 0
        first = has & (previous[at] < np.repeat(low, size))
        last = has & (following[at] > np.repeat(high, size))
        a, z = target[at[first]], target[at[last]]
        of_a, of_z = np.repeat(np.arange(len(low)), size)[first], np.repeat(np.arange(len(low)), size)[last]
        x, y = np.argsort(of_a * 512 + letter[at[first]]), np.argsort(of_z * 512 + letter[at[last]])
        a, z = a[x], z[y]
        fresh = lcp[z + 1] < 0
        low, high = a[fresh], z[fresh]
        lcp[high + 1] = value
        if value == 0:
            low, high = np.concatenate([low, np.arange(ends)]), np.concatenate([high, np.arange(ends)])
            edge = a[~fresh]
            low, high = np.concatenate([low, edge]), np.concatenate([high, z[~fresh]])
        if not len(low):
            break
    return lcp[:n] >= 0


def least_holders(strings: np.ndarray, width: np.ndarray, holder: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the strings, the least holder of a string that has the ``length`` bytes from there on."""
    n = len(width)
    first = np.cumsum(width) - width
    symbols = np.zeros(len(strings) + n, np.int64)
    where = np.arange(len(strings)) + np.repeat(np.arange(n), width)
    symbols[where] = strings.astype(np.int64) + 1
    left = np.zeros(len(symbols), np.int64)
    left[where] = np.repeat(width, width) - (np.arange(len(strings)) - np.repeat(first, width))
    order = suffix_order(symbols, left)
    new = common_prefix_blocks(order, symbols, left, length)
    new[0] = True
    owner = np.repeat(holder, width + 1)[order]
    begin = np.flatnonzero(new)
    out = np.empty(len(symbols), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(owner, begin), np.diff(np.append(begin, len(order))))
    return out[where]


def searched(strings: np.ndarray, width: np.ndarray, length: int) -> np.ndarray:
    """Marks of the strings to search: those with ``length`` bytes whose hash stands in them or another string once more.

    Equal bytes have equal hashes, so a string without a mark shares no ``length`` bytes with any other.
    """
    count = width - length + 1
    row = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(width) - width
    h = mer_hashes(strings, length)[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(row))]
    order = np.argsort(h)
    equal = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    out = np.zeros(len(count), dtype=bool)
    out[row[order[equal]]] = out[row[order[equal + 1]]] = True
    return out


def removed_intervals(runs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Blobs, by document bucket, of row, begin and end of removed bytes."""

    def work(name: np.ndarray, doc: np.ndarray, uid: np.ndarray, start: np.ndarray, count: np.ndarray, strings: np.ndarray, notes: home.Notes) -> Iterator[pa.RecordBatch]:
        width = count.astype(np.int64) + length - 1
        first = np.cumsum(width) - width
        place = np.arange(len(strings)) - np.repeat(first, width)
        h = np.add.reduceat(_BYTE[strings] * _powers(RUN + length)[0][place], first)
        h = mix(h + width.astype(U64)) ^ name
        order = np.lexsort((doc, h))
        begin, n = blobs.runs(h[order])
        lead = order[begin]
        w = width[lead]
        at = np.repeat(first[lead] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(begin)), n)
        same = np.repeat(first[lead][which], width) + place  # equal hashes are compared byte by byte
        odd = np.flatnonzero(np.add.reduceat((strings[same] != strings).astype(np.int64), first))
        if len(odd):
            for i in odd:
                which[i] = len(w)
                w = np.append(w, width[i])
                lead = np.append(lead, i)
            at = np.concatenate([np.arange(first[i], first[i] + width[i]) for i in lead])
        _, inverse, several = np.unique(name[lead], return_inverse=True, return_counts=True)
        mixed = several[inverse] > 1  # a name with one distinct run needs no search
        least = np.repeat(doc[lead], w)
        if mixed.any():
            own = np.flatnonzero(mixed)
            mixed[own] = searched(strings[at[np.repeat(mixed, w)]], w[own], length)
        if mixed.any():
            sought = np.repeat(mixed, w)
            least[sought] = least_holders(strings[at[sought]], w[mixed], doc[lead][mixed], length)
        begins = np.cumsum(w) - w
        c = count.astype(np.int64)
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        goes = least[np.repeat(begins[which], c) + k] < np.repeat(doc, c)
        place = np.repeat(start.astype(np.int64), c) + k
        row = np.repeat(np.arange(len(c)), c)
        place, row = place[goes], row[goes]
        if not len(place):
            return
        opens = np.ones(len(place), dtype=bool)
        opens[1:] = (place[1:] != place[:-1] + 1) | (row[1:] != row[:-1])
        b = np.flatnonzero(opens)
        e = np.append(b[1:], len(place)) - 1
        yield from notes.add(doc[row[b]], uid[row[b]], place[b].astype(np.uint32), (place[e] + length).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, notes = None, [], home.Notes(buckets)

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            cols = [np.concatenate([h[k] for h in held]) for k in range(6)]
            held.clear()
            *heads, strings = cols
            width = heads[4].astype(np.int64) + length - 1
            first = np.cumsum(width) - width
            order = np.argsort(heads[0], kind="stable")
            heads, width, first = [x[order] for x in heads], width[order], first[order]
            begin, _ = blobs.runs(heads[0])
            total = np.cumsum(width)
            lo = 0
            while lo < len(order):
                past = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE_BYTES))
                nxt = int(np.searchsorted(begin, max(past, lo + 1)))
                hi = int(begin[nxt]) if nxt < len(begin) else len(order)
                w = width[lo:hi]
                idx = np.repeat(first[lo:hi] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
                yield from work(*(x[lo:hi] for x in heads), strings[idx], notes)
                lo = hi

        for b in batches:
            for bucket, n, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != at:
                    yield from done()
                    at = bucket
                raw = payload.as_py()
                cut_at = 4 + int.from_bytes(raw[:4], "little")
                heads = blobs.unpack(raw[4:cut_at], n, ["<u8", "<i8", "<i8", "<u4", "u1"])
                size = int((heads[4].astype(np.int64) + length - 1).sum())
                held.append((*heads, np.frombuffer(pa.Codec("zstd", 1).decompress(raw[cut_at:], size, asbytes=True), np.uint8)))
        yield from done()
        yield from notes.flush()
        blobs.release()

    return blobs.deal(runs).mapInArrow(run, home.SCHEMA)


def merge(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:], len(begin)) - 1]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes as ``kept`` for each row."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    d = d.withColumn("uid", F.xxhash64("doc_id", "text"))
    buckets = blobs.buckets_of(docs)
    known = d.where("doc_id IS NOT NULL")
    copies = home.copies_of(known)
    sent = shared_names(known, length, buckets)
    runs = runs_by_name(home.gather(known, copies, sent, buckets), length, buckets)
    gone = removed_intervals(runs, length, buckets)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (uid, begin, end), copies_, rows in home.visits(batches, ["<i8", "<u4", "<u4"]):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, u, copy, t in zip(rows.column("doc_id").to_pylist(), rows.column("uid").to_pylist(), copies_.tolist(), rows.column("text"), strict=True):
                raw = t.as_py().encode()
                a, z = np.searchsorted(uid, u, side="left"), np.searchsorted(uid, u, side="right")
                if copy:
                    spans = [(0, len(raw))] if len(raw) >= length else []
                elif z > a:
                    spans = list(zip(*(x.tolist() for x in merge(begin[a:z].astype(np.int64), end[a:z].astype(np.int64))), strict=True))
                else:
                    spans = []
                at, kept = 0, []
                for x, y in spans:
                    kept.append(raw[at:x])
                    at = y
                kept.append(raw[at:])
                rest = b"".join(kept)
                for c, v in zip(out, (i, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if with_text else None), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 + with_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])  # noqa: B905

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    out = home.gather(known, copies, gone, buckets).mapInArrow(finish, schema)
    bare = d.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.encode("text", "utf-8").alias("kept")] if with_text else []))
    return out.unionAll(bare)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = None
