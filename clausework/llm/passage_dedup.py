"""Near-duplicate passages by compact windows.

Tokens are five-word shingles, lower-cased. Under each of several hash functions the Cartesian tree over a document's token hashes gives compact
windows: a node's interval holds all subsequences whose least hash is the node's, so they share a signature. Windows
at least as wide as a passage are kept, named by function and least hash, and names of one document only are set aside. The rest is dealt out by
name with the words around the centre. Within a name, every frame of ``length`` words around the centre is looked up among those of all
windows, so no exact repeat is left out. Windows without one are compared with the windows of the name that share one of their
rarest shingles (so many are taken that no similar pair shares none): with the earliest and the one before first, then with all that have
enough shingles in common, those with the most first, until one verifies or none is left. Pairs are verified on the words: an equal run of at least ``length`` words, or a segment of as many whose shingle sets have a
similarity of 0.8 or more. Words travel as 16 bits of their hash, so 50 words are compared by 800 bits and a shingle by 80: texts that no function of the
words tells apart otherwise are taken as equal. The passage goes from the document with the larger id. A near passage of similarity 0.8 is missed by
all four functions with probability 0.002; ``tests/llm`` measures what is found.

Copies of a whole text lose all of it if it has ``length`` words, except the least id. Null texts are empty; rows of the same
id do not remove from each other, rows without an id are returned unchanged. Empty tables give empty results; columns of
the input named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.llm import blobs, home
from clausework.llm.session import table, without
from clausework.llm.suffix_dedup import home_tags, merge, sliding_min, tag
from clausework.llm.words import U64, Docs, documents, mix, shingles

QUERY = "op2_passage_dedup"
ORACLE_SQL = None
LENGTH, WIDTH, FUNCTIONS = 50, 5, 4
PERCENT = 80
SLICE_ROWS, BLOCK_ROWS = 4_000, 2_048
FRAME_KEYS, ROUND_PAIRS, HELD_ROWS, MARK_BITS = 1 << 22, 1 << 12, 1 << 14, 11
FREQUENT = 64
_SEEDS = mix(np.arange(1, 9, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _place_mask(n: int) -> U64:
    """Low bits that give way to places: 24, more only for texts of more shingles."""
    return U64((1 << max(24, int(n).bit_length())) - 1)


def centres(v: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of least hashes of all frames of ``width`` tokens, and their documents: the tree's nodes that are wide enough."""
    if len(v) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _place_mask(len(v))
    least = sliding_min((v & ~low) | np.arange(len(v), dtype=U64), width)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
    ok = np.arange(len(least)) + width <= first[1:][doc]
    least, doc = least[ok], doc[ok]
    new = np.ones(len(least), dtype=bool)
    new[1:] = least[1:] != least[:-1]
    return (least[new] & low).astype(np.int64), doc[new]


def cartesian_intervals(v: np.ndarray, places: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of a Cartesian tree's nodes at ``places`` within [low, high): up to the next lesser hash on either side.

    Any lesser hash next to a wide node is a wide node itself, so the tree over the places alone has the same intervals.
    """
    left, right, stack = np.empty(len(places), np.int64), np.full(len(places), high - 1), []
    key = ((v[places] & ~_place_mask(len(v))) | places.astype(U64)).tolist()
    at = places.tolist()
    for i, k in enumerate(key):
        while stack and key[stack[-1]] > k:
            right[stack.pop()] = at[i] - 1
        left[i] = at[stack[-1]] + 1 if stack else low
        stack.append(i)
    return left, right


def windows(d: Docs, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each function: shingle hashes, first of each document, hash values, centres and their documents."""
    h, first = shingles(d.hashes, d.first, WIDTH, short_whole=False)
    for f in range(FUNCTIONS):
        v = mix(h ^ _SEEDS[f])
        yield h, first, v, *centres(v, first, length - WIDTH + 1)


def shared_windows(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = blobs.Sender(buckets)
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for d in documents(b.column("text"), lower=True):
                for _, _, v, place, doc in windows(d, length):
                    yield from sender.add(mix(v[place]), ids[d.rows][doc])
        yield from sender.flush()
        blobs.release()

    return home_tags(docs.mapInArrow(send, blobs.SCHEMA), buckets)


def windows_by_name(homed: DataFrame, length: int, buckets: int) -> DataFrame:
    """Blobs, by name, of compact windows with 16 bits of each word around the centre."""
    reach = length - WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate([h[k] for h in held]) for k in range(7)]
            held.clear()
            *heads, words = cols
            n = heads[5].astype(np.int64)
            first = np.cumsum(n) - n
            order = np.argsort(heads[0], kind="stable")
            bucket = ((heads[0][order] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if z > a:
                    own = order[a:z]
                    at = np.repeat(first[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(int(n[own].sum()))
                    head = blobs.pack([x[own] for x in heads])
                    rows.append((i, int(z - a), len(head).to_bytes(4, "little") + head + pa.Codec("zstd", 1).compress(words[at].tobytes(), asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "n", "payload"])

        for (tags,), copy, rows in home.visits(batches, ["<u8"]):
            rows = rows.filter(pa.array(~copy)) if len(tags) else rows.slice(0, 0)
            if not rows.num_rows:
                continue
            ids, uids = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "uid"))
            for d in documents(rows.column("text"), lower=True):
                short = d.hashes.astype(np.uint16)
                for _, first, v, place, doc in windows(d, length):
                    name = mix(v[place])
                    mine = tag(name, ids[d.rows][doc])
                    hit = tags[np.minimum(np.searchsorted(tags, mine), len(tags) - 1)] == mine
                    if not hit.any():
                        continue
                    low, high = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
                    begin, n = blobs.runs(doc)
                    for s, m in zip(begin.tolist(), n.tolist(), strict=True):
                        if hit[s : s + m].any():
                            x = int(doc[s])
                            low[s : s + m], high[s : s + m] = cartesian_intervals(v, place[s : s + m], int(first[x]), int(first[x + 1]))
                    place, doc, name, low, high = place[hit], doc[hit], name[hit], low[hit], high[hit]
                    low, high = np.maximum(low, place - reach), np.minimum(high, place + reach)
                    start = d.first[:-1][doc] + low - first[:-1][doc]
                    count = high - low + WIDTH
                    at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    held.append((name, ids[d.rows][doc], uids[d.rows][doc], (low - first[:-1][doc]).astype(np.uint32), (place - low).astype(np.uint8), count.astype(np.uint8), short[at]))
                    size += 2 * len(at)
                    if size >= 16 << 20:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()
        blobs.release()

    return homed.mapInArrow(run, blobs.SCHEMA)


def _window_shingles(w: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of dense windows, and where they are whole."""
    wide = w.shape[1] - WIDTH + 1
    s, full = np.zeros((len(w), wide), U64), np.ones((len(w), wide), bool)
    for k in range(WIDTH):
        s = s * U64(0xD1342543DE82EF95) + w[:, k : k + wide].astype(U64)
        full &= there[:, k : k + wide]
    return mix(s), full


def _first_pairs(rows: np.ndarray, place: np.ndarray, lead: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Pairs (row * m + earlier row) of equal key: with the least row and the one before."""
    m = len(open_)
    own = np.flatnonzero((place > 0) & open_[rows])
    return np.unique(np.concatenate([rows[own] * m + rows[lead[own]], rows[own] * m + rows[own - 1]]))


def _marks(s: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window a row of marks, and the mark of each of its shingles; places without a shingle have the last mark, which is never set."""
    at = np.where(full, (s >> U64(64 - MARK_BITS)).astype(np.int16), np.int16(1 << MARK_BITS))
    marks = np.zeros((len(s), (1 << MARK_BITS) + 1), bool)
    marks[np.arange(len(s))[:, None], at] = True
    marks[:, -1] = False
    return marks, at


def _possible(mine: np.ndarray, full: np.ndarray, length: int, percent: int) -> np.ndarray:
    """Whether a segment that holds the centre has enough common places; ``similar`` can hold of no other."""
    n, span = mine.shape
    reach, frame = span // 2, length - WIDTH + 1
    size = (np.arange(reach + 1)[:, None] + np.arange(1, reach + 2)).astype(np.int16)
    least = np.where(size >= frame, -(-percent * (size.astype(np.int32) + frame) // (100 + percent)), 2 * span).astype(np.int16)
    out = np.zeros(n, bool)
    for low in range(0, n, 512):
        some, whole = mine[low : low + 512], full[low : low + 512]
        left, right = (np.where(np.logical_and.accumulate(w, axis=1), np.cumsum(x, axis=1, dtype=np.int16), np.int16(-2 * span)) for x, w in ((some[:, reach::-1], whole[:, reach::-1]), (some[:, reach:], whole[:, reach:])))
        out[low : low + 512] = (left[:, :, None] + right[:, None, :] >= least + some[:, reach, None, None].astype(np.int16)).any(axis=(1, 2))
    return out


def verified(name: np.ndarray, doc: np.ndarray, back: np.ndarray, first: np.ndarray, count: np.ndarray, words: np.ndarray, length: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose window repeats an earlier document's, with begin and end of the passage in words from the window's start.

    The words of window i are ``words[first[i] : first[i] + count[i]]``; windows are laid out in blocks only, so that a large group
    needs its keys and words. Every exact repeat of ``length`` words that two windows of a name hold around their centre is found; a window
    without one is compared with the windows of its name that share enough shingles with it until one verifies or none is left.
    """
    reach, m = length - WIDTH, len(name)
    wide, span = 2 * reach + WIDTH, 2 * reach + 1
    rank = np.empty(m, np.int64)
    by_rank = np.argsort(doc, kind="stable")
    rank[by_rank] = np.arange(m)

    def dense(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = count[rows].astype(np.int64)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        w = np.full((len(rows), wide), 65536, np.int32)
        w[np.repeat(np.arange(len(rows)), n), place + np.repeat(reach - back[rows].astype(np.int64), n)] = words[place + np.repeat(first[rows], n)]
        return w, w < 65536

    def blocks(rows: np.ndarray) -> Iterator[np.ndarray]:
        for low in range(0, len(rows), BLOCK_ROWS):
            yield rows[low : low + BLOCK_ROWS]

    def shingled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (held[0][where[rows]], held[1][where[rows]]) if held else _window_shingles(*dense(rows))

    def frames() -> np.ndarray:
        """Pairs of a row and the earliest one with an equal frame of ``length`` words at the same distance from the centre."""
        power = np.cumprod(np.full(wide, U64(0x9E3779B97F4A7C15)), dtype=U64)
        step = max(1, FRAME_KEYS // max(m, 1))
        out = [np.zeros(0, np.int64)]
        for a in range(0, reach + 1, step):
            at = np.arange(a, min(a + step, reach + 1))
            keys, whose = [], []
            for own in blocks(np.arange(m)):
                w, there = dense(own)
                total = np.zeros((len(own), wide + 1), U64)
                np.cumsum((w.astype(U64) + U64(1)) * power, axis=1, out=total[:, 1:])
                i, k = np.nonzero(there[:, at] & there[:, at + length - 1])
                keys.append(mix(name[own][i] ^ mix(total[i, at[k] + length] - total[i, at[k]])))
                whose.append(own[i])
            key, rows = np.concatenate(keys), np.concatenate(whose)
            order = np.argsort(key)
            begin, size = blobs.runs(key[order])
            begin, size, many = begin[size > 1], size[size > 1], np.repeat(size > 1, size)
            if len(begin):
                rows = rows[order][many]
                begin = np.cumsum(size) - size
                lead = np.repeat(by_rank[np.minimum.reduceat(rank[rows], begin)], size)
                ok = doc[lead] < doc[rows]
                out.append(np.unique(rows[ok] * m + lead[ok]))
        return np.unique(np.concatenate(out))

    def shingle_keys() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and rows: of each window its rarest shingles, so many that two windows with enough shingles in common share one; and which of them ask nobody.

        Segments of similarity ``percent`` have ``least`` places in common at least. Shingles are ordered by a count of their hash's cell
        in the group, then by hash; those that stand alone in their cell have no partner. Where a window's shingles of more than ``FREQUENT``
        windows could not make it similar to anything, even if all were shared, a partner shares a rarer one; the rarest one that they share is among the keys of both,
        so the frequent ones need not ask. Thus windows of a template cost no pairs, as long as what they share is too little.
        """
        frame = length - WIDTH + 1
        least = -(-2 * frame * percent // (100 + percent))
        cells = np.zeros(1 << 20, np.int64)
        for own in blocks(active):
            s, full = shingled(own)
            cells += np.bincount((mix(s ^ name[own, None]) >> U64(44)).astype(np.int64)[full], minlength=len(cells))
        keys, whose, quiet = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for own in blocks(active):
            s, full = shingled(own)
            key = mix(s ^ name[own, None])
            n = cells[(key >> U64(44)).astype(np.int64)]
            common = full & (n > FREQUENT)
            enough = (100 + percent) * common.sum(axis=1) >= 2 * percent * frame
            enough[enough] = _possible(common[enough], full[enough], length, percent)
            order = np.argsort(np.where(full, (n.astype(U64) << U64(40)) | (key & U64((1 << 40) - 1)), U64(2**64 - 1)), axis=1)
            i, k = np.nonzero(np.arange(span) <= (full.sum(axis=1) - least)[:, None])
            k = order[i, k]
            some = full[i, k] & (n[i, k] > 1)
            keys.append(key[i, k][some])
            whose.append(own[i][some])
            quiet.append((common[i, k] & ~enough[i])[some])
        key, rows = np.concatenate(keys), np.concatenate(whose)
        order = np.lexsort((rank[rows], key))
        key, rows = key[order], rows[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])
        return key[new], rows[new], np.concatenate(quiet)[order][new]

    def marked(b: np.ndarray, a: np.ndarray) -> np.ndarray:
        """For each pair, places of b whose shingle a might have: all that it has, and a few more."""
        if held:
            return held[2][where[a][:, None], held[3][where[b]]]
        return np.take_along_axis(_marks(*shingled(a))[0], _marks(*shingled(b))[1].astype(np.int64), axis=1)

    def compare(b: np.ndarray, a: np.ndarray) -> np.ndarray:
        (sb, full), (sa, there) = shingled(b), shingled(a)
        ok, lo, hi = similar(np.where(full, sb, U64(1)), np.where(there, sa, U64(2)), full, length, percent)
        found = np.flatnonzero(ok)
        if len(found):
            rows_out.append(b[found])
            begin_out.append(lo[found])
            end_out.append(hi[found] + WIDTH)
            open_[b[found]] = False
        return found

    def promising(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs can be similar, and the places that they may have in common."""
        chosen, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(b), BLOCK_ROWS):
            x, y = b[low : low + BLOCK_ROWS], a[low : low + BLOCK_ROWS]
            mine = marked(x, y)
            total = mine.sum(axis=1)
            some = np.flatnonzero((100 + percent) * total >= 2 * percent * (length - WIDTH + 1))
            some = some[_possible(mine[some], shingled(x[some])[1], length, percent)]
            chosen.append(low + some)
            totals.append(total[some])
        return np.concatenate(chosen), np.concatenate(totals)

    def best_first(b: np.ndarray, a: np.ndarray) -> None:
        """Pairs that can be similar, of each open window the one with the most in common first, until one verifies."""
        own = (name[b] == name[a]) & (doc[a] < doc[b])
        b, a = b[own], a[own]
        some, total = promising(b, a)
        some = some[np.lexsort((-total, b[some]))]
        while len(some := some[open_[b[some]]]):
            begin, _ = blobs.runs(b[some])
            for low in range(0, len(begin), 512):
                now = some[begin[low : low + 512]]
                compare(b[now], a[now])
            some = np.delete(some, begin)

    def everyone(rows: np.ndarray, place: np.ndarray, lead: np.ndarray) -> None:
        """Each open window with all earlier ones that share a key; many windows at once where they have few."""
        left = np.flatnonzero(open_[rows] & (place > 1))
        left = left[np.argsort(rows[left], kind="stable")]
        begin, n = blobs.runs(rows[left])
        if not len(left):
            return
        asks = np.add.reduceat(place[left], begin)
        some = np.repeat(asks <= ROUND_PAIRS, n)
        few, batch = left[some], np.repeat(np.cumsum(np.where(asks <= ROUND_PAIRS, asks, 0)) // (1 << 20), n)[some]
        for e in np.split(few, blobs.runs(batch)[0][1:]) if len(few) else ():
            k = place[e]
            a = rows[np.repeat(lead[e] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
            best_first(*np.divmod(np.unique(np.repeat(rows[e], k) * m + a), m))
        asked = np.zeros(m, bool)
        for x, k in zip(begin[asks > ROUND_PAIRS].tolist(), n[asks > ROUND_PAIRS].tolist(), strict=True):
            b = int(rows[left[x]])
            asked[:] = False
            for e in left[x : x + k]:
                asked[rows[lead[e] : lead[e] + place[e]]] = True
            others = np.flatnonzero(asked)
            others = others[(name[others] == name[b]) & (doc[others] < doc[b])]
            some, total = promising(np.full(len(others), b), others)
            others = others[some[np.argsort(-total, kind="stable")]]
            at, step = 0, 8
            while open_[b] and at < len(others):
                if len(compare(np.full(len(others[at : at + step]), b), others[at : at + step])) > 1:
                    for out in (rows_out, begin_out, end_out):
                        out[-1] = out[-1][:1]
                at, step = at + step, min(4 * step, 512)

    rows_out, begin_out, end_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    open_ = np.ones(m, dtype=bool)
    held, where, active = None, None, None
    pairs = frames()
    for at in range(0, len(pairs), 4096):
        b, a = np.divmod(pairs[at : at + 4096], m)
        (wb, there), (wa, _) = dense(b), dense(a)
        same = (wb == wa) & there
        right = np.argmin(np.concatenate([same[:, reach:], np.zeros((len(b), 1), bool)], axis=1), axis=1)
        left = np.argmin(np.concatenate([same[:, reach::-1], np.zeros((len(b), 1), bool)], axis=1), axis=1)
        ok = right + left - 1 >= length
        rows_out.append(b[ok])
        begin_out.append(reach - left[ok] + 1)
        end_out.append(reach + right[ok])
        open_[b[ok]] = False
    by_name = np.argsort(name, kind="stable")
    begin, size = blobs.runs(name[by_name])
    earliest = np.empty(m, np.int64)
    earliest[by_name] = np.repeat(np.minimum.reduceat(doc[by_name], begin), size)
    open_ &= doc > earliest
    alive = np.empty(m, bool)
    alive[by_name] = np.repeat(np.logical_or.reduceat(open_[by_name], begin), size)
    active = np.flatnonzero(alive)
    if len(active):
        if len(active) <= HELD_ROWS:
            where = np.empty(m, np.int64)
            where[active] = np.arange(len(active))
            held = _window_shingles(*dense(active))
            held = (*held, *_marks(*held))
        key, rows, quiet = shingle_keys()
        begin, size = blobs.runs(key)
        place, lead = np.where(quiet, 0, np.arange(len(rows)) - np.repeat(begin, size)), np.repeat(begin, size)
        best_first(*np.divmod(_first_pairs(rows, place, lead, open_), m))
        everyone(rows, place, lead)
    rows = np.concatenate(rows_out)
    shift = reach - back.astype(np.int64)[rows]
    found = np.unique(np.stack([rows, np.concatenate(begin_out) - shift, np.concatenate(end_out) - shift], axis=1), axis=0)
    return found[:, 0], found[:, 1], found[:, 2]


def similar(sb: np.ndarray, sa: np.ndarray, full: np.ndarray, length: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether windows of shingles ``sb`` hold a segment similar to one of ``sa``, with its first and last shingle.

    All segments of ``length`` words or more that hold the centre are tried. The longest that begins and ends on a common shingle is
    taken, without such a one the most similar.
    """
    n, span = sb.shape
    reach, frame = span // 2, length - WIDTH + 1
    ok, lo, hi = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    equal = sb[:, :, None] == sa[:, None, :]
    place = equal.argmax(axis=2)
    mine = np.take_along_axis(equal, place[:, :, None], axis=2)[:, :, 0]
    common = mine.sum(axis=1)
    some = np.flatnonzero((100 + percent) * common >= 2 * percent * frame)
    if not len(some):
        return ok, lo, hi
    mine, full, place = mine[some], full[some], place[some].astype(np.int16)
    again = np.flatnonzero(np.count_nonzero(equal.reshape(n, -1)[some], axis=1) > common[some])
    if len(again):  # a shingle stands twice: its nearest place counts
        far = np.abs(np.arange(span)[:, None] - np.arange(span)).astype(np.int16)
        place[again] = np.where(equal[some[again]], far, np.int16(span)).argmin(axis=2).astype(np.int16)

    def table(how: np.ufunc, x: np.ndarray, by: np.ufunc) -> np.ndarray:
        """For each begin (outward from the centre) and end of a segment."""
        return how(by.accumulate(x[:, reach::-1], axis=1)[:, :, None], by.accumulate(x[:, reach:], axis=1)[:, None, :])

    one = mine.astype(np.int16)
    count = table(np.add, one, np.add)
    count -= one[:, reach, None, None]
    theirs = table(np.maximum, np.where(mine, place, np.int16(-1)), np.maximum)
    theirs -= table(np.minimum, np.where(mine, place, np.int16(span)), np.minimum)
    theirs += np.int16(1)
    size = (np.arange(reach + 1)[:, None] + np.arange(1, reach + 2)).astype(np.int16)
    union = np.maximum(theirs, np.int16(frame), out=theirs)
    union += size
    union -= count
    good = table(np.logical_and, full, np.logical_and) & (size >= frame)
    good &= np.int16(100) * count >= np.int16(percent) * union
    ends = good & mine[:, reach::-1, None] & mine[:, None, reach:]
    grade = np.where(ends, size, np.int16(-1)).reshape(len(some), -1)
    best = grade.argmax(axis=1)
    loose = np.flatnonzero(grade[np.arange(len(some)), best] < 0)
    loose = loose[good[loose].any(axis=(1, 2))]
    if len(loose):
        best[loose] = np.where(good[loose], count[loose] / np.maximum(union[loose], 1), -1.0).reshape(len(loose), -1).argmax(axis=1)
    left, right = np.divmod(best, reach + 1)
    ok[some], lo[some], hi[some] = good.any(axis=(1, 2)), reach - left, reach + right
    return ok, lo, hi


def passages(named: DataFrame, length: int, percent: int, buckets: int) -> DataFrame:
    """Blobs, by document bucket, of row, first word and end of verified passages."""

    def work(notes, name, doc, uid, start, back, count, first, words) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        rows, a, z = verified(name, doc, back, first, count, words, length, percent)
        if len(rows):
            at = start.astype(np.int64)[rows]
            yield from notes.add(doc[rows], uid[rows], (at + a).astype(np.uint32), (at + z).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_at, held, notes = None, [], home.Notes(buckets)

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            *heads, words = [np.concatenate([h[k] for h in held]) for k in range(7)]
            held.clear()
            n = heads[5].astype(np.int64)
            first = np.cumsum(n) - n
            order = np.argsort(heads[0], kind="stable")
            begin, _ = blobs.runs(heads[0][order])
            lo = 0
            while lo < len(order):
                nxt = int(np.searchsorted(begin, lo + SLICE_ROWS))
                hi = int(begin[nxt]) if nxt < len(begin) else len(order)
                own = order[lo:hi]
                yield from work(notes, *(x[own] for x in heads), first[own], words)
                lo = hi

        for b in batches:
            for bucket, n, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != bucket_at:
                    yield from done()
                    bucket_at = bucket
                raw = payload.as_py()
                cut_at = 4 + int.from_bytes(raw[:4], "little")
                heads = blobs.unpack(raw[4:cut_at], n, ["<u8", "<i8", "<i8", "<u4", "u1", "u1"])
                size = 2 * int(heads[5].astype(np.int64).sum())
                held.append((*heads, np.frombuffer(pa.Codec("zstd", 1).decompress(raw[cut_at:], size, asbytes=True), np.uint16)))
        yield from done()
        yield from notes.flush()
        blobs.release()

    return blobs.deal(named).mapInArrow(run, home.SCHEMA)


def passage_dedup(docs: DataFrame, length: int = LENGTH, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, with ``n_words``, ``n_removed`` and ``n_spans`` (in words)."""
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "n_spans")]
    d = without(docs, "n_words", "n_removed", "n_spans").withColumnsRenamed({text: "text"} if text != "text" else {})
    inner = [text if c == text else c for c in names]
    packed = d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*[c for c in d.columns if c != "text"]).alias("row"))
    packed = packed.withColumn("uid", F.xxhash64("doc_id", "text"))
    buckets = blobs.buckets_of(docs)
    known = packed.where("doc_id IS NOT NULL")
    copies = home.copies_of(known)
    sent = shared_windows(known.select("doc_id", "text"), length, buckets)
    named = windows_by_name(home.gather(known.select("doc_id", "uid", "text"), copies, sent, buckets), length, buckets)
    gone = passages(named, length, percent, buckets)
    row_type = packed.schema["row"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (uid, begin, end), copies_, rows in home.visits(batches, ["<i8", "<u4", "<u4"]):
            texts: list[str] = [""] * rows.num_rows
            counts = np.zeros((3, rows.num_rows), np.int64)
            copy, uids, column = copies_.tolist(), rows.column("uid").to_pylist(), rows.column("text")
            for g in documents(column):
                for k, i in enumerate(g.rows.tolist()):
                    raw = column[i].as_py()
                    lo, n = int(g.first[k]), int(g.n_words[k])
                    a, z = np.searchsorted(uid, uids[i], side="left"), np.searchsorted(uid, uids[i], side="right")
                    if copy[i] and n >= length:
                        spans = [(0, n)]
                    elif z > a:
                        spans = list(zip(*(x.tolist() for x in merge(begin[a:z].astype(np.int64), end[a:z].astype(np.int64))), strict=True))
                    else:
                        spans = []
                    counts[:, i] = n, sum(y - x for x, y in spans), len(spans)
                    if spans:
                        data, base, at, kept = raw.encode(), int(g.bounds[k]), 0, []
                        for x, y in spans:
                            kept.append(data[at : int(g.start[lo + x]) - base])
                            at = int(g.start[lo + y]) - base if y < n else len(data)
                        kept.append(data[at:])
                        raw = b"".join(kept).decode()
                    texts[i] = raw
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(texts, pa.string()), *(pa.array(c) for c in counts)], names=["row", "text", "n_words", "n_removed", "n_spans"])

    schema = T.StructType([row_type, T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed", "n_spans"))])
    out = home.gather(known.select("doc_id", "uid", "text", "row"), copies, gone, buckets).mapInArrow(finish, schema)
    bare = packed.where("doc_id IS NULL").select("row", "text", F.size(F.filter(F.split("text", "[ \t-\r]+"), lambda x: x != "")).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    out = out.unionByName(bare)
    return out.select(*[F.col("text").alias(text) if c == text else F.col(f"row.{c}").alias(c) for c in inner], "n_words", "n_removed", "n_spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
