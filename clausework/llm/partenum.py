"""Exact n-gram Jaccard join of documents by PartEnum signatures, in two rounds.

A document's set holds the hashes (64 bits) of its distinct word shingles. Equal sets, told apart by two 64-bit sums and their
size, are joined first and the least id stands for all. Sizes fall into bands, so that similar sets are in the same or in
neighbouring bands; for each of the two, the shingle domain is split into parts and each part into three. Two sets that are similar
enough differ in so few shingles that in some part two thirds agree whole: every part and pair of thirds gives a
signature. Unrelated sets would meet in signatures of empty thirds, so there are spare parts: a set that has no more parts with
thin signatures (fewer than ``THIN`` shingles) than spare ones leaves these signatures out, as a part without them must agree, too;
of two similar sets, the one that leaves out more still gives a signature that the other gives.

Near copies share hundreds of signatures, and each would find the same pairs again. So the first round takes the signatures of ``LEAD`` parts alone
and compares each document with the least one of its signature only, which links most near copies at a cost in proportion to their number. The second
round takes all signatures. One whose documents are all known to be in one component has nothing to add; else they meet in the family
of its least document, where all pairs of different components are verified exactly. Large families are dealt out in tiles: documents
outside the family's largest component meet all others, those inside never each other.
Components come from star contraction in DataFrame operations. Ids of documents wanted again are sought by a bitmap of bounded
size, so that only their texts, and some more, are shuffled; the join after it is exact.

Null and empty texts have no set and are linked with nothing. Documents of the same id are one node of the graph, each row keeps its own
size; rows without an id come out with a null component. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import blobs, bitmap
from clausework.llm.graph import components
from clausework.llm.session import cut, table
from clausework.llm.words import U64, Docs, documents, mix, shingles

QUERY = "op10_ngram_jaccard"
WIDTH, PERCENT = 4, 85
TILE = 1024
COLUMNS = 4096
SPARE_SHARE, SPARE_ROUND, THIN = 6, 4, 2  # a spare part for six needed ones
LEAD, LEAD_LOAD = 2, 4  # parts of the first round, and the least shingles of a signature there
_TOP = U64(32)


def size_bands(most: int, percent: int) -> np.ndarray:
    """Upper ends of the size bands up to ``most``: similar sets are at most one band apart."""
    ends, low = [0], 1
    while ends[-1] < most:
        ends.append(max(low, low * 100 // percent))
        low = ends[-1] + 1
    return np.array(ends, dtype=np.int64)


def shingle_sets(d: Docs, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted within each document, and the first of each document."""
    h, first = shingles(d.hashes, d.first, width, short_whole=True)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(first))).astype(np.int64)


def signatures(h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, and which set each is of."""
    return _signatures(h, first, percent)[:2]


def _signatures(h: np.ndarray, first: np.ndarray, percent: int, lead: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, their sets, and whether the set is of the upper of the signature's two bands; with ``lead``, of so many parts only."""
    size = np.diff(first)
    if not len(h):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)
    ends = size_bands(int(size.max()), percent)
    ends = np.append(ends, [max(ends[-1] + 1, (ends[-1] + 1) * 100 // percent)])
    band = np.searchsorted(ends, size)  # ends[band - 1] < size <= ends[band]
    out, of, upper = [], [], []
    full = np.flatnonzero(size > 0)
    doc = np.repeat(np.arange(len(size)), size)
    value = mix(h + U64(0x51ED270B7A1F3C2D))
    for step in (0, 1):
        instance = band + step  # pairs of bands instance - 1 and instance, and pairs within instance - 1
        apart = (100 - percent) * (ends[instance - 1] + ends[np.minimum(instance, len(ends) - 1)]) // (100 + percent)
        needed = np.where(apart > 0, (apart + 2) // 2, 1)
        spare = np.where(apart > 0, (needed + SPARE_ROUND) // SPARE_SHARE, 0)
        parts = needed + spare
        kept = parts if lead is None else np.minimum(parts, lead)
        base = np.concatenate([[0], np.cumsum(np.where(size > 0, kept * 3, 0))])
        x = mix(h ^ (instance.astype(U64) * U64(0xC2B2AE3D27D4EB4F))[doc])
        part = ((x >> _TOP) * parts.astype(U64)[doc] >> _TOP).astype(np.int64)
        third = ((x & U64(0xFFFFFFFF)) * U64(3) >> _TOP).astype(np.int64)
        sums = np.zeros(int(base[-1]), dtype=U64)
        place = base[doc] + part * 3 + third
        near = part < kept[doc]
        place = place[near]
        np.add.at(sums, place, value[near])
        cell = sums.reshape(-1, 3)
        load = np.bincount(place, minlength=len(sums)).reshape(-1, 3)
        own = np.repeat(full, kept[full])
        begin = np.cumsum(kept[full]) - kept[full]
        number = np.arange(len(own)) - np.repeat(begin, kept[full])
        whole = cell.sum(axis=1, dtype=U64)
        tag = mix(instance[own].astype(U64) * U64(0x9E3779B97F4A7C15) + number.astype(U64))
        many = apart[own] > 0
        load = np.where(many[:, None], load.sum(axis=1)[:, None] - load, 1 << 30)
        least = np.zeros(len(size), dtype=np.int64)
        for t in range(1, THIN + 1) if lead is None else ():
            thin = np.add.reduceat((load < t).any(axis=1).astype(np.int64), begin)
            least[full] = np.where(thin <= spare[full], t, least[full])
        for j in range(3):
            use = (load[:, j] >= least[own]) & (many | (j == 0)) if lead is None else (load[:, j] >= LEAD_LOAD) & many
            left = np.where(many, whole - cell[:, j], whole)
            out.append(mix(left ^ mix(tag + U64(j + 1)))[use])
            of.append(own[use])
            upper.append(np.full(len(of[-1]), step == 0))
    return np.concatenate(out), np.concatenate(of), np.concatenate(upper)


def _keys(h: np.ndarray, first: np.ndarray, percent: int, lead: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures whose lowest bit tells the upper band, and their sets."""
    sig, of, upper = _signatures(h, first, percent, lead)
    return sig & ~U64(1) | upper.astype(U64), of


def set_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, the two sums that name the set, and the signatures of the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s1, s2 = (np.zeros(b.num_rows, t) for t in (np.int64, U64, U64))
            keys, count = [np.zeros(0, U64)], np.zeros(b.num_rows + 1, np.int32)
            for d in documents(b.column(1), lower=True):
                h, first = shingle_sets(d, width)
                n[d.rows] = np.diff(first)
                full = np.flatnonzero(np.diff(first))
                if len(full):
                    s1[d.rows[full]] = np.add.reduceat(mix(h), first[:-1][full])
                    s2[d.rows[full]] = np.add.reduceat(mix(h ^ U64(0xA5A5A5A55A5A5A5A)), first[:-1][full])
                key, of = _keys(h, first, percent, LEAD)
                keys.append(key[np.argsort(of, kind="stable")])
                count[d.rows + 1] = np.bincount(of, minlength=len(d.rows))
            lead = pa.ListArray.from_arrays(pa.array(np.cumsum(count, dtype=np.int32)), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lead], names=["doc_id", "n_shingles", "s1", "s2", "lead"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, lead array<long>")


def lead_stars(rows: DataFrame) -> DataFrame:
    """leader, member (leaders' own rows included): first-round signatures' least documents and the others."""
    n_buckets = blobs.buckets_of(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = blobs.Sender(n_buckets)
        for b in batches:
            keys, ids = b.column(1), b.column(0).to_numpy(zero_copy_only=False)
            count = np.diff(keys.offsets.to_numpy())
            own = np.repeat(ids, count)
            yield from sender.add(keys.flatten().to_numpy(zero_copy_only=False).view(U64), own, own)
        yield from sender.flush()

    return stars(rows.select("doc_id", "lead").mapInArrow(send, blobs.SCHEMA))


def all_stars(docs: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """Stars of all signatures whose documents are not yet in one component.

    ``known`` (doc_id, component, copy) names the components found so far; copies send nothing. Rows it cannot hold are read in place.
    """
    n_buckets = blobs.buckets_of(docs)
    seen = bitmap.build(known.select("doc_id"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = blobs.Sender(n_buckets)
        for b in batches:
            if b.num_columns == 2:
                b = b.filter(pa.array(~seen.might_hold(b.column(0).to_numpy(zero_copy_only=False))))
            ids, component = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, b.num_columns - 1 if b.num_columns == 3 else 0))
            for d in documents(b.column(1), lower=True):
                key, of = _keys(*shingle_sets(d, width), percent)
                yield from sender.add(key, ids[d.rows][of], component[d.rows][of])
        yield from sender.flush()
        blobs.release()

    again = seen.narrow(docs).join(known, "doc_id", "left").where("copy IS NULL OR NOT copy").select("doc_id", "text", F.coalesce("component", "doc_id").alias("component"))
    return stars(docs.mapInArrow(send, blobs.SCHEMA).unionAll(again.mapInArrow(send, blobs.SCHEMA)))


def stars(sent: DataFrame) -> DataFrame:
    """leader, member, leader_component, component: for each signature of several components its least document and each other one."""

    def start() -> tuple:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                pairs = np.unique(np.concatenate(held), axis=0)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(4)], names=["leader", "member", "leader_component", "component"])

        def meet(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, doc, component = arrays
            lower, key = (key & U64(1)) == 0, key >> U64(1)
            order = np.lexsort((doc, key))
            key, doc, lower, component = key[order], doc[order], lower[order], component[order]
            begin, n = blobs.runs(key)
            if not len(begin):
                return
            use = np.logical_or.reduceat(lower, begin)  # sets of the upper band meet where it is the lower one
            use &= np.minimum.reduceat(component, begin) != np.maximum.reduceat(component, begin)
            begin, n = begin[use], n[use]
            if len(begin):
                lead = np.repeat(begin, n)
                at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                lead, at = lead[doc[lead] != doc[at]], at[doc[lead] != doc[at]]
                held.append(np.unique(np.stack([doc[lead], doc[at], component[lead], component[at]], axis=1), axis=0))
            if sum(map(len, held)) >= blobs.FLUSH_ENTRIES:
                yield from flush()

        return meet, flush

    return blobs.reduce_buckets(sent, ["<u8", "<i8", "<i8"], start, "leader long, member long, leader_component long, component long").distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of ``sets``."""
    m = len(sets)
    every = np.concatenate(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    begin, n = blobs.runs(every[order])
    column = np.repeat(np.cumsum(n > 1) - 1, n)
    shared = np.repeat(n > 1, n)
    column, row = column[shared], of[order][shared]
    both = np.zeros((m, m), dtype=np.float32)
    at = 0
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        end = int(np.searchsorted(column, low + COLUMNS))
        block = np.zeros((m, COLUMNS), dtype=np.float32)
        block[row[at:end], column[at:end] - low] = 1
        both += block @ block.T
        at = end
    return both


def linked(sets: list[np.ndarray], component: np.ndarray, percent: int) -> np.ndarray:
    """For each set the first set of its component, under the known components and verified links between them."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float32)
    both = _common(sets)
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    link |= component[:, None] == component[None, :]
    name = np.arange(m)
    while True:
        new = np.where(link, name[None, :], m).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == name).all():
            return name
        name = new


def _sets(group: pa.Table, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows with a set, and their sets."""
    rows, sets = [], []
    for d in documents(group.column("text"), lower=True):
        h, first = shingle_sets(d, width)
        some = np.flatnonzero(np.diff(first))
        rows.append(d.rows[some])
        sets += [h[first[i] : first[i + 1]] for i in some]
    return np.concatenate(rows), sets


def _verified_tiles(docs: DataFrame, tiles: DataFrame, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """a, b of ``work`` on each tile (leader, i, j, with member and component), with the members' texts."""
    texts = bitmap.build(tiles.select(F.col("member").alias("doc_id")).distinct()).narrow(docs).select(F.col("doc_id").alias("member"), "text")
    return tiles.join(texts, "member").groupBy("leader", "i", "j").applyInArrow(work, "a long, b long")


def star_links(docs: DataFrame, star: DataFrame, width: int, percent: int, tile: int = TILE) -> DataFrame:
    """a, b: members that are similar to the leader of their star."""
    sizes = star.groupBy("leader").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    d = star.join(sizes, "leader").select("leader", F.lit(0).alias("i"), F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("j"), "member")
    d = cut(d.unionAll(sizes.select("leader", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.col("leader").alias("member"))))

    def verify(group: pa.Table) -> pa.Table:
        rows, sets = _sets(group, width)
        ids = group.column("member").to_numpy()[rows]
        lead = int(group.column("leader")[0].as_py())
        found = np.zeros(len(ids), bool)
        if len(ids):
            size = np.array([len(s) for s in sets])
            every, first = np.concatenate(sets), np.cumsum(size) - size
            for k in np.flatnonzero(ids == lead):
                common = np.add.reduceat(np.isin(every, sets[k]).astype(np.int64), first)
                found |= 100 * common >= percent * (size + len(sets[k]) - common)
        a = np.unique(ids[found & (ids != lead)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(np.full(len(a), lead, np.int64))})

    return _verified_tiles(docs, d, verify)


def family_links(docs: DataFrame, star: DataFrame, width: int, percent: int, tile: int = TILE) -> DataFrame:
    """a, b: documents of different components that verified links join, enough to span each tile of each family."""
    members = star.select("leader", "member", "component").unionAll(star.select("leader", F.col("leader").alias("member"), F.col("leader_component").alias("component")).distinct())
    largest = members.groupBy("leader", "component").agg(F.count("*").alias("m")).groupBy("leader").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("inside"), F.sum("m").alias("m"))
    d = members.join(largest.select("leader", "main", F.ceil(F.col("inside") / tile).cast("int").alias("na"), F.ceil((F.col("m") - F.col("inside")) / tile).cast("int").alias("nb")), "leader")
    d = d.withColumn("outside", F.col("component") != F.col("main"))
    d = d.withColumn("block", F.pmod(F.xxhash64("member"), F.when(F.col("outside"), F.col("nb")).otherwise(F.col("na"))).cast("int"))
    d = d.withColumn("t", F.explode(F.expr("""
        CASE WHEN outside
        THEN concat(transform(sequence(0, na - 1), k -> named_struct('i', block, 'j', nb + k)), transform(filter(sequence(0, nb - 1), k -> k <> block), k -> named_struct('i', least(block, k), 'j', greatest(block, k))))
        ELSE transform(sequence(0, nb - 1), k -> named_struct('i', k, 'j', nb + block)) END""")))
    d = cut(d.select("leader", "t.i", "t.j", "member", "component"))

    def verify(group: pa.Table) -> pa.Table:
        rows, s = _sets(group, width)
        ids, component = (group.column(c).to_numpy()[rows] for c in ("member", "component"))
        if len(s) == 2:
            common = len(np.intersect1d(s[0], s[1], assume_unique=True))
            name = np.array([0, 0 if 100 * common >= percent * (len(s[0]) + len(s[1]) - common) else 1])
        else:
            name = linked(s, component, percent) if len(s) else np.zeros(0, np.int64)
        own = np.flatnonzero(component != component[name])
        return pa.table({"a": pa.array(ids[own], pa.int64()), "b": pa.array(ids[name[own]], pa.int64())})

    return _verified_tiles(docs, d, verify)


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = cut(set_rows(d, width, percent))
    d = d.where("doc_id IS NOT NULL")
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    names = known.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    same = cut(known.join(names, ["n_shingles", "s1", "s2"]).select("doc_id", "rep").where("doc_id <> rep").distinct())
    several = known.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "s1", "s2")).alias("x"), F.max(F.struct("n_shingles", "s1", "s2")).alias("y")).where("x <> y").select("doc_id")
    copies = cut(same.select("doc_id").distinct().join(several, "doc_id", "left_anti"))
    alone = known.join(copies, "doc_id", "left_anti")
    star = cut(lead_stars(alone))
    links = star_links(d, star, width, percent).unionAll(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    early = cut(components(links))
    marked = early.withColumnsRenamed({"node": "doc_id"}).join(copies.withColumn("copy", F.lit(True)), "doc_id", "left").select("doc_id", "component", F.coalesce("copy", F.lit(False)).alias("copy"))
    star = cut(all_stars(d, cut(marked), width, percent))
    late = family_links(d, star, width, percent)
    for c in ("a", "b"):
        late = late.join(early.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component")), c, "left").withColumn(c, F.coalesce(f"{c}_component", c)).drop(f"{c}_component")
    late = components(late)
    out = rows.join(early, rows.doc_id == early.node, "left").withColumn("c", F.coalesce("component", "doc_id")).select("doc_id", "n_shingles", "c")
    out = out.join(late, out.c == late.node, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "c").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_SETS = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM w)"""
ORACLE_SQL = f"""{_SETS}, n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, n_shingles, unnest(s) AS g FROM s JOIN n USING (doc_id)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n_shingles) AS na, any_value(b.n_shingles) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c WHERE 100 * k >= {PERCENT} * (na + nb - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n_shingles, (SELECT min(b) FROM r WHERE r.a = n.doc_id) AS component_id FROM n
"""
