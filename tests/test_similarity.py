"""Cosine joins and leader clustering by cells against plain Python, whatever the size of groups and samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.operators import knowledge as kg
from clausework.operators import similarity


def rows_of(seed, n=500, dim=6, centres=12, spread=0.12):
    """Rows around a few directions, in random order, with copies and one direction that a third of all share."""
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim))
    own = np.where(rng.random(n) < 0.33, 0, rng.integers(0, centres, n))
    v = at[own] + spread * rng.normal(size=(n, dim))
    v[7], v[99], v[200] = v[5], v[5], 3 * v[5]
    return [(i, f"e{i}", "AB"[i % 2], [float(x) for x in v[i]], int(o)) for i, o in enumerate(rng.permutation(n))]


def cosine(x, y):
    return float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))


def greedy(rows, t, kind):
    """The leader of every row, by the definition."""
    rows, leader = sorted(rows, key=lambda r: (r[4], r[1])), {}
    for i, r in enumerate(rows):
        if r[1] not in leader:
            leader[r[1]] = r[1]
            for x in rows[i + 1 :]:
                if x[1] not in leader and kind(x) == kind(r) and cosine(x[3], r[3]) >= t:
                    leader[x[1]] = r[1]
    return leader


SCHEMA = "n long, id string, type string, embedding array<double>, ord int"


@pytest.mark.parametrize(("group", "sample", "t"), [(4096, 2048, 0.9), (40, 64, 0.9), (8, 100, 0.95), (60, 16, 0.4)])
def test_leaders(spark, group, sample, t):
    rows = rows_of(1, 260)
    df = spark.createDataFrame(rows, SCHEMA)
    got = similarity.leader_clusters(df, F.col("type"), F.lit(t), group=group, sample=sample).collect()
    assert {r.id: r.leader_id for r in got} == greedy(rows, t, lambda r: r[2]) and len(got) == len(rows)


def test_leaders_in_a_chain(spark):
    """Each row is near the next one only, in an order that decides them one by one."""
    angle = np.arange(40) * 0.2
    rows = [(i, f"e{i:02}", "A", [float(np.cos(a)), float(np.sin(a))], i) for i, a in enumerate(angle)]
    got = similarity.leader_clusters(spark.createDataFrame(rows, SCHEMA), F.lit("x"), F.lit(0.975), group=5, sample=8).collect()
    assert {r.id: r.leader_id for r in got} == greedy(rows, 0.975, lambda r: 0)


def test_leaders_of_odd_rows(spark):
    rows = [(1, "a", "A", [1.0, 0.0], 5), (2, "b", "A", [1.0, 0.0], None), (3, "c", None, [1.0, 0.0], 1), (4, "d", "A", None, 2), (5, "e", "A", [0.0, 0.0], 3), (6, "f", "A", [1.0, float("nan")], 4), (7, "g", "A", [1.0], 0), (8, "h", None, [2.0, 0.1], 2), (9, None, "A", [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for group in (1, 100):
        got = {r.id: r.leader_id for r in similarity.leader_clusters(df, F.col("type"), F.lit(0.9), group=group).collect()}
        assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f", "g": "g", "h": "c"}
    assert similarity.leader_clusters(df.where("n < 0"), F.col("type"), F.lit(0.9)).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        similarity.leader_clusters(df, F.col("type"), F.lit(0.0))


@pytest.mark.parametrize(("group", "sample", "t", "block"), [(4096, 64, 0.9, None), (30, 64, 0.9, "type"), (10, 200, 0.97, None), (25, 40, 0.5, None)])
def test_pairs(spark, group, sample, t, block):
    rows = rows_of(2, 220)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("uid", F.lit("clash"))
    got = {(r.id_a, r.id_b): r.cosine for r in similarity.cosine_pairs(df, t, "n", block, group=group, sample=sample).collect()}
    want = {(a[0], b[0]): cosine(a[3], b[3]) for a in rows for b in rows if a[0] < b[0] and (block is None or a[2] == b[2]) and cosine(a[3], b[3]) >= t}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert similarity.cosine_pairs(df.where("n < 0"), t, "n", block).count() == 0


def test_pairs_compare_far_less_than_all(spark):
    rng = np.random.default_rng(3)
    at = rng.normal(size=(200, 32))
    v = at[rng.integers(0, 200, 4000)] + 0.05 * rng.normal(size=(4000, 32))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    compared = similarity.compared_rows(df, 0.9, group=200)
    assert compared < 4000 * 4000 / 10
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert similarity.cosine_pairs(df, 0.9, group=200).count() == int((np.triu(unit @ unit.T, 1) >= 0.9).sum())


def test_composed_resolution(spark):
    names = [("a", "Acme Inc.", "Party", 1), ("b", "Acme Inc", "Party", 2), ("c", "Zeta Holdings", "Party", 1), ("d", "Delaware", "Jurisdiction", 2)]
    e = spark.createDataFrame([(i, n, t, k, 0.9, {}, o) for o, (i, n, t, k) in enumerate(names)], "id string, name string, type string, contract_id long, confidence double, properties map<string,string>, ord int")
    t = spark.createDataFrame([(0, "a", "governed_by", "d", 0.6, {"x": "1"}, 1), (1, "b", "governed_by", "d", 0.8, {"y": "2"}, 2)], "ord int, subject string, predicate string, object string, confidence double, properties map<string,string>, contract_id long")
    e = kg.with_name_vectors(e)
    done = kg.resolve(e, t)
    assert {r.old_id: r.canonical_id for r in done.mapping.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert sorted(r.id for r in done.entities.collect()) == ["a", "c", "d"]
    assert [(r.subject, r.object, round(r.confidence, 9)) for r in done.triples.collect()] == [("a", "d", 0.7)]
    assert [(r.canonical_id, r.aliases) for r in done.aliases.collect()] == [("a", ["Acme Inc"])]
    assert done.totals.first().asDict() == {"original": 4, "resolved": 3, "reduction_rate": 0.25}
    done = kg.aggregate(e, t)
    (r,) = done.triples.collect()
    assert (r.subject, r.object, round(r.confidence, 9), r.properties) == ("a", "d", 0.9, {"y": "2"})
    total = done.totals.first()
    assert (total.source_contracts, total.original_triples, total.merged_triples, total.merged_entities) == (2, 2, 1, 3)
    assert [(x["type"], x["threshold"]) for x in total.thresholds] == [("Jurisdiction", 0.9), ("Party", 0.85)]
