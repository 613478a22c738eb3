"""The keyed store, the graph store and the text index against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clausework.operators import search as se
from clausework.operators.text_index import TextIndex
from clausework.sources.keyed import DuplicateKeyError, GraphStore, KeyedTable

SCHEMA = "k string, j long, v string, n int"


def rows_of(table):
    return sorted((r.k or "", r.j if r.j is not None else -1, r.v, r.n) for r in table.read().collect())


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "j"], SCHEMA, buckets=5)
    assert table.read().count() == 0 and table.delete(spark.createDataFrame([("a", 1)], "k string, j long")) == 1
    rng, want = random.Random(1), {}
    for turn in range(4):
        rows = [(rng.choice("abcd") if rng.random() < 0.9 else None, rng.randrange(6) if rng.random() < 0.9 else None, f"{turn}-{i}", i) for i in range(25)]
        table.upsert(spark.createDataFrame(rows, SCHEMA).withColumn("other", F.lit("x")), "n")
        want |= {(r[0], r[1]): r for r in rows}
        assert rows_of(table) == sorted((r[0] or "", r[1] if r[1] is not None else -1, r[2], r[3]) for r in want.values())
        gone = [("a", turn), (None, None), ("zz", 9)]
        table.delete(spark.createDataFrame(gone, "k string, j long"))
        want = {k: r for k, r in want.items() if k not in gone}
        assert len(rows_of(table)) == len(want)
    keys = spark.createDataFrame([("b", 1), ("c", 2), ("zz", 1)], "k string, j long")
    assert {(r.k, r.j) for r in table.find(keys).collect()} == {("b", 1), ("c", 2)} & want.keys()
    assert table.upsert(table.read().limit(0)) == 0


def test_keyed_table_refuses_repeated_keys_and_keeps_what_it_has(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "j"], SCHEMA, buckets=3)
    table.upsert(spark.createDataFrame([("a", 1, "old", 0), ("b", 1, "old", 0)], SCHEMA))
    before = rows_of(table)
    with pytest.raises(DuplicateKeyError, match="'a', 7"):
        table.upsert(spark.createDataFrame([("a", 7, "x", 0), ("a", 7, "y", 1), ("b", 1, "new", 0)], SCHEMA))
    assert rows_of(table) == before


def test_a_failed_write_is_mended_by_the_same_write(spark, tmp_path, monkeypatch):
    import clausework.sources.keyed as keyed

    store = GraphStore(spark, str(tmp_path / "g"), buckets=3)
    e = spark.createDataFrame([("Party", "a", "A", 1, 1), ("Party", "b", "B", 2, 2)], "type string, id string, name string, contract_id long, ord int")
    t = spark.createDataFrame([("A", "must", "pay", 1, 0.5, {"z": "1", "y": "2"}, 1), ("A", "must", "pay", 2, 0.7, {}, 2), ("B", "strange-thing", "A", 2, None, None, 3)], "subject string, predicate string, object string, contract_id long, confidence double, properties map<string,string>, ord int")
    whole = keyed.KeyedTable.upsert

    def failing(self, rows, order=None):
        if self.path.endswith("edges"):
            raise OSError("lost")
        return whole(self, rows, order)

    monkeypatch.setattr(keyed.KeyedTable, "upsert", failing)
    with pytest.raises(OSError, match="lost"):
        store.store(e, t)
    assert store.nodes.read().count() == 2 and store.edges.read().count() == 0
    monkeypatch.setattr(keyed.KeyedTable, "upsert", whole)
    for _ in range(2):
        store.store(e, t)
        assert sorted((r.type, r.id, r.name) for r in store.all_nodes().fillna("").collect()) == [("Entity", "", "A"), ("Entity", "", "B"), ("Entity", "", "pay"), ("Party", "a", "A"), ("Party", "b", "B")]
        assert sorted((r.subject, r.edge_type, r.object, r.contract_id) for r in store.edges.read().collect()) == [("A", "HAS_OBLIGATION", "pay", 2), ("B", "STRANGE_THING", "A", 2)]
    nodes, edges = store.contract_graph(2)
    assert [r.name for r in nodes.collect()] == ["B"] and {(r.source, r.type, r.target) for r in edges.collect()} == {("A", "HAS_OBLIGATION", "pay"), ("B", "STRANGE_THING", "A")}
    store.delete_contract(2)
    assert store.edges.read().count() == 0 and [r.id for r in store.nodes.read().collect()] == ["a"] and store.ends.read().count() == 3


def scores(items, words):
    docs = {i: (t or "").lower().split() for i, (_, t) in items.items()}
    n, avg, out = len(docs), sum(map(len, docs.values())) / len(docs), {}
    for term in set(words.lower().split()):
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            if term in d:
                tf = d.count(term)
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
    return out


def test_text_index(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))
    items = {f"i{k}": ("entity" if k % 3 else "triple", text() if k != 5 else None) for k in range(300)}
    asked = [(q, " ".join(rng.sample(words, 3))) for q in range(8)] + [(8, "no such word"), (9, ""), (10, None), (11, "w1 w1 W1")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = TextIndex(spark, str(tmp_path / "i"), blocks=20, shards=4)
    frame = lambda d: spark.createDataFrame([(i, k, t) for i, (k, t) in d.items()], "id string, kind string, text string")
    index.upsert(frame(items))

    def check(kind=None, k=7):
        for first in (1, 50):
            got = {}
            for r in index.search(queries, k, kind, first_blocks=first).collect():
                got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
            for q, t in asked:
                all_scores = {i: round(s, 9) for i, s in scores(items, t or "").items() if kind is None or items[i][0] == kind}
                best = sorted(all_scores.items(), key=lambda x: (-x[1], x[0]))[:k]
                assert [(r, i) for r, i, _ in sorted(got.get(q, []))] == [(r + 1, i) for r, (i, _) in enumerate(best)], (q, t)
                assert all(abs(s - all_scores[i]) < 2e-9 for _, i, s in got.get(q, []))

    check()
    check("triple")
    change = {f"i{k}": ("triple", text()) for k in range(0, 300, 40)} | {"new": ("entity", "w1 w2 w1")}
    index.upsert(frame(change).unionAll(frame({"new": ("entity", "w9")})).withColumn("at", F.when(F.col("text") == "w9", 0).otherwise(1)), "at")
    items |= change
    check()
    gone = [f"i{k}" for k in range(0, 300, 7)]
    index.delete(spark.createDataFrame([(i,) for i in gone], "id string"))
    items = {i: x for i, x in items.items() if i not in gone}
    check("entity", 3)
    index.delete(index.items.read().select("id"))
    assert index.search(queries).count() == 0


def test_vectors_of_unequal_length_and_many_blocks(spark):
    rng = random.Random(5)
    rows = [(f"v{i}", [float(rng.randrange(-2, 3)) for _ in range(3 if i % 4 else 2)]) for i in range(60)] + [("n", None), ("x", [1.0, None, 2.0]), ("y", [float("nan")] * 3), ("v1", [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>")
    asked = vectors.where("id IN ('v1', 'v2', 'v4', 'n', 'y')").withColumnRenamed("id", "query_id")

    def cosine(x, y):
        n = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in y))
        return sum(a * b for a, b in zip(x, y, strict=True)) / n if n else None

    for own in (False, True):
        got = {}
        for r in se.vector_topk(vectors, asked, 5, own=own, query_block=2, row_block=7).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
        good = [(i, v) for i, v in rows if v and all(x is not None and x == x for x in v)]
        for q in ("v2", "v4"):
            e = dict(good)[q]
            want = sorted(((-round(c, 9), i) for i, v in good if len(v) == len(e) and (own or i != q) and (c := cosine(e, v)) is not None))[:5]
            assert [(i, s) for _, i, s in sorted(got[q])] == [(i, pytest.approx(-s, abs=1e-9)) for s, i in want]
        assert "n" not in got and "y" not in got
    assert se.vector_topk(vectors, asked.where("query_id = '-'"), 5).count() == 0


def test_frequent_words_are_scored_once_for_all_queries_that_have_them(spark, tmp_path, monkeypatch):
    items = {f"i{k:03}": ("entity" if k % 3 else "triple", f"the n{k // 2} " + ("inc" if k % 2 else "llc")) for k in range(200)}
    asked = [(q, f"the n{q} inc") for q in range(60)] + [(70, "the"), (71, "n5"), (72, "the nobody llc")]
    index = TextIndex(spark, str(tmp_path / "i"), blocks=6, shards=3)
    index.upsert(spark.createDataFrame([(i, k, t) for i, (k, t) in items.items()], "id string, kind string, text string"))
    queries, seen, whole = spark.createDataFrame(asked, "query_id long, text string"), [], TextIndex._best_of_sets

    def counting(self, known, *rest):
        seen.append(known.select("query_id").distinct().count())
        return whole(self, known, *rest)

    monkeypatch.setattr(TextIndex, "_best_of_sets", counting)
    for kind in (None, "entity"):
        got = {}
        for r in index.search(queries, 5, kind, rare=8).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id))
        for q, t in asked:
            own = {i: round(s, 9) for i, s in scores(items, t).items() if kind is None or items[i][0] == kind}
            assert sorted(got.get(q, [])) == [(n + 1, i) for n, i in enumerate(sorted(own, key=lambda i: (-own[i], i))[:5])], (q, t)
    assert seen == [3, 3]


def test_vectors_are_searched_where_they_are_and_equal_queries_once(spark):
    rng = random.Random(8)
    rows = [(f"v{i}", [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(q, rows[q % 3][1]) for q in range(90)], "query_id long, embedding array<double>")
    found = se.vector_topk(vectors, asked, 5, own=True, query_block=2, row_block=7)
    assert "CoGroups" not in found._jdf.queryExecution().executedPlan().toString()  # vectors were dealt out once for each block of queries
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q in range(90):
        e = rows[q % 3][1]
        length = math.hypot(*e)
        near = sorted((-round(sum(a * b for a, b in zip(e, v, strict=True)) / length / math.hypot(*v), 9) + 0.0, i) for i, v in rows if any(v))
        assert [i for _, i in sorted(got[q])] == [i for _, i in near[:5]]
