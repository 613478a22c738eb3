"""The contract engine against published behaviour on small fixtures."""

import math

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausework.functions import dims, scores, text
from clausework.operators import dependency as dep
from clausework.operators import knowledge as kg
from clausework.operators import label_sets as ls
from clausework.operators import portfolio as pf
from clausework.operators import providers, risk, search
from clausework.sources import readers, sinks

COLUMNS = "contract_id long, clause_index long, label string, category string, confidence double, text string"


def clauses(spark, labels, contract=1, words="Licensee shall pay", confidence=0.85):
    return spark.createDataFrame([(contract, i, x, "c", confidence, words) for i, x in enumerate(labels)], COLUMNS)


def one(spark, expression, **columns):
    d = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return d.select(expression.alias("x")).first().x


def test_rule_counts():
    kinds = [r[2] for r in dims.DEPENDENCY_RULES]
    assert [kinds.count(k) for k in ("REQUIRES", "CONFLICTS_WITH", "MITIGATES", "RESTRICTS", "MODIFIES", "DEPENDS_ON")] == [22, 8, 9, 10, 12, 12]
    assert sum(r[4] for r in dims.DEPENDENCY_RULES) == 9 and sum(r[5] for r in dims.DEPENDENCY_RULES) == 24
    assert len(dims.LABELS) == 40 and sum(r[4] is not None for r in dims.LABELS) == 8 and sum(r[3] for r in dims.LABELS) == 11
    assert sum(len(p) for p in dims.LABEL_PATTERNS.values()) == 169 and [r[0] for r in dims.LABELS if r[5]].__len__() == 10


def test_empty_contract_scores_45(spark):
    contracts = spark.createDataFrame([(1,)], "contract_id long")
    found = risk.findings(clauses(spark, []), contracts)
    assert tuple(risk.risk_scores(found, contracts).first()) == (1, 45, "MEDIUM")
    assert tuple(risk.risk_scores(found.where("false"), contracts).first()) == (1, 0, "LOW")


@pytest.mark.parametrize(("score", "band"), [(24, "LOW"), (25, "MEDIUM"), (49, "MEDIUM"), (50, "HIGH"), (74, "HIGH"), (75, "CRITICAL")])
def test_bands(spark, score, band):
    assert one(spark, scores.risk_band(F.col("s")), s=score) == band


def test_truncation(spark):
    contracts = spark.createDataFrame([(1,)], "contract_id long")
    found = spark.createDataFrame([(1, "present", "HIGH", 1.0)] * 5 + [(1, "present", "LOW", 1.0)] * 4, "contract_id long, kind string, severity string, confidence double")
    assert risk.risk_scores(found, contracts).first().score == 57


def test_mutual_wording(spark):
    d = risk.present_findings(clauses(spark, dims.LIABILITY_LABELS, words="Neither  party is liable"))
    assert {r.label: r.severity for r in d.collect()} == {"Uncapped Liability": "INFO", "Liquidated Damages": "MEDIUM", "Cap On Liability": "HIGH"}


@pytest.fixture(scope="module")
def whole(spark):
    nodes = clauses(spark, [r[0] for r in dims.LABELS])
    return nodes, dep.graph(dep.edges(nodes)).cache()


def test_full_graph(spark, whole):
    nodes, g = whole
    assert g.count() == 75 and g.select("u").union(g.select("v")).distinct().count() == 39
    conflicts, missing, loops = dep.contradictions(g), dep.missing_requirements(nodes), dep.cycles(g)
    assert conflicts.count() == 8 and missing.count() == 0
    assert sorted(r.length for r in loops.collect()) == [3, 3, 4, 4, 4, 4]
    assert dep.risk_adjustment(conflicts, missing, loops).first().adjustment == 40


def test_order_and_centrality(spark, whole):
    nodes, g = whole
    order = [r.label for r in ls.topological_order(nodes).orderBy("position").collect()]
    assert sorted(order) == sorted(r[0] for r in dims.LABELS)
    c = {r.label: r.centrality for r in dep.centrality(g, nodes).collect()}
    assert c["Document Name"] == 0 and max(c.values()) == c["License Grant"]
    b = {r.label: r.betweenness for r in ls.betweenness(nodes).collect()}
    assert all(0 <= x <= 1 for x in b.values()) and b["Document Name"] == 0


def test_topological_order_without_cycle(spark):
    nodes = clauses(spark, ["Revenue/Profit Sharing", "Expiration Date", "Effective Date", "Exclusivity"])
    order = [r.label for r in ls.topological_order(nodes).orderBy("position").collect()]
    assert order.index("Exclusivity") < order.index("Expiration Date") < order.index("Effective Date")


def test_measures_of_label_sets(spark):
    import random
    from itertools import permutations

    rng, names = random.Random(11), [r[0] for r in dims.LABELS]
    sets = {c: rng.sample(names, rng.randrange(1, 12)) for c in range(1, 25)}
    sets[30] = sets[3]
    d = spark.createDataFrame([(c, i, x, "c", 0.9, "") for c, xs in sets.items() for i, x in enumerate(xs)] + [(None, 0, names[0], "c", 0.9, ""), (40, 0, "unknown", "c", 0.9, "")], COLUMNS)
    part = {(r.contract_id, r.label): r.component for r in ls.components(d).collect()}
    between = {(r.contract_id, r.label): r.betweenness for r in ls.betweenness(d).collect()}
    order = {}
    for r in ls.topological_order(d.where("contract_id < 40")).orderBy("position").collect():
        order.setdefault(r.contract_id, []).append(r.label)
    for c, xs in sets.items():
        g = {(r[0], r[1]) for r in dims.DEPENDENCY_RULES} | {(r[1], r[0]) for r in dims.DEPENDENCY_RULES if r[4]}
        g = {e for e in g if set(e) <= set(xs)}
        reach = {x: {x} for x in xs}
        for _ in xs:
            for u, v in g:
                reach[u] |= reach[v]
                reach[v] |= reach[u]
        assert {x: part[c, x] for x in xs} == {x: min(reach[x]) for x in xs}
        far = {(s, s): (0, 1) for s in xs}
        for depth in range(1, len(xs)):
            for s in xs:
                for v in xs:
                    n = sum(far[s, u][1] for u, w in g if w == v and far.get((s, u), (None,))[0] == depth - 1)
                    if (s, v) not in far and n:
                        far[s, v] = (depth, n)
        total = dict.fromkeys(xs, 0.0)
        for s, v, t in permutations(xs, 3):
            if (s, t) in far and (s, v) in far and (v, t) in far and far[s, v][0] + far[v, t][0] == far[s, t][0]:
                total[v] += far[s, v][1] * far[v, t][1] / far[s, t][1]
        scale = (len(xs) - 1) * (len(xs) - 2)
        assert all(abs(between[c, x] - (total[x] / scale if scale else 0)) < 1e-9 for x in xs)
        assert order[c] == ls.order_of(xs, ls._Rules(spark).edges) and sorted(order[c]) == sorted(xs)
    assert len(part) == len(between) == sum(map(len, sets.values()))


def test_rounding_is_that_of_python(spark):
    import random

    rng = random.Random(2)
    values = [0.0, 0.05, 0.15, 0.25, 12.25, 12.35, 2.675, -0.25, -12.35, 1e15 + 0.3, 1e300, float("inf"), float("-inf"), 5e-324, 0.05 - 2**-60, 4503599627370495.5, 0.45000000000000001]
    values += [rng.randrange(-10**6, 10**6) / 40 for _ in range(5000)] + [rng.uniform(-1e4, 1e4) for _ in range(5000)] + [rng.randrange(10**9) / 20 * 2.0**-k for k in range(40)]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        got = [r.x for r in d.select("v", scores.round_half_even(F.col("v"), digits).alias("x")).collect()]
        assert got == [round(v, digits) for v in values]
    assert d.limit(1).select(scores.round_half_even(F.lit(float("nan"))).alias("x")).first().x != 0 and d.limit(1).select(scores.round_half_even(F.lit(None).cast("double")).alias("x")).first().x is None


def test_calibration_by_newton(spark):
    import math
    import random

    from clausework.operators import classify

    rng = random.Random(4)
    rows = [(s, rng.random() < 1 / (1 + math.exp(-4 * s + 1.5))) for s in (rng.uniform(-1, 2) for _ in range(4000))] + [(None, True), (0.5, None), (float("nan"), True)]
    d = spark.createDataFrame(rows, "s double, y boolean")
    r = classify.fit_platt(d, "s", "y").first()
    assert abs(r.a + 4) < 0.4 and abs(r.b - 1.5) < 0.3
    slope = classify.platt_sums(d.where("s IS NOT NULL AND NOT isnan(s) AND y IS NOT NULL").select("s", F.col("y").cast("double").alias("y")), r.a, r.b).first()
    assert abs(slope.g1) < 1e-6 and abs(slope.g0) < 1e-6
    assert tuple(classify.fit_platt(d.where("false"), "s", "y").first()) == (0.0, 0.0)
    assert tuple(classify.fit_platt(spark.createDataFrame([(1.0, True)], "s double, y boolean"), "s", "y").first()) == (0.0, 0.0)


def test_nested_documents(spark):
    from clausework.operators import reports

    d = clauses(spark, ["Non-Compete", "Governing Law", "License Grant"]).withColumn("category", F.when(F.col("label") != "Governing Law", F.lit("c")))
    docs = reports.documents(d, spark.createDataFrame([(1,), (2,), (2,)], "contract_id long"))
    rows = {r.contract_id: r for r in reports.paths(docs, labels="$.summary.labels_found", edge="$.interdependency.edges[0].target_label", worst="$.risk.findings[0].severity", other="$.summary.by_category[0].category", none="$.no.such").collect()}
    assert set(rows) == {1, 2} and (rows[1].labels, rows[2].labels) == ("3", "0") and rows[1].edge in ("Governing Law", "License Grant") and rows[2].edge is None
    assert rows[1].other == "Other" and rows[2].worst in ("HIGH", "CRITICAL") and rows[1]["none"] is None
    assert reports.documents(d.where("false"), spark.createDataFrame([], "contract_id long")).count() == 0


def test_documents_store_nothing_on_the_way(spark):
    from pathlib import Path

    from clausework.operators import reports

    rows = [(1, 0, "Anti-Assignment", "a", None, None), (1, 1, "not a label", None, 0.5, "t"), (2, 0, "not a label", "b", 0.9, "t"), (None, 0, "Anti-Assignment", "a", 0.9, "t")]
    clauses = spark.createDataFrame(rows, "contract_id long, clause_index long, label string, category string, confidence double, text string")
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(folder.iterdir())
    docs = reports.documents(clauses, spark.createDataFrame([(1,), (2,), (3,)], "contract_id long"))
    got = {r.contract_id: r for r in reports.paths(docs, n="$.summary.labels_found", central="$.interdependency.centrality_scores[0].centrality", advice="$.interdependency.recommendations[0].advice").collect()}
    assert set(folder.iterdir()) == before and set(got) == {1, 2, 3}
    assert got[1].n == "2" and float(got[1].central) == 0.0
    assert float(got[2].central) == 1.0 and got[2].advice == "Change with care: not a label"
    assert (got[3].n, got[3].central) == ("0", None)


def test_clause_extraction(spark):
    from clausework.operators import providers

    d = clauses(spark, ["Governing Law", "Own Label", "Insurance", "Parties"]).withColumn("confidence", F.when(F.col("label") == "Parties", 0.4).otherwise(0.9))
    asked = providers.extraction_prompts(d)
    prompts = {r.label: r.prompt for r in asked.collect()}
    assert set(prompts) == {"Governing Law", "Own Label", "Insurance"} and "obligations related to Own Label" in prompts["Own Label"] and dims.EXTRACTION_TASKS["Governing Law"] in prompts["Governing Law"]
    said = {"Governing Law": '```json\n{"values": [{"field": "law", "value": "Ohio", "confidence": 0.9}, {}], "entities": ["Ohio"]}\n```'.replace("\\n", "\n"), "Insurance": "none of it"}
    replies = asked.where(F.col("label").isin(list(said))).select(providers.prompt_key("none", F.col("prompt")).alias("prompt_key"), F.create_map(*[F.lit(x) for kv in said.items() for x in kv])[F.col("label")].alias("reply"))
    got = {r.label: r for r in providers.clause_extractions(d, replies).collect()}
    assert [tuple(v) for v in got["Governing Law"]["values"]] == [("law", "Ohio", 0.9), ("", "", 0.5)] and got["Governing Law"].entities == ["Ohio"] and got["Governing Law"].relationships == []
    assert got["Insurance"]["values"] == [] and got["Own Label"].entities == []
    assert [(r.label, r.field) for r in providers.key_findings(providers.extracted_values(providers.clause_extractions(d, replies))).collect()] == [("Governing Law", "law")]


def test_impact_depth(spark):
    names = ["Non-Compete", "Governing Law", "License Grant", "Expiration Date", "Effective Date"]
    g = dep.graph(dep.edges(clauses(spark, names)))
    got = {r.label: (r.depth, r.via) for r in dep.impact(g, spark.createDataFrame([(1, "Non-Compete")], "contract_id long, start string")).collect()}
    assert got == {"Governing Law": (1, "Non-Compete"), "License Grant": (1, "Non-Compete"), "Expiration Date": (1, "Non-Compete"), "Effective Date": (2, "Expiration Date")}


@pytest.mark.parametrize(("raw", "want"), [(0.30, 0.3952), (0.35, 0.4694), (0.40, 0.5449), (0.50, 0.6868), (0.80, 0.9310), (1.0, 0.9784)])
def test_platt(spark, raw, want):
    assert abs(one(spark, scores.platt(F.col("s")), s=raw) - want) < 1e-4


@pytest.mark.parametrize(("raw", "want"), [("LOW", 0.4), ("medium", 0.7), ("HIGH", 0.9), ("unknown", 0.7), ("0.85", 0.85)])
def test_confidence(spark, raw, want):
    assert one(spark, text.confidence(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("  The  Acme   Corp ", "Acme Corp"), ("the a an x", "x"), ("Theory", "Theory"), ("A Party", "Party")])
def test_normalize_name(spark, raw, want):
    assert one(spark, text.normalize_name(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "kind", "want"), [(' "Acme inc"', "Party", "Acme Inc."), ("Acme LLC", "Party", "Acme LLC"), ("by 3/7/2021 latest", "Temporal", "2021-03-07"), ("March 2021", "Temporal", "March 2021"), ("x inc", "Obligation", "x inc")])
def test_normalize_entity(spark, raw, kind, want):
    assert one(spark, text.normalize_entity(F.col("s"), F.col("k")), s=raw, k=kind) == want


def test_chunks():
    assert text.chunk_spans("x" * 500, 100, 10) == [(0, 100), (90, 190), (180, 280), (270, 370), (360, 460), (450, 500)]
    assert text.chunk_spans("x" * 3900) == [(0, 2000), (1800, 3800), (3600, 3900)]


@given(st.text(alphabet="ab. \n", max_size=900))
def test_chunks_cover(s):
    spans = text.chunk_spans(s, 100, 20)
    assert spans[0][0] == 0 and spans[-1][1] == len(s)
    assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False))


def test_split(spark):
    t = "Preamble of the agreement between both of us.\n1. First clause that is long enough to stay.\n(a) Second clause that is long enough, too.\nSection 3 Third clause that is long enough as well."
    assert len(one(spark, text.split_clauses(F.col("s")), s=t)) == 4


def test_queries_that_split_by_blank_lines_leave_section_marks_alone(spark, tmp_path):
    """An address at the head of a line reads like a section's number; the SQL of these queries divides by blank lines alone."""
    from clausework.plans import catalog

    long = "that goes on for long enough to be kept as a clause of its own, and then some."
    texts = [f"First part {long}\n70.32.29.134 second part {long}\nThird part {long}", f"No mark {long}\nNor here {long}", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("clause_split", "classify_contracts"):
        got = catalog.queries()[name](spark, str(tmp_path)).collect()
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(catalog.oracle_sql()[name]).fetchall()
        assert sorted(map(tuple, got)) == sorted(want), name
    assert len(one(spark, text.split_clauses(F.col("s")), s=texts[0])) == 2 and len(one(spark, text.split_clauses(F.col("s"), sections=False), s=texts[0].replace("\n", "\n\n"))) == 3


@pytest.mark.parametrize(("raw", "want"), [('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ("```\n[1]\n```", "[1]"), ('so {"a": {"b": 2}} it is', '{"a": {"b": 2}}'), ("none", "none")])
def test_fenced_json(spark, raw, want):
    assert one(spark, text.fenced_json(F.col("s")), s=raw) == want


def test_fusion(spark):
    a = spark.createDataFrame([(1, "id1", 1), (1, "id2", 2)], "query_id long, id string, rank int")
    b = spark.createDataFrame([(1, "id2", 1), (1, "id3", 2)], "query_id long, id string, rank int")
    got = [(r.id, r.score) for r in search.fuse(a, b).orderBy("rank").collect()]
    assert [x[0] for x in got] == ["id2", "id1", "id3"] and math.isclose(got[0][1], 0.5 / 62 + 0.5 / 61)


def test_running_average_and_best(spark):
    rows = [(i, "s", "p", "o", c, {f"k{i}": "v", "k": str(i)}) for i, c in enumerate((0.9, 0.5, 0.1))]
    d = spark.createDataFrame(rows, "ord int, subject string, predicate string, object string, confidence double, properties map<string,string>")
    assert abs(kg.dedup_triples_average(d).first().confidence - 0.4) < 1e-12
    assert kg.dedup_triples_best(d).first().properties == {"k0": "v", "k": "0", "k1": "v", "k2": "v"}


def test_leaders_are_not_transitive():
    import numpy as np

    from clausework.operators import similarity

    angle = np.radians([0, 30, 60])
    side = similarity._Side(np.stack([np.cos(angle), np.sin(angle)], axis=1))
    assert similarity._settle(side, np.ones(3, bool), 0.8)[1].tolist() == [0, 0, 2]


def test_canonical(spark):
    names = [("Beta", "Party"), ("Beta Inc.", "Party"), ("the Beta (Inc)", "Party")]
    d = spark.createDataFrame([(n, k, {}) for n, k in names], "name string, type string, p map<string,string>").withColumn("s", kg.canonical_score(F.col("name"), F.col("type"), F.col("p")))
    assert d.orderBy(F.desc("s")).first().name == "Beta Inc."


def test_gaps(spark):
    contracts = spark.createDataFrame([(1,), (2,)], "contract_id long")
    c = clauses(spark, dims.STANDARD_PROTECTIONS[:9])
    freq = {r.label: r.missing_pct for r in pf.gap_frequency(pf.gaps(c, contracts), contracts).collect()}
    assert freq["Change Of Control"] == 100 and freq["Insurance"] == 50
    assert {r.priority for r in pf.gap_recommendations(pf.gap_frequency(pf.gaps(c, contracts), contracts)).collect()} == {"HIGH", "MEDIUM"}


def test_providers(spark):
    reply = '```json\n{"entities": [{"name": "Acme", "type": "party", "confidence": "HIGH"}, {"name": "", "type": "x"}, {"name": "B", "type": "?", "confidence": "7"}], "relationships": [{"subject": "Acme", "predicate": "owns", "object": "B"}, {"subject": "", "predicate": "p", "object": "o"}]}\n```'
    d = spark.createDataFrame([(1, reply), (2, "no json")], "contract_id long, reply string").withColumn("parsed", providers.parse(F.col("reply")))
    assert [(r.name, r.type, r.confidence) for r in providers.parsed_entities(d).collect()] == [("Acme", "Party", 0.9)]
    assert [(r.subject, r.object, r.confidence) for r in providers.parsed_triples(d).collect()] == [("Acme", "B", 0.7)]
    q = spark.createDataFrame([(1, "who?"), (2, "what?")], "query_id long, text string")
    cache = spark.createDataFrame([(1, "me", 0.9)], "query_id long, answer string, confidence double")
    none = spark.createDataFrame([], "prompt_key string, reply string")
    got = {r.query_id: r.confidence for r in providers.answers(q, cache, none, q.select("query_id", F.lit("c").alias("context"))).collect()}
    assert got == {1: 0.9, 2: 0.0}
    filled = providers.compute_missing(q, none, providers.prompt_key("m", F.col("text")), F.col("text"), lambda xs: [x.upper() for x in xs])
    assert {r.reply for r in filled.collect()} == {"WHO?", "WHAT?"}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"good \xff text")
    (tmp_path / "b.md").write_text("other")
    assert [r.text for r in readers.read_texts(spark, str(tmp_path), "*.txt").collect()] == ["good  text"]
    got = readers.read_paged(spark, str(tmp_path), lambda b: b.decode().split(" "), "*").collect()
    assert {(r.total_pages, r.error is None) for r in got} == {(0, False), (1, True)}
    (tmp_path / "qa.json").write_text('{"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"question": "q", "answers": [{"text": " short "}, {"text": "an answer of more than twenty"}]}]}]}]}')
    assert readers.read_question_answers(spark, str(tmp_path / "qa.json")).count() == 1
    assert readers.read_calibration(spark, None) == (dims.PLATT_A, dims.PLATT_B)
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "z")], "id int, v string")
    assert {r.v for r in sinks.upsert(a, b, "id").collect()} == {"x", "z"} and sinks.delete(a, b, "id").count() == 1
    assert sinks.check_size(a, 1, 2) == "full" and sinks.check_size(a, 2, 9) == "warn"


def test_stream(spark, tmp_path):
    from clausework.streaming import incremental

    clauses(spark, ["Exclusivity"]).write.parquet(str(tmp_path / "in"))
    incremental.score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert incremental.latest(spark, str(tmp_path / "out")).first().score > 45


def test_plans(spark):
    from clausework.plans import catalog

    plan = catalog.queries()["classify_top1"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_chunk_breaks():
    s = "a" * 60 + ". " + "b" * 30 + "\n" + "c" * 30
    assert text.chunk_spans(s, 100, 10)[0] == (0, 62)  # a sentence's end comes before a later line's
    assert text.chunk_spans("a" * 30 + ". " + "b" * 100, 100, 10)[0] == (0, 100)  # none in the first half
    with pytest.raises(ValueError):
        text.chunk_spans("x" * 200, 100, 50)


def test_extracted(spark):
    from clausework.operators import providers as pv

    reply = 'x ```json\n{"entities": [{"name": "Acme", "type": "Party", "confidence": "high"}, {"name": "Acme", "type": "Party", "confidence": "low"}], "relationships": [{"subject": "Acme", "predicate": "owes", "object": "Bob", "confidence": "0.5"}]}\n```'
    rows = spark.createDataFrame([(1, "short"), (2, "silent"), (3, None)], "contract_id long, text string")
    replies = rows.select(pv.prompt_key("none", F.col("text")).alias("prompt_key"), F.when(F.col("contract_id") == 1, reply).alias("reply"))
    entities, triples = pv.extracted(rows, replies)
    assert [(r.contract_id, r.name, r.confidence) for r in entities.collect()] == [(1, "Acme", 0.9)]
    assert [(r.subject, r.predicate, r.object, r.confidence) for r in triples.collect()] == [("Acme", "owes", "Bob", 0.5)]
    from clausework.sources import sinks

    got = sinks.extraction_json(entities, triples, "2020-01-01T00:00:00").first()["json"]
    assert '"n_entities":1' in got and '"n_triples":1' in got and "2020-01-01" in got


def test_similar_and_duplicates(spark):
    from clausework.operators import knowledge as kg
    from clausework.operators import search as se

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, None)], "id long, embedding array<double>")
    asked = vectors.where("id IN (1, 3)").withColumnRenamed("id", "query_id")
    assert [(r.query_id, r.id, r.rank) for r in se.find_similar(vectors, asked, k=3, threshold=0.0).orderBy("rank").collect()] == [(1, 2, 1), (1, 3, 2)]
    assert [r.id for r in se.vector_topk(vectors, asked).orderBy("rank").collect()] == [2, 4]
    rows = [(f"e{i}", f"N{i}", "Party" if i % 2 else "Asset", [1.0, i // 10 * 5.0 + i % 10 * 1e-3], i) for i in range(60)]
    e = spark.createDataFrame(rows, "id string, name string, type string, embedding array<double>, ord int")
    kind = dict(zip([r[0] for r in rows], [r[2] for r in rows], strict=True))
    got = kg.cluster_kmeans(e).collect()
    assert len(got) == 60 and all(kind[r.id] == kind[r.leader_id] == r.type for r in got)
    assert all(r.id == r.leader_id for r in kg.cluster_kmeans(e.where("ord < 20")).collect())  # ten of a type: too few
    pairs = spark.createDataFrame([("a", "n", "Party", [1.0, 0.0], 0), ("b", "n", "Asset", [1.0, 0.01], 1), ("c", "n", "Party", [0.0, 1.0], 2)], e.schema)
    assert sorted((r.id, r.leader_id, r.n) for r in kg.find_duplicates(pairs, 0).collect()) == [("a", "a", 2), ("b", "a", 2)]


def test_cycles_are_those_of_the_rules(spark):
    from clausework.functions import dims
    from clausework.operators import dependency as dep

    labels = [r.label for r in dims.dim(spark, "dim_label").collect()]
    nodes = spark.createDataFrame([(1, x, i) for i, x in enumerate(labels)] + [(2, labels[0], 0)], "contract_id long, label string, clause_index int")
    g = dep.graph(dep.edges(nodes))
    adjacent = {}
    for r in g.where("contract_id = 1").collect():
        adjacent.setdefault(r.u, []).append(r.v)
    want = sorted(" -> ".join(c) for c in dep.simple_cycles(adjacent))
    got = dep.cycles(g).collect()
    assert want and sorted(r.cycle for r in got) == want and {r.contract_id for r in got} == {1}


def test_named_queries(spark):
    from clausework.sources import sinks

    assert sinks.run_named(spark, "SELECT id * :k AS x FROM given_ids WHERE id > 1", {"given_ids": spark.range(3)}, {"k": 5}).collect()[0].x == 10


def test_analysis_from_text(spark):
    from clausework.operators import analysis, reports

    law = " ".join(dims.LABEL_PATTERNS["Governing Law"]) + " and the governing law of this contract is that of Ohio"
    texts = [(1, f"{law}.\n\nshort\n\n{'zzzz qqqq xxxx ' * 10}\n\n{law} again."), (2, None), (3, ""), (None, law), (4, "x" * 60)]
    contracts = spark.createDataFrame(texts, "contract_id long, text string")
    found = analysis.classified(contracts).collect()
    assert {r.contract_id for r in found} == {1} and {r.clause_index for r in found if r["rank"] == 1} == {0, 2}
    assert all(r.label == "Governing Law" for r in found if r["rank"] == 1) and max(r["rank"] for r in found) <= 3
    docs = {r.contract_id: r for r in reports.paths(analysis.analyze(contracts), n="$.summary.labels_found", first="$.clauses[0].label", score="$.risk.score").collect()}
    assert set(docs) == {1, 2, 3, 4} and (docs[1].n, docs[1].first) == ("1", "Governing Law") and docs[2].n == "0" and docs[2].score == "45"
    assert analysis.analyze(contracts.where("contract_id < 0")).count() == 0


def test_trigram_vectors(spark):
    import hashlib

    texts = ["Acme, Inc.", "", "ab", "abc", None, "Äbcé 日本語", "aaaaaaaaaa", "a\nb\x00c\\d"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for buckets in (1, 7, 64, 128):
        got = [r.v for r in d.select(text.trigram_vector(F.col("t"), buckets).alias("v")).collect()]
        for t, v in zip(texts, got, strict=True):
            if t is None:
                assert v is None or all(x is None or x == 0 for x in v)
                continue
            want = [0.0] * buckets
            for i in range(len(t) - 2):
                want[int(hashlib.md5(t.lower()[i : i + 3].encode()).hexdigest()[:4], 16) % buckets] += 1
            assert v == want
    with pytest.raises(ValueError, match="buckets"):
        text.trigram_vector(F.col("t"), 129)
