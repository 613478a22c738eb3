import corpus_pipeline as cp
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES[:-1]:
        out.append(spark.createDataFrame(stage(spark, out[-1], SF).collect(), docs.schema))
    return out


def test_stages(spark, kept):
    for d in kept[1:]:
        assert d.columns == cp.COLUMNS
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[1] >= ids[2] >= ids[3] >= ids[4] and ids[0] > ids[2]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in ids[0] if labels.get(i) == 1]
    assert sum(i in ids[1] for i in good) >= 0.97 * len(good)
    from clausework.llm import partenum

    again = partenum.jaccard_components(kept[2], 5, 80)
    assert again.where("doc_id <> component_id").count() == 0


def test_run(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "source mixing", "best-fit packing"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_against_plain_python(spark):
    import random

    from tests.llm.test_operators import brute_join, prose

    rng = random.Random(41)
    rows = []
    for _ in range(12):
        base = prose(rng, 60, 10**6).split()
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) + 10, " ".join(w), "en", "s", 1))
    rows += [rows[3], rows[3], (3, None, None, None, None), (4, "", "en", "s", 0), (None, rows[0][1], "en", "s", 1), (None, rows[0][1], "en", "s", 1), (None, None, None, None, None)]
    named = [(r[0], r[1]) for r in rows if r[0] is not None]
    leads = {i for i, _, c in brute_join(named, 5, 80) if i == c}
    want = sorted([str(x) for x in {r for r in rows if r[0] in leads}] + [str(r) for r in rows if r[0] is None])
    got = cp.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_stages_take_odd_rows(spark):
    rows = [(None, "a b " * 60, "en", "s", 3), (None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "t", 0), (2, "", None, "t", 0), (3, "word " * 30_000, "en", "s", 9)]
    for odd in (rows, []):
        docs = spark.createDataFrame(odd, SCHEMA)
        for _, stage in cp.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), SCHEMA)
            assert docs.columns == cp.COLUMNS
        packed = cp.pack_sequences(spark, docs, SF).collect()
        assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) >= docs.count()
