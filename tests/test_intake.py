"""Files in two batches, restarts, dead letters, listings and deletions; pages; caches against plain Python."""

import os
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from clausework.operators import caches
from clausework.operators import portfolio as pf
from clausework.sources import readers
from clausework.streaming.intake import EmptyRequestError, Portfolio


def put(folder, **files):
    for name, content in files.items():
        with open(os.path.join(folder, name.replace("__", ".")), "wb") as f:
            f.write(content)


def test_intake(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    home = Portfolio(spark, str(tmp_path / "home"), buckets=3)
    run = lambda: home.take_in(folder, str(tmp_path / "check"), lambda b: {"pages": [{"text": b.decode()}, {"text": ""}, {"text": "two"}]}).awaitTermination()
    put(folder, a__txt=b"One \xff contract", b__MD=b"Another", c__exe=b"no", d__txt=b"", e__pdf=b"page", f__pdf=b"\xff\xfe")
    run()
    first = {r.filename: r for r in home.contracts.read().collect()}
    assert {k: r.text for k, r in first.items()} == {"a.txt": "One  contract", "b.MD": "Another", "e.pdf": "page\n\ntwo"}
    letters = {os.path.basename(r.path): r.reason for r in home.letters.read().collect()}
    assert letters["c.exe"] == "unsupported kind of file: .exe" and letters["f.pdf"].startswith("cannot be read") and len(letters) == 2
    run()  # nothing new
    put(folder, g__txt=b"Another", h__txt=b"Third")
    run()
    now = {r.contract_id: r.filename for r in home.contracts.read().collect()}
    assert len(now) == 4 and "Third" in {r.text for r in home.contracts.read().collect()}
    third = next(k for k, v in now.items() if v == "h.txt")
    listing = home.listing(spark.createDataFrame([(third, "X"), (third, "X"), (third, "Y")], "contract_id string, label string"), spark.createDataFrame([(third, 60, "HIGH")], "contract_id string, score int, level string"))
    rows = {r.contract_id: tuple(r)[2:] for r in listing.collect()}
    assert rows.pop(third) == ("analyzed", 3, 2, 60, "HIGH") and set(rows.values()) == {("uploaded", 0, 0, None, None)}
    with pytest.raises(EmptyRequestError):
        home.delete()
    with pytest.raises(EmptyRequestError):
        home.delete([])
    assert home.delete([third, "nobody"]) == 1 and home.delete(["nobody"]) == 0
    assert home.delete(everything=True) == 3 and home.contracts.read().count() == 0
    with pytest.raises(EmptyRequestError):
        home.delete(everything=True)


def test_pages(spark, tmp_path):
    put(str(tmp_path), a__txt="Eins\f\fDrei".encode(), b__txt=b"-", c__bad=b"x", none__txt=b"")

    def parse(b):
        if b == b"x":
            raise ValueError("broken")
        return {"metadata": {"Title": "T", "n": 3, "none": None}, "pages": [{"text": t, "width": 612, "height": 792.5} for t in b.decode().split("\f") if b != b"-"]}

    pages = readers.read_pages(spark, str(tmp_path), parse)
    got = sorted((os.path.basename(r.path), r.page_number or 0, r.total_pages, r.width, r.height, r.text, r.error) for r in pages.collect())
    assert got == [("a.txt", 1, 3, 612.0, 792.5, "Eins", None), ("a.txt", 2, 3, 612.0, 792.5, "", None), ("a.txt", 3, 3, 612.0, 792.5, "Drei", None), ("b.txt", 0, 0, None, None, None, None), ("c.bad", 0, 0, None, None, None, "ValueError: broken")]
    whole = {os.path.basename(r.path): r for r in readers.whole_documents(pages).collect()}
    assert (whole["a.txt"].text, whole["a.txt"].total_pages, whole["a.txt"].metadata) == ("Eins\n\nDrei", 3, {"Title": "T", "n": "3", "none": None})
    assert whole["b.txt"].text == "" and whole["c.bad"].error == "ValueError: broken"
    assert [r.text for r in readers.read_pages(spark, str(tmp_path), pattern="a*").orderBy("page_number").collect()] == ["Eins", "", "Drei"]


def plain(log, size, ttl):
    """Hits of one cache, by the definition."""
    held, out = OrderedDict(), {}
    for n, k, at, keep in log:
        hit = k in held and (ttl is None or at - held[k] < ttl)
        out[n] = hit
        if hit:
            held.move_to_end(k)
            continue
        held.pop(k, None)
        if keep:
            if size is not None and len(held) >= size:
                held.popitem(last=False)
            held[k] = at
    return out


@pytest.mark.parametrize(("size", "ttl", "shards"), [(3, None, 1), (5, 40.0, 1), (None, 25.0, 1), (2, 30.0, 4)])
def test_caches(spark, size, ttl, shards):
    rng = random.Random(6)
    log = [(n, f"k{int(rng.paretovariate(0.8)) % 20}", float(n // 2), rng.random() < 0.8) for n in range(400)]
    df = spark.createDataFrame(log, "n long, k string, at double, good boolean").withColumn("hit", F.lit("clash")).repartition(5)
    got = caches.replay(df, "k", "at", "n", size, ttl, shards, keep=F.col("good")).collect()
    want = {}
    for shard in range(shards):
        mine = {r.n for r in got if r.shard == shard}
        want |= plain([x for x in log if x[0] in mine], size, ttl)
    assert {r.n: r.hit for r in got} == want
    rates = caches.hit_rates(caches.replay(df, "k", "at", "n", size, ttl, shards, keep=F.col("good"))).collect()
    assert sum(r.accesses for r in rates) == 400 and sum(r.hits for r in rates) == sum(want.values())


def test_cache_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 2.0), (3, "a", None), (4, "a", 1.0), (5, "a", 1.0)], "n long, k string, at double")
    assert {r.n: r.hit for r in caches.replay(df, "k", "at", "n", 5).collect()} == {1: False, 2: False, 3: False, 4: False, 5: True}
    assert caches.replay(df.where("n < 0"), "k", "at", "n", 5).count() == 0
    with pytest.raises(ValueError, match="one place"):
        caches.replay(df, "k", "at", "n", 0)


def test_unknown_contracts(spark):
    contracts = spark.createDataFrame([(1,), (2,)], "contract_id long")
    pf.require(contracts, 1, 2)
    with pytest.raises(pf.UnknownContractError, match="7"):
        pf.require(contracts, 1, 7)
