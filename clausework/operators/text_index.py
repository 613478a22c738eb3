"""A stored index of item texts for BM25 searches, kept up to date by item id.

Items are dealt into blocks by a hash of their id, of about ``BLOCK`` items each. ``items`` has one row for each id, ``postings`` one for each term of a block, with
the ids, frequencies, lengths and kinds of the items that hold it, and ``heads`` a term's count of items in a block, greatest frequency and least
length, from which no item of the block can score more. Blocks lie in shards, which are the folders of all three tables; an update rewrites the
shards of its items alone.

A search has two parts. Items with a rare word of a query, one of ``RARE`` items at most, are scored outright. Of all others a query's frequent words alone
decide, so each set of frequent words is searched once, whatever number of queries has it, and its k best stand for all of them: a rare word only adds to a
score, so an item that k others precede by frequent words is preceded by these in the end, too. For such a set heads are read first: a block's bound is the
sum of its terms' bounds. The most promising blocks are scored, and the kth score found there leaves only blocks whose bound reaches it. Scores are those
of ``search.bm25``: the numbers of items and words are those of the whole table, whatever kind is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.functions import text
from clausework.operators.search import K1, MOST_TERMS, B
from clausework.plans.lineage import cut, drop
from clausework.sources.keyed import KeyedTable

BLOCK, SHARDS = 4096, 64
FIRST_BLOCKS = 2
RARE = 256
_ITEM = "id string, kind string, text string, payload string, dl int, block int"


class TextIndex:
    """``blocks`` is settled when the index is made: about the number of items to come over ``BLOCK``."""

    def __init__(self, spark: SparkSession, path: str, blocks: int = 256, shards: int = SHARDS):
        self.spark, self.path, self.blocks = spark, path, blocks
        self.shards = min(shards, blocks)
        self.items = _Items(spark, f"{path}/items", blocks, self.shards)

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int")

    def upsert(self, items: DataFrame, order: str | None = None) -> int:
        """Put items (id, kind, text, payload) in place of those with their ids; of equal ids the last by ``order``. Gives the number of shards written."""
        tokens = text.tokens(F.coalesce("text", F.lit("")))
        rows = items.where("id IS NOT NULL").withColumns({"block": self._block(), "dl": F.size(tokens)})
        rows = rows if "payload" in items.columns else rows.withColumn("payload", F.lit(None).cast("string"))
        n = self.items.upsert(rows, order)
        self._refresh(self.items.touched)
        return n

    def delete(self, ids: DataFrame) -> int:
        n = self.items.delete(ids.select(F.col("id").cast("string").alias("id")))
        self._refresh(self.items.touched)
        return n

    def _refresh(self, shards: list[int]) -> None:
        """Write the shards' postings anew from their items, dealt once by block, and their heads from the postings."""
        if not shards:
            return
        items = self.items.part(shards).select("block", "id", "kind", "dl", "text").repartition("block")
        terms = items.select("block", "id", "kind", "dl", F.explode(text.tokens(F.coalesce("text", F.lit("")))).alias("term"))
        counted = terms.groupBy("block", "term", "id").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"), F.first("kind").alias("kind"))
        blocked = counted.groupBy("block", "term").agg(F.array_sort(F.collect_list(F.struct("id", "tf", "dl", "kind"))).alias("entries"))
        self._write(blocked.withColumn("shard", F.pmod("block", F.lit(self.shards)).cast("int")), "postings")
        # shards whose last item went get no rows, so their folders must go
        for shard in set(shards) - {r.bucket for r in self.items.buckets_of(shards).collect()}:
            for name in ("postings", "heads"):
                drop(self.spark, f"{self.path}/{name}/shard={shard}")
        new = self._read("postings").where(F.col("shard").isin(shards))
        heads = new.select("term", "block", F.size("entries").cast("long").alias("df"), F.array_max("entries.tf").alias("max_tf"), F.array_min("entries.dl").alias("min_dl"), "shard")
        self._write(heads, "heads")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.sortWithinPartitions("shard", "term").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        shape = "term string, block int, " + ("entries array<struct<id:string,tf:int,dl:int,kind:string>>" if name == "postings" else "df long, max_tf int, min_dl int") + ", shard int"
        return self.spark.read.schema(shape).parquet(f"{self.path}/{name}")

    def search(self, queries: DataFrame, k: int = 16, kind: str | None = None, first_blocks: int = FIRST_BLOCKS, rare: int = RARE) -> DataFrame:
        """query_id, id, score, rank of the k best items (of a kind) for each query (query_id, text); words of more than ``rare`` items are frequent."""
        sizes = self.items.read().agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
        terms = cut(queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.coalesce("text", F.lit(""))))).alias("term")))
        wanted = terms.select("term").distinct()
        wanted = F.broadcast(wanted) if wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS else wanted
        heads = cut(self._read("heads").join(wanted, "term", "left_semi").drop("shard"))
        idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        counted = heads.groupBy("term").agg(F.sum("df").alias("df")).crossJoin(F.broadcast(sizes)).select("term", idf.alias("idf"), "avgdl", (F.col("df") > rare).alias("often"))
        known = cut(terms.join(counted, "term"))
        often, seldom = (known.where(c).drop("often") for c in ("often", "NOT often"))
        # queries by the set of their frequent words, for which one of them stands
        words = often.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("words"))
        of = cut(words.join(words.groupBy("words").agg(F.min("query_id").alias("lead")), "words").select("query_id", "lead"))
        sets = cut(often.join(of.select(F.col("lead").alias("query_id")).distinct(), "query_id"))
        common = self._best_of_sets(sets, heads, kind, k, first_blocks).withColumnRenamed("query_id", "lead").join(of, "lead").select("query_id", "id", "score")
        return _best(common.unionByName(self._with_rare(seldom, often, kind)).groupBy("query_id", "id").agg(F.max("score").alias("score")), k)

    def _best_of_sets(self, known: DataFrame, heads: DataFrame, kind: str | None, k: int, first_blocks: int) -> DataFrame:
        bound = F.sum(F.col("idf") * _part(F.col("max_tf"), F.col("min_dl"))).alias("bound")
        # the bound may differ from a score of equal parts in its last places
        bounds = cut(known.join(heads.select("term", "block", "max_tf", "min_dl"), "term").groupBy("query_id", "block").agg(bound).withColumn("bound", F.col("bound") + 1e-6))
        w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = cut(bounds.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first_blocks).select("query_id", "block"))
        found = cut(self._score(known, first, kind, k))
        floor = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        rest = bounds.join(first, ["query_id", "block"], "left_anti").join(floor, "query_id", "left").where("floor IS NULL OR bound >= floor").select("query_id", "block")
        return _best(found.drop("rank").unionByName(self._score(known, rest, kind, k).drop("rank")), k)

    def _entries(self, terms: DataFrame, kind: str | None) -> DataFrame:
        """term, block, id, tf and dl of the items (of a kind) that hold some terms; other terms go where they are read."""
        rows = self._read("postings").drop("shard").join(terms.select("term").distinct(), "term", "left_semi").select("term", "block", F.inline("entries"))
        return (rows if kind is None else rows.where(F.col("kind") == kind)).drop("kind")

    def _score(self, known: DataFrame, where: DataFrame, kind: str | None, k: int) -> DataFrame:
        asked = where.join(known, "query_id").groupBy("term", "block").agg(F.collect_list(F.struct("query_id", "idf", "avgdl")).alias("asks"))
        hits = self._entries(known, kind).join(asked, ["term", "block"]).select("id", "block", "tf", "dl", F.inline("asks"))
        scored = hits.groupBy("query_id", "id", "block").agg(F.sum(F.col("idf") * _part(F.col("tf"), F.col("dl"))).alias("score")).withColumn("score", F.round("score", 9)).where("score > 0")
        return _best(scored.select("query_id", "id", "score"), k)

    def _with_rare(self, seldom: DataFrame, often: DataFrame, kind: str | None) -> DataFrame:
        """query_id, id and score of every item with a rare word of a query."""
        part = (F.col("idf") * _part(F.col("tf"), F.col("dl"))).alias("part")
        hits = cut(self._entries(seldom, kind).join(seldom, "term").select("query_id", "id", part))
        others = hits.select("query_id", "id").distinct().join(often, "query_id").join(self._entries(often, kind), ["term", "id"]).select("query_id", "id", part)
        return hits.unionByName(others).groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score")).where("score > 0")


def _part(tf: Column, dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _names() -> list[str]:
    return [x.split()[0] for x in _ITEM.split(", ")]


class _Items(KeyedTable):
    """Items by id, in the folders of their blocks' shards."""

    def __init__(self, spark: SparkSession, path: str, blocks: int, shards: int):
        super().__init__(spark, path, ["id"], _ITEM, shards)
        self.blocks = blocks

    def bucket(self) -> Column:
        return F.pmod(F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int"), F.lit(self.buckets)).cast("int")
