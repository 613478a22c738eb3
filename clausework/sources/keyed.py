"""Tables with one row for each key, stored by buckets of the key: a write replaces only the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.functions import text
from clausework.plans.lineage import cut, drop, exists

BUCKETS = 64


class DuplicateKeyError(ValueError):
    """A write would have left two rows of one key."""


class KeyedTable:
    """Rows by ``keys`` under ``path``, as Parquet in folders of ``bucket``.

    A write is checked and, where there are rows already, worked out and cut first; then the touched buckets are overwritten as they are committed, each whole. A write that failed
    half-way is mended by writing the same rows again, which gives the same table. One writer at a time. Null is a key like any other.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.empty, self.schema, self.touched = spark.createDataFrame([], schema), schema, []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _exists(self) -> bool:
        return exists(self.spark, self.path)

    def _stored(self) -> DataFrame:
        if not self._exists():
            return self.empty.withColumn("bucket", F.lit(0))
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().select(self.empty.columns)

    def part(self, buckets: list[int]) -> DataFrame:
        """Rows of some buckets, whose folders alone are read."""
        return self._stored().where(F.col("bucket").isin(buckets)).select(self.empty.columns)

    def buckets_of(self, buckets: list[int]) -> DataFrame:
        """Those of ``buckets`` that have rows."""
        return self._stored().where(F.col("bucket").isin(buckets)).select("bucket").distinct()

    def find(self, keys: DataFrame) -> DataFrame:
        """Rows of these keys, from their buckets alone."""
        wanted = keys.select(*self.keys).distinct().withColumn("bucket", self.bucket())
        touched = [r.bucket for r in wanted.select("bucket").distinct().collect()]
        return self._same(self._stored().where(F.col("bucket").isin(touched)), wanted, "left_semi").select(self.empty.columns)

    def _same(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keys.select([F.col(c).alias(f"__{c}") for c in self.keys])
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in self.keys]
        return rows.join(k, on, how)

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Put ``rows`` in place of those with their keys, of equal keys the last by ``order``; without an order equal keys are an error.

        Gives the number of buckets written, which ``touched`` names. Rows are worked out twice: for their keys, then to be written.
        """
        new = rows
        if order is not None:
            w = Window.partitionBy(*self.keys).orderBy(F.desc_nulls_last(order), F.xxhash64(*[c for c in self.empty.columns if rows.schema[c].dataType.typeName() != "map"]))
            new = rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
        new = new.select(self.empty.columns).withColumn("bucket", self.bucket())
        return self._replace(new, new.select(*self.keys, "bucket"))

    def delete(self, keys: DataFrame) -> int:
        gone = cut(keys.select(*self.keys).distinct().withColumn("bucket", self.bucket()))
        return self._replace(self.empty.withColumn("bucket", F.lit(0)), gone)

    def _replace(self, new: DataFrame, gone: DataFrame) -> int:
        counted = gone.groupBy(*self.keys, "bucket").agg(F.count("*").alias("n"))
        found = counted.agg(F.max_by(F.struct(*self.keys), "n").alias("key"), F.max("n").alias("n"), F.collect_set("bucket").alias("touched")).first()  # at most all buckets
        if (found.n or 0) > 1:
            raise DuplicateKeyError(f"two rows of the key {list(found.key)}")
        self.touched = sorted(found.touched)
        if not self.touched:
            return 0
        whole, left = new, set(self.touched)
        if self._exists():
            # the rows may come from this very table, and so do those that stay
            kept = self._same(self._stored().where(F.col("bucket").isin(self.touched)), gone, "left_anti")
            whole = cut(kept.unionByName(new))
            left = {r.bucket for r in whole.select("bucket").distinct().collect()}
        whole.repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in set(self.touched) - left:  # a dynamic overwrite leaves folders alone that get no rows
            drop(self.spark, f"{self.path}/bucket={b}")
        return len(self.touched)


NODE = "type string, id string, name string, contract_id long, label string, confidence double, properties string"
EDGE = "subject string, edge_type string, object string, contract_id long, confidence double, properties string"
GENERIC = "Entity"  # fixed value: the type of nodes that a triple's ends make


class GraphStore:
    """Nodes by type and id, and relationships by subject, edge type and object.

    A triple's ends are generic nodes, found or made by name; they have no other values.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.nodes = KeyedTable(spark, f"{path}/nodes", ["type", "id"], NODE, buckets)
        self.ends = KeyedTable(spark, f"{path}/ends", ["name"], "name string", buckets)
        self.edges = KeyedTable(spark, f"{path}/edges", ["subject", "edge_type", "object"], EDGE, buckets)

    def store(self, entities: DataFrame, triples: DataFrame, order: str = "ord") -> None:
        """An extraction's entities, then the ends of its triples, then the relationships, so that none lacks its ends."""
        self.nodes.upsert(_filled(entities, self.nodes), order)
        ends = triples.select(F.col("subject").alias("name")).union(triples.select("object")).where("name IS NOT NULL").distinct()
        self.ends.upsert(ends)
        self.edges.upsert(_filled(triples.withColumn("edge_type", text.edge_type(F.col("predicate"))), self.edges), order)

    def all_nodes(self) -> DataFrame:
        return self.nodes.read().unionByName(self.ends.read().withColumn("type", F.lit(GENERIC)), allowMissingColumns=True)

    def contract_graph(self, contract_id: object) -> tuple[DataFrame, DataFrame]:
        """A contract's nodes, and its relationships with their ends' names."""
        edges = self.edges.read().where(F.col("contract_id") == contract_id)
        return self.nodes.read().where(F.col("contract_id") == contract_id), edges.select(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("edge_type").alias("type"), "confidence", "properties")

    def delete_contract(self, contract_id: object) -> None:
        """Remove a contract's nodes and relationships; generic nodes stay, as others may end in them."""
        for t in (self.nodes, self.edges):
            t.delete(t.read().where(F.col("contract_id") == contract_id))


def _filled(rows: DataFrame, table: KeyedTable) -> DataFrame:
    """``rows`` with the table's columns, null where they lack one, maps as JSON, and the rest as they are."""
    kinds = dict(rows.dtypes)
    for f in table.empty.schema.fields:
        if f.name not in kinds:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        elif kinds[f.name].startswith("map"):
            rows = rows.withColumn(f.name, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(f.name)))))
        else:
            rows = rows.withColumn(f.name, F.col(f.name).cast(f.dataType))
    return rows
