"""Writers: analysis JSON, splits, keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def analysis_json(clauses: DataFrame, scores: DataFrame) -> DataFrame:
    """contract_id and its analysis as JSON, with texts cut to 200 characters."""
    item = F.struct("clause_index", "label", "confidence", F.substring("text", 1, 200).alias("text_preview"))
    d = clauses.groupBy("contract_id").agg(F.sort_array(F.collect_list(item)).alias("clauses"), F.count("*").alias("total_clauses")).join(scores, "contract_id")
    return d.select("contract_id", F.to_json(F.struct("contract_id", "total_clauses", "clauses", F.struct("score", "level").alias("risk"))).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder of JSON lines for each split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of rows with their keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def delete(old: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    return old.join(ids.select(*keys), list(keys), "left_anti")


def check_size(df: DataFrame, warn: int = 50_000, most: int = 100_000) -> str:
    """ok, warn or full, by the row count; Spark itself needs no such guard."""
    n = df.limit(most).count()
    return "full" if n >= most else "warn" if n >= warn else "ok"


def extraction_json(entities: DataFrame, triples: DataFrame, moment: str) -> DataFrame:
    """contract_id and its entities, triples and their numbers as JSON; ``moment`` is the time to state, so that reruns give the same text."""
    e = entities.groupBy("contract_id").agg(F.sort_array(F.collect_list(F.struct("name", "type", "confidence"))).alias("entities"))
    t = triples.groupBy("contract_id").agg(F.sort_array(F.collect_list(F.struct("subject", "predicate", "object", "confidence"))).alias("triples"))
    d = e.join(t, "contract_id", "full_outer")
    d = d.withColumns({"entities": F.coalesce("entities", F.array()), "triples": F.coalesce("triples", F.array())})
    about = F.struct(F.size("entities").alias("n_entities"), F.size("triples").alias("n_triples"), F.lit(moment).alias("extracted_at"))
    return d.select("contract_id", F.to_json(F.struct("contract_id", "entities", "triples", about.alias("metadata"))).alias("json"))


def store_result(nodes: DataFrame, triples: DataFrame, path: str) -> None:
    """A result as two tables under one folder, nodes before triples, so that a triple never lacks its ends."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    triples.write.mode("overwrite").parquet(f"{path}/triples")


def run_named(spark: SparkSession, sql: str, tables: dict[str, DataFrame], parameters: dict | None = None) -> DataFrame:
    """A query over tables given by name, with named parameters: :name in the text, never pasted into it."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=parameters or {})
