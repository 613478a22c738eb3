"""Inputs of the contract engine, derived from the star-schema tables by SQL that reads alike in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausework.functions import dims

CLASSIFIED = f"""
SELECT r.contract_id, r.clause_index, d.label, d.category, r.pct / CAST(100 AS DOUBLE) AS confidence, r.text, r.value FROM (
  SELECT CAST(l_orderkey AS BIGINT) AS contract_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS clause_index,
    CAST((l_partkey + 7 * l_linenumber) % 40 AS INT) AS label_ord,
    least(95, greatest(45, CAST(45 + 5 * floor(100 * l_discount + 0.5) AS INT))) AS pct,
    CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'Neither  party may claim more than the fees paid' WHEN 1 THEN 'The parties accept the stated sum'
      WHEN 2 THEN 'Licensee shall pay what is owed' WHEN 3 THEN 'Liability is mutually excluded' ELSE 'Supplier may act alone' END AS text,
    CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) AS value
  FROM lineitem) r JOIN {dims.DIMENSIONS["dim_label"]} d ON r.label_ord = d.label_ord"""
CLAUSES = f"""
SELECT contract_id, clause_index, label, category, confidence, text, value FROM (
  SELECT c.*, row_number() OVER (PARTITION BY contract_id, label ORDER BY confidence DESC, clause_index) AS rn FROM ({CLASSIFIED}) c) x WHERE rn = 1"""
CONTRACTS = "SELECT CAST(o_orderkey AS BIGINT) AS contract_id, CAST(o_custkey AS BIGINT) AS party_id, o_orderpriority AS contract_type FROM orders"
ENTITIES = """
SELECT id, name, type, contract_id, confidence, n_props, ord FROM (
  SELECT concat('c', CAST(c_custkey AS VARCHAR(20))) AS id, concat(CASE c_custkey % 4 WHEN 0 THEN 'the ' WHEN 1 THEN ' "' ELSE '' END, c_name, CASE c_custkey % 3 WHEN 0 THEN ' inc' WHEN 1 THEN ' llc' ELSE '' END, CASE c_custkey % 4 WHEN 1 THEN '"' ELSE '' END) AS name,
    'Party' AS type, CAST(c_nationkey AS BIGINT) AS contract_id, CAST(0.9 AS DOUBLE) AS confidence, c_custkey % 3 AS n_props, 4 * CAST(c_custkey AS BIGINT) AS ord FROM customer
  UNION ALL
  SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))), concat(s_name, CASE s_suppkey % 2 WHEN 0 THEN ' corp.' ELSE ' company' END), 'Party', CAST(s_nationkey AS BIGINT), CAST(0.7 AS DOUBLE), s_suppkey % 2, 4 * CAST(s_suppkey AS BIGINT) + 1 FROM supplier
  UNION ALL
  SELECT concat('n', CAST(n_nationkey AS VARCHAR(20))), n_name, 'Jurisdiction', CAST(n_nationkey AS BIGINT), CAST(0.95 AS DOUBLE), 0, 4 * CAST(n_nationkey AS BIGINT) + 2 FROM nation
  UNION ALL
  SELECT concat('d', CAST(r_regionkey AS VARCHAR(20))), concat('on ', CAST(r_regionkey + 1 AS VARCHAR(20)), '/7/2021'), 'Temporal', CAST(r_regionkey AS BIGINT), CAST(0.8 AS DOUBLE), 1, 4 * CAST(r_regionkey AS BIGINT) + 3 FROM region) e"""
TRIPLES = """
SELECT subject, predicate, object, confidence, contract_id, k, ord FROM (
  SELECT concat('c', CAST(o_custkey AS VARCHAR(20))) AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'must' WHEN 1 THEN 'has obligation' ELSE 'promises' END AS predicate, concat('p', CAST(o_orderkey % 50 AS VARCHAR(20))) AS object,
    CAST(o_orderkey % 10 AS INT) / CAST(10 AS DOUBLE) AS confidence, CAST(o_orderkey % 7 AS BIGINT) AS contract_id, CAST(o_orderkey % 4 AS INT) AS k, 2 * CAST(o_orderkey AS BIGINT) AS ord FROM orders
  UNION ALL
  SELECT concat('c', CAST(c_custkey AS VARCHAR(20))), 'governed-by', concat('n', CAST(c_nationkey AS VARCHAR(20))), CAST(0.8 AS DOUBLE), CAST(c_nationkey AS BIGINT), 0, 2 * CAST(c_custkey AS BIGINT) + 1 FROM customer) t"""
NAMES = ("region", "nation", "customer", "supplier", "orders", "lineitem")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived input over the tables of a folder, by name in their own scope."""
    heads = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES if f"FROM {n}" in sql}
    for n in heads:
        sql = sql.replace(f"FROM {n}", "FROM {" + n + "}")
    return spark.sql(sql, **heads)


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CLAUSES)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CLASSIFIED)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CONTRACTS)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, ENTITIES)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, TRIPLES)
