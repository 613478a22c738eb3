"""Mixing of sources to target weights by Poisson replication.

A source's repetition rate is its target share times the target number of rows over the source's rows; a document
is repeated a Poisson number of times with that mean. The number comes from the inverted distribution function at a uniform value
hashed from id and seed (the text is not read), so a rerun after a lost executor repeats it. A row without an id has its place in the input's
partitions for an id, which files keep, so each such row is drawn by itself. Copies are dealt out by a hash of document,
copy and seed and sorted by it: one shuffle, in which a large source is spread like any other.

Without weights every source gets the same share. Null sources are one source of their own; a source without weight has rate 0.
Repeated rows are drawn with the same value. Input columns named like results are replaced; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.session import cut, shuffle_partitions, table, without

QUERY = "op7_source_mix"
SEED = 17
BROADCAST_SOURCES = 10_000
STEPS = 16
_U = "(CAST(conv(substring(md5(concat_ws(':', {key}, '{seed}')), 1, 12), 16, 10) AS DOUBLE) + 0.5D) / 281474976710656D"


def rates(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None, source: str = "source") -> DataFrame:
    """source, rows, rate: one row for each source."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("source_rows"))
    if weights is None:
        share = F.lit(1.0)
    else:
        share = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    counts = cut(counts.withColumn("share", share))
    total = counts.agg(F.sum("share").alias("all_shares"), F.sum("source_rows").alias("all_rows"))
    target = F.col("all_rows") if target_rows is None else F.lit(int(target_rows))
    return counts.crossJoin(F.broadcast(total)).select("source", "source_rows", (F.col("share") / F.col("all_shares") * target / F.col("source_rows")).alias("rate"))


def _inverse(u: str, rate: str) -> str:
    top = f"CAST(ceil({rate} + 12 * sqrt({rate}) + 24) AS INT)"
    return (
        f"aggregate(sequence(1, {top}), named_struct('k', 0L, 'p', exp(-({rate})), 'c', exp(-({rate}))), "
        f"(s, i) -> CASE WHEN s.c >= {u} THEN s ELSE named_struct('k', CAST(i AS BIGINT), 'p', s.p * {rate} / i, 'c', s.c + s.p * {rate} / i) END, s -> s.k)"
    )


def poisson_count(key: str, seed: int, rate: str) -> str:
    """SQL for the least k whose distribution function reaches the hashed uniform value.

    Above a mean of 256, where exp(-mean) nears underflow, the mean is cut into equal parts, each inverted at its own
    value; their sum is Poisson with the whole mean.
    """
    one = _inverse(_U.format(key=key, seed=seed), rate)
    parts = f"CAST(ceil({rate} / 256) AS INT)"
    part = _inverse(_U.format(key=f"{key}, CAST(j AS STRING)", seed=seed), f"({rate} / {parts})")
    return f"CASE WHEN {rate} <= 256 THEN {one} ELSE aggregate(sequence(1, {parts}), 0L, (a, j) -> a + {part}) END"


def mix(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None, seed: int = SEED, key: str = "doc_id", source: str = "source", partitions: int | None = None) -> DataFrame:
    """Copies of ``docs`` with ``n_copies``, ``copy`` (from 0) and ``shuffle_key``, dealt out globally."""
    d = without(docs, "n_copies", "copy", "shuffle_key", "rate", "source_rows")
    by = cut(rates(d, weights, target_rows, source).withColumnRenamed("source", "__source"))
    small = by.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    salt = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(STEPS)).cast("int")
    if small:
        d = d.join(F.broadcast(by), F.col(source).eqNullSafe(F.col("__source")), "left")
    else:
        wide = by.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
        d = d.withColumn("__salt", salt).join(wide.withColumnRenamed("__salt", "__s"), (F.col("__salt") == F.col("__s")) & F.col(source).eqNullSafe(F.col("__source")), "left").drop("__s", "__salt")
    d = d.withColumn("__row", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    text = f"coalesce(CAST({key} AS STRING), concat('row ', CAST(__row AS STRING)))"
    d = d.withColumn("n_copies", F.expr(poisson_count(text, int(seed), "rate")))
    d = d.where("n_copies > 0").drop("__source", "rate", "source_rows")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    d = d.withColumn("shuffle_key", F.expr(f"md5(concat_ws(':', {text}, CAST(copy AS STRING), 'order', '{int(seed)}'))")).drop("__row")
    return d.repartition(partitions or shuffle_partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


ORACLE_SQL = f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM s)::DOUBLE * (SELECT sum(n) FROM s)::DOUBLE / n AS rate FROM s),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
u AS (SELECT *, (('0x' || substring(md5(doc_id || ':{SEED}'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656 AS u FROM documents),
m AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND cdf.c < u.u)::BIGINT AS n_copies FROM u),
x AS (SELECT *, unnest(range(n_copies)) AS copy FROM m WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, md5(doc_id || ':' || copy || ':order:{SEED}') AS shuffle_key FROM x
"""
