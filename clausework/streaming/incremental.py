"""Extension: contracts that arrive as files, scored batch by batch. The reference computation has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausework.operators import risk


def score_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Score each batch of classified clauses in ``folder`` and replace the contracts' earlier scores in ``out``/batch=n."""
    schema = "contract_id long, clause_index long, label string, category string, confidence double, text string"
    rows = spark.readStream.schema(schema).parquet(folder)

    def each(batch: DataFrame, n: int) -> None:
        clauses = risk.best_clause_per_label(batch)
        contracts = batch.select("contract_id").distinct()
        found = risk.findings(clauses, contracts)
        risk.risk_scores(found, contracts).withColumn("version", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    d = spark.read.parquet(out)
    return d.groupBy("contract_id").agg(F.max_by(F.struct("score", "level"), "version").alias("s")).select("contract_id", "s.score", "s.level")
