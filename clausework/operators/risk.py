"""Rule-based risk: findings, missing protections, scores and summaries, one pass over all contracts.

``clauses`` has contract_id, clause_index, label, confidence and text, one row for each label of a contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import dims, scores, text


def best_clause_per_label(classified: DataFrame) -> DataFrame:
    """The most confident clause of each label, the earliest one among equals."""
    w = Window.partitionBy("contract_id", "label").orderBy(F.desc("confidence"), "clause_index")
    return classified.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def _reason(label: Column, severity: Column, missing: bool) -> Column:
    return F.concat(F.lit("MISSING: no clause on " if missing else "Clause on "), label, F.lit(", rated "), severity)


def _recommendation(label: Column, missing: bool) -> Column:
    return F.concat(F.lit("Add a clause on " if missing else "Review the clause on "), label)


def finding(label: Column, severity: Column, confidence: Column, missing: bool) -> Column:
    """A finding as a struct, fields in order of name."""
    return F.struct(confidence.alias("confidence"), F.lit("missing" if missing else "present").alias("kind"), label.alias("label"), _reason(label, severity, missing).alias("reason"), _recommendation(label, missing).alias("recommendation"), severity.alias("severity"))


def with_severity(clauses: DataFrame, how: str = "inner") -> DataFrame:
    """Clauses with their rule's severity; liability clauses that bind both sides are rated lower."""
    d = clauses.join(F.broadcast(dims.dim(clauses.sparkSession, "dim_risk_rule").select("label", "severity", "requires_llm")), "label", how)
    mutual = F.col("label").isin(dims.LIABILITY_LABELS) & text.has_mutual_language(text.preview(F.col("text")))
    severity = F.when(mutual & (F.col("label") == "Uncapped Liability"), "INFO").when(mutual & (F.col("label") == "Liquidated Damages"), "MEDIUM").otherwise(F.col("severity"))
    return d.withColumn("severity", severity)


def present_findings(clauses: DataFrame) -> DataFrame:
    """One finding for each clause with a rule."""
    return with_severity(clauses).select("contract_id", F.lit("present").alias("kind"), "label", "severity", _reason(F.col("label"), F.col("severity"), False).alias("reason"), _recommendation(F.col("label"), False).alias("recommendation"), F.col("confidence"), "text", F.lit("rule").alias("source"))


def missing_findings(clauses: DataFrame, contracts: DataFrame) -> DataFrame:
    """One finding for each expected label that a contract lacks; the cross side has eight rows."""
    rules = F.broadcast(dims.dim(clauses.sparkSession, "dim_missing_rule"))
    lacking = contracts.select("contract_id").crossJoin(rules).join(clauses.select("contract_id", "label"), ["contract_id", "label"], "left_anti")
    return lacking.select("contract_id", F.lit("missing").alias("kind"), "label", "severity", _reason(F.col("label"), F.col("severity"), True).alias("reason"), _recommendation(F.col("label"), True).alias("recommendation"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("text"), F.lit("rule").alias("source"))


def findings(clauses: DataFrame, contracts: DataFrame) -> DataFrame:
    return present_findings(clauses).unionByName(missing_findings(clauses, contracts))


def severity_weight(severity: Column) -> Column:
    out = None
    for name, weight in dims.SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, weight) if out is None else out.when(severity == name, F.lit(weight))
    return out.otherwise(F.lit(0))


def points(kind: Column, severity: Column, confidence: Column) -> Column:
    factor = F.when(kind == "missing", dims.MISSING_FACTOR).otherwise(confidence).cast("decimal(9,6)")
    return severity_weight(severity).cast("decimal(4,0)") * factor


def score_of(total: Column) -> Column:
    raw = F.coalesce(total.cast("double"), F.lit(0.0)) / F.lit(float(dims.SCORE_CAP)) * 100
    return F.least(F.lit(100), raw.cast("int"))


def risk_scores(found: DataFrame, contracts: DataFrame) -> DataFrame:
    """contract_id, score, level. The weights are added up as decimals and divided once as doubles, then cut off."""
    total = found.groupBy("contract_id").agg(F.sum(points(F.col("kind"), F.col("severity"), F.col("confidence"))).alias("total"))
    d = contracts.select("contract_id").join(total, "contract_id", "left").withColumn("score", score_of(F.col("total")))
    return d.select("contract_id", "score", scores.risk_band(F.col("score")).alias("level"))


def summary_text(found: DataFrame) -> DataFrame:
    """Counts of critical, high and missing findings, joined by bars; zero parts are left out."""
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    present = F.col("kind") == "present"
    d = found.groupBy("contract_id").agg(
        F.count_if(present & (F.col("severity") == "CRITICAL")).alias("c"), F.count_if(present & (F.col("severity") == "HIGH")).alias("h"),
        F.count_if(~present & F.col("severity").isin("CRITICAL", "HIGH")).alias("m"),
    )
    return d.select("contract_id", F.concat_ws(" | ", part(F.col("c"), "CRITICAL"), part(F.col("h"), "HIGH"), part(F.col("m"), "missing")).alias("summary"))


def adjust(scores_df: DataFrame, adjustment: DataFrame) -> DataFrame:
    """Scores raised by the dependency adjustment, banded anew where it is positive."""
    d = scores_df.join(adjustment, "contract_id", "left").withColumn("adjustment", F.coalesce("adjustment", F.lit(0)))
    new = F.least(F.lit(100), F.col("score") + F.col("adjustment"))
    return d.select("contract_id", new.alias("score"), F.when(F.col("adjustment") > 0, scores.risk_band(new)).otherwise(F.col("level")).alias("level"), "adjustment")


def assess(clauses: DataFrame, contracts: DataFrame) -> DataFrame:
    """contract_id, score, level and summary of every contract."""
    found = findings(clauses, contracts)
    return risk_scores(found, contracts).join(summary_text(found), "contract_id", "left").select("contract_id", "score", "level", F.coalesce("summary", F.lit("")).alias("summary"))


def exposure(clauses: DataFrame) -> DataFrame:
    """label, category, severity, high_risk, requires_llm and in how many contracts it stands, for every label."""
    rules = dims.label_rules(clauses.sparkSession)
    n = clauses.groupBy("label").agg(F.count_distinct("contract_id").alias("contracts"))
    return rules.join(n, "label", "left").select("label", "category", "severity", "high_risk", "requires_llm", "missing_severity", "patterns", F.coalesce("contracts", F.lit(0)).alias("contracts"))
