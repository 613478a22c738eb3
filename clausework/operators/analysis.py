"""The whole analysis of contracts, from their texts to documents with risk and dependencies, as one plan.

Texts are split into clauses, clauses classified by their vectors' similarity to the labels', and the best clause of each label is what the
contract has of it; risk, dependencies and the adjusted score follow from these. Vectors are a column function, the trigram one by default; a
model's vectors come as a column of the clauses instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import dims, text
from clausework.operators import classify, reports, risk

CLASSIFY_LEAST, TOP_LABELS = 0.40, 3  # fixed values
EXAMPLES = ". Examples: "


def label_texts(spark: SparkSession) -> DataFrame:
    """label and the text that stands for it: its name and the patterns of its wording."""
    patterns = dims.dim(spark, "dim_pattern").groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pattern_ord", "pattern"))), lambda x: x["pattern"]), " ").alias("patterns"))
    return dims.dim(spark, "dim_label").join(patterns, "label", "left").select("label", F.concat("label", F.lit(EXAMPLES), F.coalesce("patterns", F.lit(""))).alias("text"))


def classified(contracts: DataFrame, vector: Callable[[Column], Column] = text.trigram_vector, top_k: int = TOP_LABELS, threshold: float = CLASSIFY_LEAST, sections: bool = True) -> DataFrame:
    """contract_id, clause_index, text, label, category, rank, cosine and confidence of every clause's labels; clauses without a label are left out.

    ``contracts`` has contract_id and text; its clauses are those of ``classify.split_contracts``. The labels' vectors are 40 rows.
    """
    clauses = classify.split_contracts(contracts.where("contract_id IS NOT NULL"), sections=sections).withColumn("embedding", vector(F.col("text")))
    protos = label_texts(contracts.sparkSession).select("label", vector(F.col("text")).alias("prototype"))
    found = classify.classify(clauses, protos, top_k, threshold, key=("contract_id", "clause_index"))
    categories = F.broadcast(dims.dim(contracts.sparkSession, "dim_label").select(F.col("label").alias("candidate"), "category"))
    return found.join(categories, "candidate").select("contract_id", "clause_index", "text", F.col("candidate").alias("label"), "category", "rank", "cosine", "confidence")


def labelled(found: DataFrame) -> DataFrame:
    """The best clause of each label of a contract, by its first label only."""
    return risk.best_clause_per_label(found.where("rank = 1").drop("rank", "cosine"))


def analyze(contracts: DataFrame, vector: Callable[[Column], Column] = text.trigram_vector, threshold: float = CLASSIFY_LEAST, sections: bool = True) -> DataFrame:
    """contract_id and document of every contract, those without any label, too."""
    return reports.documents(labelled(classified(contracts, vector, threshold=threshold, sections=sections)), contracts.where("contract_id IS NOT NULL"))
