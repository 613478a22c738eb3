"""Roll-ups over a portfolio of contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions import dims
from clausework.functions.scores import round_half_even


def overview(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("contracts"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"))


def rounded_overview(scores_df: DataFrame) -> DataFrame:
    """Contracts and their mean score, to one digit."""
    return overview(scores_df).withColumn("avg_score", round_half_even(F.col("avg_score")))


def affected_contracts(lacking: DataFrame, recommended: DataFrame) -> DataFrame:
    """label and contract_id of every contract that a recommendation touches; recommendations are a few rows."""
    return lacking.join(F.broadcast(recommended.select("label")), "label", "left_semi").select("label", "contract_id")


class UnknownContractError(LookupError):
    """A contract that was asked for is not in the portfolio."""


def require(contracts: DataFrame, *ids: object) -> None:
    """Raise unless all of these contracts are there."""
    known = {r.contract_id for r in contracts.where(F.col("contract_id").isin(list(ids))).select("contract_id").distinct().collect()}  # no more than asked for
    lacking = [i for i in ids if i not in known]
    if lacking:
        raise UnknownContractError(f"no contract {', '.join(map(str, lacking))}")


def levels(scores: DataFrame) -> DataFrame:
    return scores.groupBy("level").agg(F.count("*").alias("n"))


def top_labels(clauses: DataFrame, k: int = 10) -> DataFrame:
    return clauses.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)


def top_contracts(scores: DataFrame, k: int = 5) -> DataFrame:
    return scores.orderBy(F.desc("score"), "contract_id").limit(k)


def coverage(clauses: DataFrame, contracts: DataFrame) -> DataFrame:
    """For every label how many contracts have it; the number of labels and of contracts are single small sides."""
    labels = F.broadcast(dims.dim(clauses.sparkSession, "dim_label").select("label_ord", "label"))
    n = contracts.agg(F.count("*").alias("n"))
    have = clauses.groupBy("label").agg(F.count_distinct("contract_id").alias("with_label"))
    d = labels.join(have, "label", "left").crossJoin(F.broadcast(n)).withColumn("with_label", F.coalesce("with_label", F.lit(0)))
    return d.select("label", "with_label", (F.col("n") - F.col("with_label")).alias("without_label"), F.coalesce(F.try_divide(F.col("with_label") * F.lit(100.0), "n"), F.lit(0.0)).alias("coverage_pct"))


def coverage_detail(clauses: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row for every label and contract: covered or not, and the clause's text."""
    labels = F.broadcast(dims.dim(clauses.sparkSession, "dim_label").select("label"))
    d = contracts.select("contract_id").crossJoin(labels).join(clauses.select("contract_id", "label", "text"), ["contract_id", "label"], "left")
    return d.select("contract_id", "label", F.col("text").isNotNull().alias("covered"), "text")


def gaps(clauses: DataFrame, contracts: DataFrame) -> DataFrame:
    """contract_id, label of each standard protection that a contract lacks."""
    wanted = F.broadcast(dims.dim(clauses.sparkSession, "dim_protection").select("label"))
    return contracts.select("contract_id").crossJoin(wanted).join(clauses.select("contract_id", "label"), ["contract_id", "label"], "left_anti")


def gap_frequency(lacking: DataFrame, contracts: DataFrame) -> DataFrame:
    n = contracts.agg(F.count("*").alias("n"))
    d = lacking.groupBy("label").agg(F.count("*").alias("missing")).crossJoin(F.broadcast(n))
    return d.select("label", "missing", F.try_divide(F.col("missing") * F.lit(100.0), "n").alias("missing_pct"))


def gap_recommendations(frequency: DataFrame, first: int = 5) -> DataFrame:
    """The most frequent gaps, of these those that half of the contracts have."""
    rules = F.broadcast(dims.dim(frequency.sparkSession, "dim_missing_rule"))
    d = frequency.orderBy(F.desc("missing"), "label").limit(first).where("missing_pct >= 50").join(rules, "label", "left")
    advice = F.when(F.col("severity").isNotNull(), F.concat(F.lit("Add a clause on "), "label")).otherwise(F.concat(F.lit("Add "), "label", F.lit(" clause")))
    return d.select("label", "missing", "missing_pct", F.when(F.col("missing_pct") >= 75, "HIGH").otherwise("MEDIUM").alias("priority"), advice.alias("advice"))


def gap_matrix(lacking: DataFrame, contracts: DataFrame) -> DataFrame:
    """A row for each contract, a column for each protection: present or not."""
    marked = lacking.groupBy("contract_id").pivot("label", dims.STANDARD_PROTECTIONS).agg(F.count(F.lit(1)))
    d = contracts.select("contract_id").join(marked, "contract_id", "left")
    return d.select("contract_id", *[F.col(f"`{p}`").isNull().alias(p.lower().replace(" ", "_").replace("-", "_")) for p in dims.STANDARD_PROTECTIONS])


def compare(clauses: DataFrame, a: int, b: int) -> DataFrame:
    """Labels that both contracts hold, with both texts."""
    side = lambda c, n: clauses.where(F.col("contract_id") == c).groupBy("label").agg(F.min_by("text", "clause_index").alias(n))
    return side(a, "text_a").join(side(b, "text_b"), "label")


def compare_risk(scores: DataFrame, a: int, b: int) -> DataFrame:
    one = lambda c, s: scores.where(F.col("contract_id") == c).select(F.col("score").alias(f"score_{s}"), F.col("level").alias(f"level_{s}"))
    return one(a, "a").crossJoin(F.broadcast(one(b, "b"))).withColumn("difference", F.col("score_a") - F.col("score_b"))


def common_labels(clauses: DataFrame, a: int, b: int) -> DataFrame:
    return clauses.where(F.col("contract_id") == a).select("label").intersect(clauses.where(F.col("contract_id") == b).select("label"))


def only_in(clauses: DataFrame, a: int, b: int) -> DataFrame:
    return clauses.where(F.col("contract_id") == a).select("label").subtract(clauses.where(F.col("contract_id") == b).select("label"))


def contract_summary(found: DataFrame) -> DataFrame:
    """Labels found and missing of each contract, sorted, with counts of severe findings."""
    present = F.col("kind") == "present"
    return found.groupBy("contract_id").agg(
        F.count_if(present).alias("labels_found"), F.count_if(present & (F.col("severity") == "CRITICAL")).alias("critical"), F.count_if(present & (F.col("severity") == "HIGH")).alias("high"),
        F.array_join(F.sort_array(F.collect_list(F.when(~present, F.col("label")))), ", ").alias("missing"),
    )


def totals(scores: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts, analysed ones and their mean score."""
    d = contracts.select("contract_id").join(scores, "contract_id", "left")
    return d.agg(F.count("*").alias("contracts"), F.count("score").alias("analyzed"), F.avg("score").alias("avg_score"))


def compare_values(values: DataFrame, a: int, b: int) -> DataFrame:
    """Extracted values of labels that both contracts hold: field to value, of repeated fields the last; labels without any value go.

    ``values`` has contract_id, label, ord, field, value, with a null field for a clause without values.
    """
    known = values.where(F.col("contract_id").isin(a, b)).groupBy("contract_id", "label", "field").agg(F.max_by("value", "ord").alias("value"))
    maps = known.groupBy("contract_id", "label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value"))))).alias("m"))
    side = lambda c, n: maps.where(F.col("contract_id") == c).select("label", F.col("m").alias(n))
    return side(a, "values_a").join(side(b, "values_b"), "label").where((F.size("values_a") > 0) | (F.size("values_b") > 0))


def upsert_entries(entries: DataFrame, computed: DataFrame) -> DataFrame:
    """One row for each contract: of repeated entries the last by ``ord``, with the score and level that it came with or else the computed ones.

    ``entries`` has contract_id, ord, score and level, of which the last two may be null.
    """
    last = entries.groupBy("contract_id").agg(F.max_by(F.struct("score", "level"), "ord").alias("e"))
    d = last.join(computed.select("contract_id", "score", "level"), "contract_id", "left")
    return d.select("contract_id", F.coalesce("e.score", "score").alias("score"), F.when(F.col("e.score").isNotNull(), F.col("e.level")).otherwise(F.col("level")).alias("level"))


def riskiest(contracts: DataFrame, scores: DataFrame, first: int = 10) -> DataFrame:
    """Contracts on the list of the ``first`` highest scores."""
    return contracts.join(F.broadcast(scores.orderBy(F.desc("score"), "contract_id").limit(first).select("contract_id")), "contract_id", "left_semi")


def compare_contracts(contracts: DataFrame, clauses: DataFrame, scores: DataFrame, values: DataFrame, a: int, b: int) -> DataFrame:
    """One row for two contracts: contract_a, contract_b, shared_clauses, only_in_a, only_in_b (sorted), risk and clause_differences.

    Raises ``UnknownContractError`` where either is not there. A label is in a list once; differences are those of ``compare_values``. No list is longer than there are labels.
    """
    require(contracts, a, b)
    own = clauses.where(F.col("contract_id").isin(a, b)).groupBy("label").agg(F.bool_or(F.col("contract_id") == a).alias("in_a"), F.bool_or(F.col("contract_id") == b).alias("in_b"))
    listed = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("label"))))
    lists = own.agg(listed(F.col("in_a") & F.col("in_b")).alias("shared_clauses"), listed(F.col("in_a") & ~F.col("in_b")).alias("only_in_a"), listed(F.col("in_b") & ~F.col("in_a")).alias("only_in_b"))
    pairs = lambda c: F.array_sort(F.map_entries(c))
    apart = compare_values(values, a, b).agg(F.sort_array(F.collect_list(F.struct("label", pairs("values_a").alias("values_a"), pairs("values_b").alias("values_b")))).alias("clause_differences"))
    risk = compare_risk(scores, a, b).select(F.struct("difference", "level_a", "level_b", "score_a", "score_b").alias("risk"))
    d = lists.crossJoin(F.broadcast(risk)).crossJoin(F.broadcast(apart))
    return d.select(F.lit(a).cast("long").alias("contract_a"), F.lit(b).cast("long").alias("contract_b"), "*")
