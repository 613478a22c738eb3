"""Clause classification by vector similarity, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import dims, scores, text


def prototypes(vectors: DataFrame) -> DataFrame:
    """label, prototype: the mean vector of each label."""
    d = vectors.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return d.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("prototype"))


def similarities(vectors: DataFrame, protos: DataFrame) -> DataFrame:
    """Cosine of each vector with each prototype, 0 where either has no length; the prototypes are as few as there are labels. Lengths are taken once a vector."""
    of = F.broadcast(protos.select(F.col("label").alias("candidate"), "prototype", scores.norm(F.col("prototype")).alias("__m")))
    d = vectors.withColumn("__n", scores.norm(F.col("embedding"))).crossJoin(of)
    length = F.col("__n") * F.col("__m")
    return d.withColumn("cosine", F.when(length == 0, F.lit(0.0)).otherwise(F.try_divide(scores.dot(F.col("embedding"), F.col("prototype")), length))).drop("prototype", "__n", "__m")


def classify(vectors: DataFrame, protos: DataFrame, top_k: int = 3, threshold: float = 0.3, key: str | tuple[str, ...] = "vec_id", digits: int = 6) -> DataFrame:
    """The best labels of each vector above a cosine, with calibrated confidence; ties go to the lesser label.

    Cosines are rounded to ``digits`` first, so that ranks do not hang on the order in which a prototype's vectors were added up.
    """
    d = similarities(vectors, protos).withColumn("cosine", F.round("cosine", digits))
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.desc("cosine"), "candidate")
    d = d.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= top_k) & (F.col("cosine") >= threshold))
    return d.withColumn("confidence", scores.platt(F.col("cosine")))


def split_contracts(contracts: DataFrame, least: int = 50, sections: bool = True) -> DataFrame:
    """contract_id, clause_index, text of every clause; short ones keep their index but are left out. Without ``sections`` blank lines alone divide."""
    d = contracts.select("contract_id", F.posexplode(text.split_clauses(F.col("text"), sections=sections)).alias("clause_index", "text"))
    return d.where(F.char_length("text") >= least).withColumn("text", text.preview(F.col("text")))


def label_patterns(clauses: DataFrame) -> DataFrame:
    """label, n and patterns (joined by bars) of every label's wording, and how many clauses have the label."""
    each = dims.dim(clauses.sparkSession, "dim_pattern").groupBy("label").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pattern_ord", "pattern"))), lambda x: x["pattern"]), "|").alias("patterns"))
    have = clauses.groupBy("label").agg(F.count("*").alias("clauses"))
    return each.join(have, "label", "left").select("label", "n", "patterns", F.coalesce("clauses", F.lit(0)).alias("clauses"))


def label_occurrence(classified: DataFrame) -> DataFrame:
    return classified.groupBy("label").agg(F.count("*").alias("n"), F.max("confidence").alias("max_confidence"), F.max_by("text", F.struct("confidence", -F.col("contract_id"), -F.col("clause_index"))).alias("best_match"))


def category_summary(clauses: DataFrame) -> DataFrame:
    """Labels of each contract and category, most confident first."""
    item = F.struct((-F.col("confidence")).alias("c"), F.col("label").alias("l"))
    return clauses.groupBy("contract_id", "category").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["l"]), ", ").alias("labels"))


def confusion(predicted: DataFrame, truth: str, guess: str) -> DataFrame:
    return predicted.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """precision, recall and F1 of every class, 0 where undefined."""
    hit = F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0))
    a = conf.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    b = conf.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("predicted"))
    z = lambda c: F.coalesce(c, F.lit(0))
    d = a.join(b, "class", "full_outer").select("class", z(F.col("support")).alias("support"), z(F.col("predicted")).alias("predicted"), z(F.col("tp")).alias("tp"))
    d = d.withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)))
    return d.withColumn("f1", F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.col("predicted") + F.col("support")), F.lit(0.0)))


def f1_scores(conf: DataFrame) -> DataFrame:
    d = per_class(conf)
    return d.agg(F.avg("f1").alias("macro_f1"), F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"), F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"))


def calibration_error(predicted: DataFrame, correct: Column, conf: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error; confidences outside [0, 1) fall in no bin but count in the total."""
    d = predicted.select(conf.alias("conf"), correct.cast("int").alias("hit"))
    each = d.groupBy(F.when((F.col("conf") >= 0) & (F.col("conf") < 1), F.floor(F.col("conf") * bins)).alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("hit").alias("a"))
    return each.agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("a") - F.col("c"))).otherwise(0.0)).alias("gap"), F.sum("n").alias("n")).select(F.try_divide("gap", "n").alias("ece"), "n")


def splits(keys: DataFrame, seed: str = "42", train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Train, validation and test by contract, from a hash of its key: no sort, no contract in two splits."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("contract_id").cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("double")) / F.lit(4294967296.0)
    return keys.select("contract_id").distinct().select("contract_id", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test").alias("split"))


def split_overlap(assigned: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """split_a < split_b and how many values of ``column`` have rows in both splits; ``rows`` has contract_id and the column."""
    of = rows.select("contract_id", F.col(column).alias("value")).where("value IS NOT NULL").join(assigned, "contract_id").select("value", "split").distinct()
    both = of.groupBy("value").agg(F.sort_array(F.collect_set("split")).alias("s"))  # three splits at most
    names = ("test", "train", "validation")
    pairs = [F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}-{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    counts = both.agg(*pairs)
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c.split("-")[0]).alias("split_a"), F.lit(c.split("-")[1]).alias("split_b"), F.col(f"`{c}`").alias("shared")) for c in counts.columns])).alias("x")).select("x.*")


def training_pairs(clauses: DataFrame, labels: DataFrame, negatives: int = 4, seed: str = "42") -> DataFrame:
    """Each clause with its own label and with hash-picked other labels; the labels are a small side."""
    own = clauses.select("contract_id", "clause_index", "label", F.col("label").alias("other"), F.lit(1.0).alias("target"))
    w = Window.partitionBy("contract_id", "clause_index").orderBy(F.md5(F.concat_ws(":", F.col("contract_id").cast("string"), F.col("clause_index").cast("string"), "other", F.lit(seed))))
    wrong = clauses.select("contract_id", "clause_index", "label").crossJoin(F.broadcast(labels.select(F.col("label").alias("other")))).where("other <> label")
    wrong = wrong.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= negatives).drop("rn").withColumn("target", F.lit(0.0))
    return own.unionByName(wrong)


def fit_platt(predicted: DataFrame, score: str, correct: str, steps: int = 12) -> DataFrame:
    """a and b of the calibration 1 / (1 + exp(a s + b)) by maximum likelihood: Newton's steps from 0, each of five sums over all rows.

    Rows without a score or a truth are left out. Where the sums give no step (one score alone, or all right or wrong so far that nothing is left to gain) the last a
    and b stay.
    """
    d = predicted.select(F.col(score).cast("double").alias("s"), F.col(correct).cast("double").alias("y")).where("s IS NOT NULL AND NOT isnan(s) AND y IS NOT NULL")
    a = b = 0.0
    for _ in range(steps):
        p = platt_sums(d, a, b).first()
        det = (p.h2 or 0.0) * (p.h0 or 0.0) - (p.h1 or 0.0) ** 2
        if det <= 1e-12:
            break
        a, b = a + (p.h0 * p.g1 - p.h1 * p.g0) / det, b + (p.h2 * p.g0 - p.h1 * p.g1) / det
    return predicted.sparkSession.createDataFrame([(a, b)], "a double, b double")


def platt_sums(d: DataFrame, a: float, b: float) -> DataFrame:
    """The likelihood's slopes (g1 by a, g0 by b) and curvatures at a and b."""
    d = d.withColumn("p", scores.platt(F.col("s"), a, b)).withColumn("w", F.col("p") * (1 - F.col("p")))
    return d.agg(F.sum((F.col("p") - F.col("y")) * F.col("s")).alias("g1"), F.sum(F.col("p") - F.col("y")).alias("g0"), F.sum(F.col("w") * F.col("s") * F.col("s")).alias("h2"), F.sum(F.col("w") * F.col("s")).alias("h1"), F.sum("w").alias("h0"))


def gate(ranked: DataFrame, least: float = 0.45) -> DataFrame:
    """Clauses whose best label is confident enough to be extracted."""
    return ranked.where((F.col("rank") == 1) & (F.col("confidence") >= least))


def split_stats(assigned: DataFrame, clauses: DataFrame) -> DataFrame:
    """Contracts and clauses of each split."""
    d = assigned.join(clauses.groupBy("contract_id").agg(F.count("*").alias("n")), "contract_id", "left")
    return d.groupBy("split").agg(F.count("*").alias("contracts"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("clauses"))


def pair_stats(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("target") == 1).alias("positive"))


def calibration_delta(baseline: DataFrame, tuned: DataFrame) -> DataFrame:
    """Two calibration errors and how much the second is better."""
    d = baseline.select(F.col("ece").alias("baseline_ece")).crossJoin(F.broadcast(tuned.select(F.col("ece").alias("tuned_ece"))))
    return d.withColumn("improvement", F.col("baseline_ece") - F.col("tuned_ece"))
