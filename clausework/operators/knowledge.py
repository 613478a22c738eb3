"""Knowledge graph: entities, triples, resolution of duplicates, aggregation across contracts, and the graph store.

Entities have id, name, type, contract_id, confidence, properties (map) and ord, the order of arrival; triples have
subject, predicate, object, confidence, properties, contract_id and ord.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import dims, scores, text
from clausework.operators import similarity
from clausework.plans.lineage import cut


def dedup_entities(entities: DataFrame) -> DataFrame:
    """First entity of each normalized name and type."""
    w = Window.partitionBy(text.normalize_name(F.col("name")), "type").orderBy("ord")
    return entities.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def remap(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Subjects and objects replaced through ``mapping`` (old_id, canonical_id)."""
    m = lambda c: mapping.select(F.col("old_id").alias(f"__{c}"), F.col("canonical_id").alias(f"__new_{c}"))
    d = triples
    for c in ("subject", "object"):
        d = d.join(m(c), F.col(c) == F.col(f"__{c}"), "left").withColumn(c, F.coalesce(f"__new_{c}", c)).drop(f"__{c}", f"__new_{c}")
    return d


def dedup_triples_average(triples: DataFrame) -> DataFrame:
    """First of each subject, predicate and object; its confidence is averaged with each later one in turn."""
    item = F.struct("ord", "confidence")
    d = triples.groupBy("subject", "predicate", "object").agg(F.sort_array(F.collect_list(item)).alias("s"))
    rest = F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0)))
    return d.select("subject", "predicate", "object", F.aggregate(rest, F.col("s")[0]["confidence"], lambda a, x: (a + x["confidence"]) / 2).alias("confidence"))


def dedup_triples_best(triples: DataFrame) -> DataFrame:
    """The most confident of equal triples; later, not better ones add the properties that it lacks."""
    item = F.struct("ord", "confidence", F.map_entries("properties").alias("p"))
    d = triples.groupBy("subject", "predicate", "object").agg(F.sort_array(F.collect_list(F.struct("ord", "confidence"))).alias("s"), F.collect_list(item).alias("items"))
    ordered = F.array_sort("items", lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))

    def fold(a: Column, x: Column) -> Column:
        old = F.transform(a["p"], lambda e: e["key"])
        more = F.filter(x["p"], lambda e: ~F.array_contains(old, e["key"]))
        better = x["confidence"] > a["confidence"]
        return F.struct(F.when(better, x["ord"]).otherwise(a["ord"]).alias("ord"), F.when(better, x["confidence"]).otherwise(a["confidence"]).alias("confidence"), F.when(better, x["p"]).otherwise(F.concat(a["p"], more)).alias("p"))

    best = F.aggregate(F.slice(ordered, 2, F.greatest(F.size("items") - 1, F.lit(0))), ordered[0], fold)
    d = d.select("subject", "predicate", "object", best.alias("b"))
    return d.select("subject", "predicate", "object", "b.confidence", F.map_from_entries("b.p").alias("properties"))


def boosted(triples: DataFrame, entities: DataFrame, n_contracts: DataFrame) -> DataFrame:
    """Confidence raised by the number of entity rows that name each end."""
    counts = entities.groupBy("id").agg(F.count("*").alias("n"))
    d = triples
    for c in ("subject", "object"):
        d = d.join(counts.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")), c, "left").withColumn(f"n_{c}", F.coalesce(f"n_{c}", F.lit(0)))
    d = d.crossJoin(F.broadcast(n_contracts))
    return d.withColumn("confidence", scores.boost(F.col("confidence"), F.col("n_subject"), F.col("n_object"), F.col("n_contracts"))).drop("n_subject", "n_object", "n_contracts")


def canonical_score(name: Column, kind: Column, properties: Column, article: int = 20, capital: int = 10, brackets: int = 5, suffix: int = 15) -> Column:
    """Longer names without an article or brackets, with a capital and a company form, make better canonical names."""
    s = F.char_length(name) + F.when(F.lower(name).rlike("^(the|a|an) "), 0).otherwise(article) + F.when(F.substring(name, 1, 1).rlike(r"^\p{Lu}"), capital).otherwise(0)
    s = s - F.lit(brackets) * (F.char_length(name) - F.char_length(F.translate(name, "()[]{}\"'", ""))) + F.coalesce(F.size(properties), F.lit(0)) * 2
    return s + F.when((kind == "Party") & name.rlike(r"( Inc\.| LLC| Ltd\.| Corp\.| Corporation)$"), suffix).otherwise(0)


def cluster(entities: DataFrame, threshold: float | None = None, embedding: str = "embedding") -> DataFrame:
    """id, ord, leader_id by greedy leaders within each type: each unclaimed entity in order claims all later unclaimed ones near it.

    ``None`` takes each type's own threshold. See ``similarity.leader_clusters``.
    """
    if threshold is not None:
        own = F.lit(float(threshold))
    else:
        known = F.create_map(*[F.lit(x) for kv in dims.AGGREGATION_THRESHOLDS.items() for x in kv])
        own = F.coalesce(F.element_at(known, F.col("type")), F.lit(dims.DEFAULT_AGGREGATION_THRESHOLD))
    return similarity.leader_clusters(entities, F.col("type"), own, embedding)


KMEANS_LEAST, KMEANS_MOST = 20, 128  # fixed values


def kmeans_size(n: int) -> int:
    """How many clusters n vectors are put into where none is named: the root of n, 2 at least and 128 at most; n itself where that is no fewer."""
    return min(n, min(KMEANS_MOST, max(2, int(n**0.5))))


def cluster_vectors(vectors: DataFrame, k: int | None = None, id_col: str = "id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """id and cluster by k-means; with as many clusters as rows or more, each row is its own. Rows without a usable vector are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = vectors.where(similarity.usable(F.col(vector))).select(F.col(id_col).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    n = d.count()
    k = kmeans_size(n) if k is None else k
    if k >= n:
        return d.select("id", F.col("id").cast("string").alias("cluster"))
    return KMeans(k=k, seed=seed).fit(d).transform(d).select("id", F.col("prediction").cast("string").alias("cluster"))


def find_duplicates(entities: DataFrame, threshold: float | None = None, embedding: str = "embedding") -> DataFrame:
    """id, leader_id and size of groups of two or more similar entities, all types mixed; a threshold of 0 or none is the default one."""
    mixed = similarity.leader_clusters(entities, F.lit("any"), F.lit(float(threshold or dims.RESOLUTION_THRESHOLD)), embedding)
    sizes = mixed.groupBy("leader_id").agg(F.count("*").alias("n")).where("n >= 2")
    return mixed.join(sizes, "leader_id").select("id", "leader_id", "n")


def item_texts(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Search texts of entities and triples under one another: "name (type)" and "subject predicate object"."""
    a = entities.select(F.lit("entity").alias("kind"), F.col("id").alias("key"), F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("text"))
    said = F.lower(F.replace("predicate", F.lit("_"), F.lit(" ")))
    return a.unionAll(triples.select(F.lit("triple"), F.col("ord").cast("string"), F.concat("subject", F.lit(" "), said, F.lit(" "), "object")))


def cluster_kmeans(entities: DataFrame, embedding: str = "embedding", seed: int = 42) -> DataFrame:
    """Clusters by k-means within each type, with the best silhouette of three sizes near the root of n; every cluster becomes one entity.

    Types of fewer than ``KMEANS_LEAST`` entities are left as they are.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    d = entities.select("id", "type", array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    out = d.limit(0).select("id", "type", F.col("id").alias("leader_id"))
    for kind, n in sorted((r["type"], r["n"]) for r in d.where("type IS NOT NULL").groupBy("type").agg(F.count("*").alias("n")).collect()):  # types are few
        own, best = d.where(F.col("type") == kind), None
        for k in (int(n**0.5) - 1, int(n**0.5), int(n**0.5) + 1):
            if n >= KMEANS_LEAST and 2 <= k < n:
                found = KMeans(k=k, seed=seed).fit(own).transform(own)
                grade = ClusteringEvaluator().evaluate(found)
                if best is None or grade > best[0]:
                    best = (grade, found)
        leader = F.min("id").over(Window.partitionBy("prediction")) if best else F.col("id")
        out = out.unionByName((best[1] if best else own).select("id", "type", leader.alias("leader_id")))
    return out


def choose_canonical(entities: DataFrame, clusters: DataFrame, for_aggregation: bool = False) -> DataFrame:
    """old_id, canonical_id: of each cluster the entity of the best name, the first among equals."""
    weights = {"article": 10, "capital": 5, "brackets": 0, "suffix": 0} if for_aggregation else {}
    d = entities.join(clusters.select("id", "leader_id"), "id")
    d = d.withColumn("s", canonical_score(F.col("name"), F.col("type"), F.col("properties"), **weights))
    best = d.groupBy("leader_id").agg(F.max_by("id", F.struct("s", -F.col("ord"))).alias("canonical_id"))
    return clusters.join(best, "leader_id").select(F.col("id").alias("old_id"), "canonical_id")


def choose_named(entities: DataFrame, clusters: DataFrame, replies: DataFrame, model: str = "none") -> DataFrame:
    """old_id, canonical_id, canonical_name: the name that a reply picks for a cluster of two or more, by the prompt of its sorted names.

    The entity of that name is canonical, the first among equals; where no entity has it, the first entity takes the name. Without a reply the best name is
    chosen as ``choose_canonical`` does. A reply is a JSON object with "canonical".
    """
    from clausework.operators.providers import prompt_key, with_reply

    d = entities.join(clusters.select("id", "leader_id"), "id").select("leader_id", "id", "name", "ord")
    groups = d.groupBy("leader_id").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("n"), F.min_by("id", "ord").alias("first"))
    said = with_reply(groups, replies, F.when(F.col("n") > 1, prompt_key(model, F.array_join("names", "\n")))).withColumn("named", F.get_json_object(text.fenced_json(F.col("reply")), "$.canonical")).select("leader_id", "first", "named")
    of_name = d.join(said, "leader_id").where("name = named").groupBy("leader_id").agg(F.min_by("id", "ord").alias("match"))
    best = choose_canonical(entities, clusters).join(clusters.select(F.col("id").alias("old_id"), "leader_id"), "old_id").join(said, "leader_id").join(of_name, "leader_id", "left")
    best = best.withColumn("canonical_id", F.when(F.col("named").isNull(), F.col("canonical_id")).otherwise(F.coalesce("match", "first")))
    names = entities.select(F.col("id").alias("canonical_id"), F.col("name").alias("own_name"))
    return best.join(names, "canonical_id").select("old_id", "canonical_id", F.when(F.col("named").isNotNull() & F.col("match").isNull(), F.col("named")).otherwise(F.col("own_name")).alias("canonical_name"))


def aliases(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """canonical_id and the sorted names that it replaces."""
    d = mapping.where("old_id <> canonical_id").join(entities.select(F.col("id").alias("old_id"), "name"), "old_id")
    return d.groupBy("canonical_id").agg(F.sort_array(F.collect_set("name")).alias("aliases"))


def reduction(mapping: DataFrame) -> DataFrame:
    return mapping.agg(F.count("*").alias("original"), F.count_distinct("canonical_id").alias("merged")).withColumn("reduction_rate", 1.0 - F.col("merged") / F.greatest("original", F.lit(1)))


class Merged(NamedTuple):
    """What resolution or aggregation gives: entities left, their triples, old_id and canonical_id, names replaced, and totals."""

    entities: DataFrame
    triples: DataFrame
    mapping: DataFrame
    aliases: DataFrame
    totals: DataFrame


def with_name_vectors(entities: DataFrame, column: str = "embedding") -> DataFrame:
    """Entities with a vector of "type: name"."""
    return entities.withColumn(column, text.trigram_vector(F.concat("type", F.lit(": "), "name")))


def _merge(entities: DataFrame, triples: DataFrame, clusters: DataFrame, for_aggregation: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    mapping = cut(choose_canonical(entities, clusters, for_aggregation))
    left = entities.join(mapping.where("old_id = canonical_id").select(F.col("old_id").alias("id")).distinct(), "id", "left_semi")
    return left, remap(triples, mapping.where("old_id <> canonical_id")), mapping


def resolve(entities: DataFrame, triples: DataFrame, threshold: float | None = None, embedding: str = "embedding") -> Merged:
    """Duplicates within each type become the entity of the best name; triples follow, equal ones once, with their confidences averaged in turn.

    Entities have ids of their own. A threshold of 0 or none is the default one. Totals: original, resolved, reduction_rate.
    """
    clusters = cluster(entities, threshold or dims.RESOLUTION_THRESHOLD, embedding)
    left, moved, mapping = _merge(entities, triples, clusters, for_aggregation=False)
    totals = reduction(mapping).select("original", F.col("merged").alias("resolved"), "reduction_rate")
    return Merged(left, dedup_triples_average(moved), mapping, aliases(entities, mapping), totals)


def aggregate(entities: DataFrame, triples: DataFrame, embedding: str = "embedding") -> Merged:
    """Extractions of many contracts as one: entities merged by their types' own thresholds, triples remapped, the best of equal ones kept,
    and confidences raised by how many entity rows name their ends.

    Totals: source_contracts, original_entities, original_triples, merged_entities, merged_triples, reduction_rate, and thresholds (by type).
    """
    clusters = cluster(entities, None, embedding)
    left, moved, mapping = _merge(entities, triples, clusters, for_aggregation=True)
    contracts = entities.select("contract_id").unionAll(triples.select("contract_id")).agg(F.count_distinct("contract_id").alias("n_contracts"))
    merged = cut(boosted(dedup_triples_best(moved), entities, contracts))
    own = dims.dim(entities.sparkSession, "dim_threshold")
    used = entities.select("type").distinct().join(F.broadcast(own), "type", "left").select("type", F.coalesce("threshold", F.lit(dims.DEFAULT_AGGREGATION_THRESHOLD)).alias("threshold"))
    thresholds = used.agg(F.sort_array(F.collect_list(F.struct("type", "threshold"))).alias("thresholds"))  # one for each type
    totals = contracts.select(F.col("n_contracts").alias("source_contracts"))
    for name, d in (("original_entities", entities), ("original_triples", triples), ("merged_entities", mapping.select("canonical_id").distinct()), ("merged_triples", merged)):
        totals = totals.crossJoin(d.agg(F.count("*").alias(name)))
    totals = totals.withColumn("reduction_rate", 1 - F.col("merged_entities") / F.greatest("original_entities", F.lit(1))).crossJoin(thresholds)
    return Merged(left, merged, mapping, aliases(entities, mapping), totals)


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", block: str | None = "label") -> DataFrame:
    """Pairs within a block whose cosine reaches the threshold; see ``similarity.cosine_pairs``."""
    return similarity.cosine_pairs(vectors, threshold, key, block)


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each type and id, the last written."""
    w = Window.partitionBy("type", "id").orderBy(F.desc("ord"))
    return nodes.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def upsert_edges(triples: DataFrame) -> DataFrame:
    """One relationship for each subject, edge type and object, the last written."""
    d = triples.withColumn("edge_type", text.edge_type(F.col("predicate")))
    w = Window.partitionBy("subject", "edge_type", "object").orderBy(F.desc("ord"))
    return d.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """Violations of one node for each type and id."""
    return nodes.groupBy("type", "id").agg(F.count("*").alias("n")).where("n > 1")


def contract_graph(nodes: DataFrame, edges: DataFrame, contract_id: object) -> DataFrame:
    """Edges whose ends are both nodes of the contract."""
    own = nodes.where(F.col("contract_id") == contract_id).select("name").distinct()
    return edges.join(own.withColumnRenamed("name", "subject"), "subject").join(own.withColumnRenamed("name", "object"), "object").select("subject", "edge_type", "object")


def node_type_counts(nodes: DataFrame) -> DataFrame:
    n = nodes.groupBy("type").agg(F.count("*").alias("n"))
    return dims.dim(nodes.sparkSession, "dim_node_type").join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def from_analysis(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and valid triples of analysed clauses; ids are contract and name, every type is ContractClause."""
    e = clauses.select("contract_id", "label", F.explode("entities").alias("name"))
    e = e.select(F.concat_ws(":", F.col("contract_id").cast("string"), "name").alias("id"), "name", F.lit("ContractClause").alias("type"), "contract_id", "label")
    t = clauses.select("contract_id", "text", F.explode("relationships").alias("r")).select("contract_id", "r.subject", "r.predicate", "r.object", F.substring("text", 1, 200).alias("source_text"))
    return e, valid_triples(t)


def valid_triples(triples: DataFrame) -> DataFrame:
    return triples.where((F.col("subject") != "") & (F.col("predicate") != "") & (F.col("object") != ""))
