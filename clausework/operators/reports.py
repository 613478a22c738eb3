"""A contract's analysis as one nested document: its clauses, risk with findings, and dependencies with what follows from them.

Documents are VARIANT values, so that they are stored once and read by path; ``as_json`` writes them as text. Lists come in a stated order, and
a contract without any of something has an empty list.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import dims, scores
from clausework.operators import dependency, risk

PREVIEW = 200


class _Rules:
    """What the rules can give any contract, as constant arrays in the documents' order, each item with the labels that it needs.

    A label is a bit in order of name. Edges, contradictions and cycles between some labels are the same wherever all of these are, so they are
    found once, and a contract has those whose labels it has. The dimensions have under 200 rows in all.
    """

    def __init__(self, spark: SparkSession):
        rules = dims.dim(spark, "dim_dependency_rule").orderBy("rule_ord").collect()
        lacks = dims.dim(spark, "dim_missing_rule").select("label", "severity").collect()
        labels = {r.label for r in dims.dim(spark, "dim_label").select("label").collect()}
        self.labels = sorted(labels | {x for r in rules for x in (r.source, r.target)} | {r.label for r in lacks})
        bit = {x: 1 << i for i, x in enumerate(self.labels)}
        graph: dict[tuple[str, str], tuple[str, float, int]] = {}
        for r in rules:
            for u, v, at in [(r.source, r.target, 2 * r.rule_ord)] + [(r.target, r.source, 2 * r.rule_ord + 1)] * bool(r.bidirectional):
                # of repeated pairs the last rule's values, the first one's place
                graph[u, v] = (r.dependency_type, r.strength, graph.get((u, v), (None, None, at))[2])
        out, into = dict.fromkeys(self.labels, 0), dict.fromkeys(self.labels, 0)
        adjacent: dict[str, list[str]] = {}
        for u, v in sorted(graph):
            out[u] |= bit[v]
            into[v] |= bit[u]
            adjacent.setdefault(u, []).append(v)
        pairs: dict[frozenset[str], tuple[str, str, float]] = {}
        for (u, v), (kind, strength, _) in sorted(graph.items(), key=lambda e: e[1][2]):
            if kind == "CONFLICTS_WITH":
                pairs.setdefault(frozenset((u, v)), (u, v, strength))
        need = sorted((r.source, r.target, "HIGH" if r.strength >= 0.8 else "MEDIUM") for r in rules if r.dependency_type == "REQUIRES")
        self.out, self.into = (_constant([x[b] for b in self.labels], "array<long>") for x in (out, into))
        self.edges = _constant(
            [{"need": bit[r.source] | bit[r.target], "item": {"bidirectional": r.bidirectional, "dependency_type": r.dependency_type, "source_label": r.source, "strength": r.strength, "target_label": r.target}} for r in rules],
            "array<struct<need: long, item: struct<bidirectional: boolean, dependency_type: string, source_label: string, strength: double, target_label: string>>>")
        self.conflicts = _constant([{"need": bit[u] | bit[v], "points": int(x * 10), "item": {"clause_a": u, "clause_b": v, "strength": x}} for u, v, x in sorted(pairs.values())], "array<struct<need: long, points: int, item: struct<clause_a: string, clause_b: string, strength: double>>>")
        self.missing = _constant([{"need": bit[u], "lack": bit[v], "item": {"missing_label": v, "required_by": u, "severity": x}} for u, v, x in need], "array<struct<need: long, lack: long, item: struct<missing_label: string, required_by: string, severity: string>>>")
        self.cycles = _constant(
            sorted(({"need": sum(bit[x] for x in c), "item": {"cycle": " -> ".join(c), "length": len(c)}} for c in dependency.simple_cycles(adjacent)), key=lambda x: x["item"]["cycle"]),
            "array<struct<need: long, item: struct<cycle: string, length: long>>>")
        self.lacks = _constant([{"lack": bit[r.label], "label": r.label, "severity": r.severity} for r in lacks], "array<struct<lack: long, label: string, severity: string>>")

    def places(self, spark: SparkSession) -> DataFrame:
        return F.broadcast(spark.createDataFrame(list(enumerate(self.labels)), "place int, label string"))


def _constant(rows: list, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _within(rows: Column, mask: Column) -> Column:
    return F.filter(rows, lambda x: x["need"].bitwiseAND(mask) == x["need"])


def _items(rows: Column) -> Column:
    return F.transform(rows, lambda x: x["item"])


def _sorted(rows: Column, at: Callable[[Column], list[Column]], item: Callable[[Column], Column]) -> Column:
    return _items(F.sort_array(F.transform(rows, lambda x: F.struct(F.struct(*at(x)).alias("at"), item(x).alias("item")))))


def by_category(clauses: Column) -> Column:
    """For each category its labels with their confidences, in the clauses' order; a missing category is "Other"."""
    name = lambda x: F.coalesce(x["category"], F.lit("Other"))

    def one(category: Column) -> Column:
        own = F.filter(clauses, lambda x: name(x) == category)
        return F.struct(category.alias("category"), F.transform(own, lambda x: F.struct(x["confidence"].alias("confidence"), x["label"].alias("label"))).alias("labels"), F.size(own).cast("long").alias("n"))

    return F.transform(F.sort_array(F.array_distinct(F.transform(clauses, name))), one)


def reached(start: Column, nodes: Column, mask: Column, out: Column, max_hops: int = 3) -> tuple[Column, Column]:
    """How many labels a start reaches within ``max_hops``, and at what depth the last of them."""
    first = F.struct(_bit(start).alias("seen"), _bit(start).alias("front"), F.lit(0).alias("depth"))

    def hop(state: Column, depth: Column) -> Column:
        ahead = F.aggregate(nodes, F.lit(0).cast("long"), lambda r, b: F.when(state["front"].bitwiseAND(_bit(b)) != 0, r.bitwiseOR(F.get(out, b))).otherwise(r))
        # the array of one binds the next level, so that it is found once
        return F.get(F.transform(F.array(ahead.bitwiseAND(mask).bitwiseAND(F.bitwise_not(state["seen"]))), lambda n: F.struct(state["seen"].bitwiseOR(n).alias("seen"), n.alias("front"), F.when(n != 0, depth).otherwise(state["depth"]).alias("depth"))), F.lit(0))

    end = F.aggregate(F.lit(list(range(1, max_hops + 1))), first, hop)
    return F.bit_count(end["seen"]).cast("long") - 1, end["depth"]


def interdependency(d: DataFrame, rules: _Rules) -> DataFrame:
    """``d``, which has ``nodes`` (label, place) and ``mask``, with interdependency: edges, contradictions, unmet requirements, cycles, impacts,
    amplifiers, advice, the adjustment and centralities. All follow from the labels of the row itself, so nothing is shuffled."""
    mask = F.col("mask")
    d = d.withColumns({"conflicts": _within(rules.conflicts, mask), "loops": _items(_within(rules.cycles, mask)), "missing": _items(F.filter(_within(rules.missing, mask), lambda x: x["lack"].bitwiseAND(mask) == 0)), "places": F.filter(F.transform("nodes", lambda x: x["place"]), lambda x: x.isNotNull())})
    degree = lambda b: F.coalesce(F.bit_count(F.get(rules.out, b).bitwiseAND(mask)) + F.bit_count(F.get(rules.into, b).bitwiseAND(mask)), F.lit(0))
    central = F.transform("nodes", lambda x: F.struct(F.when(F.size("nodes") <= 1, 1.0).otherwise(degree(x["place"]) / (F.size("nodes") - 1)).alias("centrality"), x["label"].alias("label")))

    def impact(x: Column) -> Column:
        total, depth = reached(x["place"], F.col("places"), mask, rules.out)
        return F.transform(F.array(F.struct(total.alias("n"), depth.alias("depth"))), lambda r: F.struct(x["label"].alias("label"), r["depth"].alias("max_depth"), r["n"].alias("total_affected")))

    impacts = F.flatten(F.transform(F.filter("nodes", lambda x: x["place"].isNotNull()), impact))
    d = d.withColumns({"conflict_items": _items(F.col("conflicts")), "centrality_scores": central, "impacts": F.filter(impacts, lambda x: x["total_affected"] > 0)})
    high, medium = F.filter("missing", lambda x: x["severity"] == "HIGH"), F.filter("missing", lambda x: x["severity"] == "MEDIUM")
    counts = [("circular_dependencies", F.col("loops")), ("contradictions", F.col("conflicts")), ("missing_requirements", high)]
    amplifiers = F.filter(F.array(*[F.struct(F.lit(k).alias("amplifier"), F.size(x).cast("long").alias("n")) for k, x in counts]), lambda x: x["n"] > 0)
    said = lambda part, rows: F.transform(F.sort_array(rows), lambda x: F.struct(x.alias("advice"), F.lit(part).alias("part")))
    joined = lambda head, rows: F.when(F.size(rows) > 0, F.array(F.concat(F.lit(head), F.array_join(F.sort_array(rows), ", ")))).otherwise(F.array().cast("array<string>"))
    top = F.slice(F.sort_array(F.transform("centrality_scores", lambda x: F.struct((-x["centrality"]).alias("down"), x["label"].alias("label")))), 1, 3)
    advice = F.concat(
        said(1, F.transform("conflict_items", lambda x: F.format_string("Reconcile %s with %s", x["clause_a"], x["clause_b"]))),
        said(2, F.transform(high, lambda x: F.format_string("Add %s, which %s requires", x["missing_label"], x["required_by"]))),
        said(3, joined("Consider adding ", F.transform(F.slice(F.sort_array(medium), 1, 5), lambda x: x["missing_label"]))),
        said(4, F.transform("loops", lambda x: F.concat(F.lit("Break the cycle "), x["cycle"]))),
        said(5, joined("Change with care: ", F.transform(F.filter(top, lambda x: x["down"] < -0.3), lambda x: x["label"]))),
    )
    points = lambda rows, of: F.aggregate(rows, F.lit(0), lambda a, x: a + of(x))
    adjustment = F.least(F.lit(40), points("conflicts", lambda x: x["points"]) + points("missing", lambda x: F.when(x["severity"] == "HIGH", 8).otherwise(5)) + 3 * F.size("loops"))
    found = {
        "centrality_scores": F.col("centrality_scores"), "contradictions": F.col("conflict_items"), "cycles": F.col("loops"), "edges": _items(_within(rules.edges, mask)),
        "impact_rankings": _sorted(F.col("impacts"), lambda x: [(-x["total_affected"]).alias("down"), x["label"].alias("label")], lambda x: x), "missing_requirements": F.col("missing"),
        "recommendations": advice, "risk_amplifiers": amplifiers, "risk_score_adjustment": adjustment,
    }
    return d.withColumn("interdependency", F.when(F.size("nodes") > 0, F.struct(*[c.alias(k) for k, c in found.items()])))


def documents(clauses: DataFrame, contracts: DataFrame, most_findings: int = 20) -> DataFrame:
    """contract_id and document, from the clauses (one for each label) and all contracts.

    ``by_category`` and ``key_findings``, the worst ``most_findings`` findings, are the summary. The risk score is raised by the dependencies' adjustment.
    Clauses and contracts are shuffled once, by contract; all else follows from a contract's own clauses, so nothing is stored on the way.
    """
    rules = _Rules(clauses.sparkSession)
    contracts = contracts.select("contract_id").distinct()
    text = F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW)
    own = clauses.where("contract_id IS NOT NULL")
    rated = risk.with_severity(own, "left").join(rules.places(clauses.sparkSession), "label", "left")
    rated = rated.select("contract_id", "place", F.struct((-F.col("confidence")).alias("down"), "label", "category", "confidence", text.alias("text_preview"), "severity", "place").alias("x"))
    each = rated.groupBy("contract_id").agg(F.collect_list("x").alias("rows"), F.bit_or(_bit(F.col("place"))).alias("mask"))
    d = contracts.join(each, "contract_id", "left").withColumns({"rows": F.sort_array(F.coalesce("rows", F.array().cast(each.schema["rows"].dataType))), "mask": F.coalesce("mask", F.lit(0).cast("long"))})
    d = d.withColumns({
        "clauses": F.transform("rows", lambda x: F.struct(x["category"], x["confidence"], x["label"], x["text_preview"])),
        "nodes": F.sort_array(F.transform("rows", lambda x: F.struct(x["label"], x["place"]))),
        "present": F.transform(F.filter("rows", lambda x: x["severity"].isNotNull()), lambda x: risk.finding(x["label"], x["severity"], x["confidence"], False)),
        "absent": F.transform(F.filter(rules.lacks, lambda x: x["lack"].bitwiseAND(F.col("mask")) == 0), lambda x: risk.finding(x["label"], x["severity"], F.lit(1.0), True)),
    })
    worst = lambda x: [(-risk.severity_weight(x["severity"])).alias("down"), x["kind"].alias("kind"), x["label"].alias("label")]
    d = d.withColumn("findings", _sorted(F.concat("present", "absent"), worst, lambda x: x))
    d = interdependency(d, rules)
    d = d.withColumn("total", F.aggregate("findings", F.lit(0).cast("decimal(24,6)"), lambda a, x: (a + F.coalesce(risk.points(x["kind"], x["severity"], x["confidence"]), F.lit(0))).cast("decimal(24,6)")))
    d = d.withColumn("score", F.least(F.lit(100), risk.score_of(F.col("total")) + F.coalesce("interdependency.risk_score_adjustment", F.lit(0)))).withColumn("level", scores.risk_band(F.col("score")))
    key = F.transform(F.slice("findings", 1, most_findings), lambda x: F.struct(x["label"].alias("label"), x["severity"].alias("severity")))
    document = F.struct(
        "clauses", F.col("contract_id"), F.col("interdependency"), F.struct("findings", "level", "score").alias("risk"),
        F.struct(by_category(F.col("clauses")).alias("by_category"), key.alias("key_findings"), F.size("clauses").alias("labels_found")).alias("summary"),
    )
    return d.select("contract_id", F.to_variant_object(document).alias("document"))


def as_json(docs: DataFrame) -> DataFrame:
    """contract_id and the document as JSON text, keys in order of name."""
    return docs.select("contract_id", F.to_json("document").alias("json"))


def paths(docs: DataFrame, **wanted: str) -> DataFrame:
    """contract_id and, for each name, the text at a path such as ``$.risk.level``; null where there is none."""
    return docs.select("contract_id", *[F.try_variant_get("document", p, "string").alias(n) for n, p in wanted.items()])
