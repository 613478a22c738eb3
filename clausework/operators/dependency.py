"""Clause dependencies of every contract: edges, unmet requirements, and graph measures."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import dims


def _rules(df: DataFrame) -> DataFrame:
    return F.broadcast(dims.dim(df.sparkSession, "dim_dependency_rule"))


def edges(clauses: DataFrame) -> DataFrame:
    """All rules of which both labels are present."""
    present = clauses.select("contract_id", "label")
    left = present.join(_rules(clauses), F.col("label") == F.col("source")).drop("label")
    return left.join(present.withColumnRenamed("label", "target"), ["contract_id", "target"])


def missing_requirements(clauses: DataFrame) -> DataFrame:
    """Required labels that are absent while the requiring one is present."""
    present = clauses.select("contract_id", "label")
    need = present.join(_rules(clauses).where("dependency_type = 'REQUIRES'"), F.col("label") == F.col("source"))
    lacking = need.select("contract_id", F.col("source").alias("required_by"), F.col("target").alias("label"), "strength").join(present, ["contract_id", "label"], "left_anti")
    return lacking.select("contract_id", "required_by", F.col("label").alias("missing_label"), "strength", F.when(F.col("strength") >= 0.8, "HIGH").otherwise("MEDIUM").alias("severity"))


def graph(edge_list: DataFrame) -> DataFrame:
    """Directed edges: two-way rules both ways; of repeated pairs the last rule's attributes, the first one's place."""
    cols = ["contract_id", "rule_ord", "dependency_type", "strength"]
    forward = edge_list.select(F.col("source").alias("u"), F.col("target").alias("v"), *cols, (F.col("rule_ord") * 2).alias("ord"))
    back = edge_list.where("bidirectional").select(F.col("target").alias("u"), F.col("source").alias("v"), *cols, (F.col("rule_ord") * 2 + 1).alias("ord"))
    last = F.max_by(F.struct("dependency_type", "strength"), F.col("ord")).alias("a")
    d = forward.unionByName(back).groupBy("contract_id", "u", "v").agg(last, F.min("ord").alias("ord"))
    return d.select("contract_id", "u", "v", "a.dependency_type", "a.strength", "ord")


def contradictions(g: DataFrame) -> DataFrame:
    """Conflicting pairs, once each, in the direction seen first."""
    w = Window.partitionBy("contract_id", F.least("u", "v"), F.greatest("u", "v")).orderBy("ord")
    d = g.where("dependency_type = 'CONFLICTS_WITH'").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return d.select("contract_id", F.col("u").alias("clause_a"), F.col("v").alias("clause_b"), "strength")


def impact(g: DataFrame, starts: DataFrame, max_hops: int = 3) -> DataFrame:
    """Labels reached from each start within ``max_hops``, at their least depth; via is the first parent in queue order.

    ``starts`` has contract_id and start. A level keeps for each label reached the path that a queue would find first.
    """
    e = g.select("contract_id", F.col("u").alias("at"), F.col("v").alias("label"), "dependency_type", "strength", F.col("ord").alias("edge_ord"))
    level = starts.select("contract_id", "start", F.col("start").alias("at"), F.array(F.lit(0).cast("int")).alias("path"))
    seen = starts.select("contract_id", "start", F.col("start").alias("label"))
    out = None
    for depth in range(1, max_hops + 1):
        step = level.join(e, ["contract_id", "at"]).withColumn("path", F.concat("path", F.array("edge_ord"))).join(seen, ["contract_id", "start", "label"], "left_anti")
        w = Window.partitionBy("contract_id", "start", "label").orderBy("path")
        step = step.withColumn("rn", F.row_number().over(w)).where("rn = 1")
        found = step.select("contract_id", "start", "label", F.lit(depth).alias("depth"), F.col("at").alias("via"), "dependency_type", "strength")
        out = found if out is None else out.unionByName(found)
        seen = seen.unionByName(found.select("contract_id", "start", "label"))
        level = step.select("contract_id", "start", F.col("label").alias("at"), "path")
    return out


def impact_ranking(impacts: DataFrame, nodes: DataFrame) -> DataFrame:
    reached = impacts.groupBy("contract_id", F.col("start").alias("label")).agg(F.count("*").alias("total_affected"), F.max("depth").alias("max_depth"))
    return nodes.select("contract_id", "label").join(reached, ["contract_id", "label"], "left").fillna(0, ["total_affected", "max_depth"])


def centrality(g: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree over n - 1; a graph of one node has 1."""
    ends = g.select("contract_id", F.col("u").alias("label")).unionAll(g.select("contract_id", F.col("v").alias("label"))).groupBy("contract_id", "label").agg(F.count("*").alias("degree"))
    n = nodes.groupBy("contract_id").agg(F.count("*").alias("n"))
    d = nodes.select("contract_id", "label").join(ends, ["contract_id", "label"], "left").join(n, "contract_id")
    return d.select("contract_id", "label", F.when(F.col("n") <= 1, 1.0).otherwise(F.coalesce("degree", F.lit(0)) / (F.col("n") - 1)).alias("centrality"))


def max_impact(g: DataFrame, nodes: DataFrame) -> DataFrame:
    """The label with most outgoing edges, the earliest clause among equals, empty without edges."""
    outs = g.groupBy("contract_id", F.col("u").alias("label")).agg(F.count("*").alias("out_degree"))
    d = nodes.select("contract_id", "label", "clause_index").join(outs, ["contract_id", "label"], "left").withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))
    best = d.groupBy("contract_id").agg(F.max_by("label", F.struct("out_degree", -F.col("clause_index"))).alias("label"), F.max("out_degree").alias("out_degree"))
    return best.select("contract_id", F.when(F.col("out_degree") > 0, F.col("label")).otherwise("").alias("label"), "out_degree")


def simple_cycles(adjacent: dict[str, list[str]], least: int = 3) -> list[tuple[str, ...]]:
    """Simple cycles of at least ``least`` nodes, each from its least node on."""
    out = []
    for start in sorted(adjacent):
        stack = [(start, (start,))]
        while stack:
            at, path = stack.pop()
            for x in adjacent.get(at, ()):
                if x == start and len(path) >= least:
                    out.append(path)
                elif x > start and x not in path:
                    stack.append((x, (*path, x)))
    return out


def cycles(g: DataFrame) -> DataFrame:
    """Simple cycles of three labels or more of every contract, from the least label on.

    Edges come from the rules alone, so the cycles of the rules are listed once; a contract has those of which it has all edges.
    """
    adjacent = defaultdict(set)
    for r in dims.dim(g.sparkSession, "dim_dependency_rule").select("source", "target", "bidirectional").collect():  # a dimension of under 200 rows
        adjacent[r.source].add(r.target)
        if r.bidirectional:
            adjacent[r.target].add(r.source)
    known = [(" -> ".join(c), len(c), u, v) for c in simple_cycles({u: sorted(vs) for u, vs in adjacent.items()}) for u, v in zip(c, (*c[1:], c[0]), strict=True)]
    steps = g.sparkSession.createDataFrame(known, "cycle string, length long, u string, v string")
    whole = g.select("contract_id", "u", "v").distinct().join(F.broadcast(steps), ["u", "v"]).groupBy("contract_id", "cycle", "length").agg(F.count("*").alias("n"))
    return whole.where("n = length").select("contract_id", "cycle", "length")


def amplifiers(conflicts: DataFrame, missing: DataFrame, loops: DataFrame) -> DataFrame:
    """Counts of contradictions, unmet high requirements and cycles for each contract."""
    kinds = [("contradictions", conflicts), ("missing_requirements", missing.where("severity = 'HIGH'")), ("circular_dependencies", loops)]
    parts = [d.groupBy("contract_id").agg(F.count("*").alias("n")).select("contract_id", F.lit(k).alias("amplifier"), "n") for k, d in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def risk_adjustment(conflicts: DataFrame, missing: DataFrame, loops: DataFrame) -> DataFrame:
    """At most 40: ten times the strength of each contradiction cut to whole points, 8 or 5 per unmet requirement, 3 per cycle."""
    points = conflicts.select("contract_id", (F.col("strength") * 10).cast("int").alias("p"))
    points = points.unionByName(missing.select("contract_id", F.when(F.col("severity") == "HIGH", 8).otherwise(5).alias("p"))).unionByName(loops.select("contract_id", F.lit(3).alias("p")))
    return points.groupBy("contract_id").agg(F.least(F.lit(40), F.sum("p")).cast("int").alias("adjustment"))


def needs_validation(edge_list: DataFrame) -> DataFrame:
    """Edges of label pairs that any rule flags for reading."""
    flagged = _rules(edge_list).where("needs_validation").select("source", "target").distinct()
    return edge_list.join(F.broadcast(flagged), ["source", "target"], "left_semi")


def recommendations(conflicts: DataFrame, missing: DataFrame, loops: DataFrame, central: DataFrame) -> DataFrame:
    """Advice in order: conflicts, unmet high requirements, pooled medium ones, cycles, central clauses."""
    a = conflicts.select("contract_id", F.lit(1).alias("part"), F.format_string("Reconcile %s with %s", "clause_a", "clause_b").alias("advice"))
    b = missing.where("severity = 'HIGH'").select("contract_id", F.lit(2).alias("part"), F.format_string("Add %s, which %s requires", "missing_label", "required_by").alias("advice"))
    w = Window.partitionBy("contract_id").orderBy("missing_label", "required_by")
    medium = missing.where("severity = 'MEDIUM'").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    c = medium.groupBy("contract_id").agg(F.array_join(F.sort_array(F.collect_list("missing_label")), ", ").alias("x")).select("contract_id", F.lit(3).alias("part"), F.concat(F.lit("Consider adding "), "x").alias("advice"))
    d = loops.select("contract_id", F.lit(4).alias("part"), F.concat(F.lit("Break the cycle "), "cycle").alias("advice"))
    top = central.withColumn("rn", F.row_number().over(Window.partitionBy("contract_id").orderBy(F.desc("centrality"), "label"))).where("rn <= 3 AND centrality > 0.3")
    e = top.groupBy("contract_id").agg(F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("x")).select("contract_id", F.lit(5).alias("part"), F.concat(F.lit("Change with care: "), "x").alias("advice"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


def report(nodes: DataFrame, edge_list: DataFrame, g: DataFrame, conflicts: DataFrame, missing: DataFrame, loops: DataFrame) -> DataFrame:
    """One row for each contract: counts of labels, edges, graph edges, contradictions, unmet requirements and cycles."""
    out = nodes.groupBy("contract_id").agg(F.count("*").alias("labels"))
    for name, d in (("dependencies", edge_list), ("graph_edges", g), ("contradictions", conflicts), ("missing_requirements", missing), ("cycles", loops)):
        out = out.join(d.groupBy("contract_id").agg(F.count("*").alias(name)), "contract_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out
