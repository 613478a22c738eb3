"""Measures of dependency graphs, worked out once for each distinct set of labels.

A contract's graph is that of the rules between the labels that it has, so contracts with the same labels have the same graph. A set of labels is a
64-bit mask with a bit for each label in order of name; the measures are native functions of a mask, and join back to the contracts.
Rows without a contract or with labels that are not in the dimension are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import dims


class _Rules:
    """Labels in order of name and the directed edges of the rules between them."""

    def __init__(self, spark: SparkSession):
        self.labels = sorted(r.label for r in dims.dim(spark, "dim_label").select("label").collect())  # a dimension of 40 rows
        place, self.edges = {x: i for i, x in enumerate(self.labels)}, {}
        for r in dims.dim(spark, "dim_dependency_rule").orderBy("rule_ord").collect():  # and one of under 200
            ends = [(r.source, r.target, 2 * r.rule_ord)] + [(r.target, r.source, 2 * r.rule_ord + 1)] * bool(r.bidirectional)
            for u, v, at in ends:
                # of repeated pairs the last rule's values, the first one's place
                self.edges[u, v] = (r.dependency_type, r.strength, self.edges.get((u, v), (None, None, at))[2])
        self.out, self.around = [0] * len(place), [0] * len(place)
        for u, v in self.edges:
            self.out[place[u]] |= 1 << place[v]
            self.around[place[u]] |= 1 << place[v]
            self.around[place[v]] |= 1 << place[u]

    def names(self) -> str:
        return "array(" + ", ".join("'" + x.replace("'", "''") + "'" for x in self.labels) + ")"


def masks(clauses: DataFrame) -> DataFrame:
    """contract_id and the mask of its labels."""
    rules = _Rules(clauses.sparkSession)
    bits = F.broadcast(clauses.sparkSession.createDataFrame([(x, 1 << i) for i, x in enumerate(rules.labels)], "label string, bit long"))
    return clauses.where("contract_id IS NOT NULL").select("contract_id", "label").join(bits, "label").groupBy("contract_id").agg(F.bit_or("bit").alias("mask"))


def _longs(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" for v in values) + ")"


def _nodes(rules: _Rules) -> str:
    return f"filter(sequence(0, {len(rules.labels) - 1}), b -> (shiftright(mask, b) & 1) = 1)"


def components(clauses: DataFrame) -> DataFrame:
    """contract_id, label and component: the least label that its links reach, whatever their direction."""
    rules, own = _Rules(clauses.sparkSession), masks(clauses)
    each = own.select("mask").distinct().selectExpr("mask", f"{_nodes(rules)} AS nodes", f"{_longs(rules.around)} AS around")
    each = each.selectExpr("mask", "nodes", "transform(nodes, b -> around[b] & mask) AS links", "explode(nodes) AS b")
    grown = "aggregate(sequence(0, size(nodes) - 1), reach, (r, i) -> r | if((r & shiftleft(1L, nodes[i])) <> 0, links[i], 0L))"
    reach = f"aggregate(nodes, shiftleft(1L, b), (reach, k) -> {grown})"
    least = each.selectExpr("mask", "b", f"{reach} AS reach").selectExpr("mask", f"{rules.names()}[b] AS label", f"{rules.names()}[cast(log2(cast(reach & -reach AS double)) AS int)] AS component")
    return own.join(least, "mask").select("contract_id", "label", "component")


def betweenness(clauses: DataFrame) -> DataFrame:
    """contract_id, label and betweenness: the share of shortest directed paths through it, over (n - 1)(n - 2).

    For each label as a start the graph is walked by levels with the numbers of shortest paths, and back from the last level with
    the share that each label takes of those beyond it.
    """
    rules, own = _Rules(clauses.sparkSession), masks(clauses)
    each = own.select("mask").distinct().selectExpr("mask", f"{_nodes(rules)} AS nodes", f"{_longs(rules.out)} AS out")
    each = each.selectExpr("mask", "nodes", "transform(nodes, b -> out[b] & mask) AS links", "explode(nodes) AS s")
    places = "sequence(0, size(nodes) - 1)"
    following = f"aggregate({places}, 0L, (r, i) -> r | if((a.front & shiftleft(1L, nodes[i])) <> 0, links[i], 0L)) & ~a.seen"
    paths = f"transform(nodes, (b, j) -> if((shiftleft(1L, b) & n) <> 0, aggregate({places}, 0D, (t, i) -> t + if((a.front & shiftleft(1L, nodes[i])) <> 0 AND (links[i] & shiftleft(1L, b)) <> 0, a.paths[i], 0D)), a.paths[j]))"
    start = "named_struct('seen', shiftleft(1L, s), 'front', shiftleft(1L, s), 'paths', transform(nodes, b -> if(b = s, 1D, 0D)), 'levels', array(shiftleft(1L, s)))"
    # the array of one binds the next level, so that it is found once
    step = f"transform(array({following}), n -> named_struct('seen', a.seen | n, 'front', n, 'paths', {paths}, 'levels', array_append(a.levels, n)))[0]"
    walked = each.selectExpr("mask", "nodes", "links", "s", f"aggregate(nodes, {start}, (a, k) -> {step}) AS w")
    share = f"aggregate({places}, 0D, (t, j) -> t + if((links[i] & w.levels[k + 1] & shiftleft(1L, nodes[j])) <> 0, w.paths[i] / w.paths[j] * (1 + c[j]), 0D))"
    back = f"aggregate(sequence(size(nodes) - 1, 0, -1), transform(nodes, b -> 0D), (c, k) -> transform(nodes, (b, i) -> if((shiftleft(1L, b) & w.levels[k]) <> 0, {share}, c[i])))"
    credit = walked.selectExpr("mask", "nodes", "s", f"{back} AS credit").selectExpr("mask", "size(nodes) AS n", "s", "explode(arrays_zip(nodes, credit)) AS x")
    total = credit.selectExpr("mask", "n", "x.nodes AS b", "if(x.nodes = s, 0D, x.credit) AS credit").groupBy("mask", "n", "b").agg(F.sum("credit").alias("credit"))
    done = total.selectExpr("mask", f"{rules.names()}[b] AS label", "if(n > 2, credit / ((n - 1) * (n - 2)), 0D) AS betweenness")
    return own.join(done, "mask").select("contract_id", "label", "betweenness")


def order_of(labels: list[str], edges: dict[tuple[str, str], tuple[str, float, int]]) -> list[str]:
    """Labels so that edges lead forward, without conflicts, the earliest free one first; while a cycle is left, its weakest edge is dropped."""
    inside, left, out = set(labels), list(labels), []
    live = {e: x[1] for e, x in sorted(edges.items(), key=lambda i: i[1][2]) if e[0] in inside and e[1] in inside and x[0] != "CONFLICTS_WITH"}
    while left:
        into = {v for u, v in live if u in left and v in left}
        free = next((x for x in left if x not in into), None)
        if free is not None:
            out.append(free)
            left.remove(free)
            continue
        at, path = left[0], []
        while at not in path:
            path.append(at)
            at = next(u for u, v in live if v == at and u in left)
        loop = [*path[path.index(at) :], at]
        live.pop(min(zip(loop[1:], loop, strict=False), key=lambda e: (live[e], e)))
    return out


def topological_order(clauses: DataFrame) -> DataFrame:
    """contract_id, label, position: see ``order_of``; labels come in order of their clauses. Worked out once for each distinct list of labels."""
    edges = _Rules(clauses.sparkSession).edges
    lists = clauses.where("contract_id IS NOT NULL").groupBy("contract_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("clause_index", "label"))), lambda x: x["label"]).alias("labels"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"labels": pdf["labels"], "sorted": [order_of(list(x), edges) for x in pdf["labels"]]})

    ordered = lists.select("labels").distinct().mapInPandas(run, "labels array<string>, sorted array<string>")
    return lists.join(ordered, "labels").select("contract_id", F.posexplode("sorted").alias("position", "label")).select("contract_id", "label", F.col("position").cast("long").alias("position"))
