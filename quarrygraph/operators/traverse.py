"""Bounded traversal: level-wise frontiers with distinct levels, minimum hops, call impact, traces and depth.

A level is one equi-join and one distinct or grouped minimum; it is written to the shared folder, so a plan never
holds more than a level and a lost executor repeats no more than one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clamp_depth, edge_types_for, is_test_path, resolution_score, risk_of
from ..schema import Graph
from ..session import settle

LIMIT, IMPACT_LIMIT = 100, 500


def _steps(graph: Graph, types: list[str] | None, inbound: bool) -> DataFrame:
    e = graph.edges if types is None else graph.edges.filter(F.col("type").isin(types))
    a, b = ("target_id", "source_id") if inbound else ("source_id", "target_id")
    return e.select(F.col(a).alias("node_id"), F.col(b).alias("next_id"))


def _levels(starts: DataFrame, steps: DataFrame, depth: int, key: list[str], visited: bool):
    """Frontiers of hop 1, 2, ...; with ``visited``, nodes seen at a smaller hop are left out."""
    frontier = seen = starts
    for hop in range(1, depth + 1):
        frontier = frontier.join(steps, "node_id").select(*key, F.col("next_id").alias("node_id")).distinct()
        if visited:
            frontier = frontier.join(seen, [*key, "node_id"], "left_anti")
        frontier = settle(frontier, "frontier")
        if frontier.isEmpty():
            return
        yield frontier.withColumn("hop", F.lit(hop))
        if visited:
            seen = seen.union(frontier.select(*key, "node_id"))


def _union(parts, starts: DataFrame, key: list[str]) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.union(p)
    return out if out is not None else starts.select(*key, "node_id", F.lit(0).alias("hop")).limit(0)


def bfs(graph: Graph, starts: DataFrame, depth: int = 3, types: list[str] | None = ("CALLS",), inbound: bool = False) -> DataFrame:
    """Distinct (node_id, hop) reached from the ids ``node_id`` of ``starts``. A node comes back at every hop at
    which some walk reaches it, the start too. ``types`` None takes all edges, an empty list none."""
    ids = starts.select("node_id").distinct()
    return _union(_levels(ids, _steps(graph, None if types is None else list(types), inbound), max(1, depth), [], False), ids, [])


def impact(graph: Graph, seeds: DataFrame, depth: int = 2, inbound: bool = True) -> DataFrame:
    """(node_id, hop): smallest hop above 0 at which CALLS reach a node from any seed; a seed that another seed
    reaches counts."""
    ids = seeds.select("node_id").filter("node_id > 0").distinct()
    steps = _steps(graph, ["CALLS"], inbound)
    none = ids.limit(0)
    out, frontier, seen = None, ids, none
    for hop in range(1, max(1, depth) + 1):
        frontier = frontier.join(steps, "node_id").select(F.col("next_id").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        frontier = settle(frontier, "impact")
        if frontier.isEmpty():
            break
        seen = frontier if hop == 1 else seen.union(frontier)
        part = frontier.withColumn("hop", F.lit(hop))
        out = part if out is None else out.union(part)
    return out if out is not None else none.withColumn("hop", F.lit(0))


def named(graph: Graph, reached: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Reached nodes with their columns, by hop and name."""
    n = graph.nodes.select(F.col("id").alias("node_id"), "label", "name", "qualified_name", "file_path", "start_line", "end_line")
    out = reached.join(n, "node_id").orderBy("hop", "qualified_name")
    return out.limit(limit) if limit else out


def call_impact(graph: Graph, paths: DataFrame, depth: int = 2, limit: int = IMPACT_LIMIT) -> DataFrame:
    """Nodes of the changed files (hop 0, ``changed``) and what CALLS reach from them in either direction: the
    smaller hop wins, inbound on ties."""
    changed = graph.nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi")
    seeds = changed.select(F.col("id").alias("node_id"))
    both = impact(graph, seeds, depth, True).withColumns({"direction": F.lit("inbound"), "rank": F.lit(0)}).union(
        impact(graph, seeds, depth, False).withColumns({"direction": F.lit("outbound"), "rank": F.lit(1)})
    )
    best = both.groupBy("node_id").agg(F.min(F.struct("hop", "rank", "direction")).alias("b")).select("node_id", "b.hop", "b.direction")
    own = seeds.select("node_id", F.lit(0).alias("hop"), F.lit("changed").alias("direction"))
    reached = best.join(seeds, "node_id", "left_anti").union(best.join(seeds, "node_id", "left_semi"))
    n = graph.nodes.select(F.col("id").alias("node_id"), "label", "name", "qualified_name", "file_path")
    ranked = reached.join(n, "node_id").orderBy("hop", "qualified_name").limit(limit)
    return own.join(n, "node_id").union(ranked.select("node_id", "hop", "direction", "label", "name", "qualified_name", "file_path"))


def resolve(graph: Graph, name: str) -> DataFrame:
    """Candidates of a symbol by name, or by qualified name where no name fits: ``best`` marks the highest score and
    ``ties`` counts its holders."""
    by_name = graph.nodes.filter(F.col("name") == name)
    found = by_name if not by_name.isEmpty() else graph.nodes.filter(F.col("qualified_name") == name)
    score = resolution_score(F.col("label"), F.col("start_line"), F.col("end_line"))
    ranked = found.withColumn("score", score).withColumn("place", F.rank().over(W.partitionBy("project").orderBy(F.desc("score"))))
    return ranked.withColumn("best", F.col("place") == 1).withColumn("ties", F.count_if(F.col("place") == 1).over(W.partitionBy("project"))).drop("place")


def trace_path(graph: Graph, node_id: int, direction: str = "both", depth: int | None = 3, mode: str = "calls", risk: bool = False, include_tests: bool = False, edge_types: list[str] | None = None) -> dict[str, DataFrame]:
    """``callers`` and ``callees`` of a node with their hops, without test files unless asked for."""
    start = graph.spark.createDataFrame([(node_id,)], "node_id long")
    types = edge_types_for(mode, edge_types)
    out = {}
    for key, inbound in (("callers", True), ("callees", False)):
        if direction in ("both", "inbound" if inbound else "outbound"):
            df = named(graph, bfs(graph, start, clamp_depth(depth), types, inbound), None)
            df = df if include_tests else df.filter(~is_test_path(F.col("file_path")))
            df = df.withColumn("risk", risk_of(F.col("hop"))) if risk else df
            out[key] = df.orderBy("hop", "qualified_name").limit(LIMIT)
    return out


def transitive_depth(graph: Graph, local: DataFrame) -> DataFrame:
    """(node_id, depth): the largest ``local`` value (node_id, depth) over a node and all it calls, exactly, cycles
    included: maxima move against CALLS until none grows. Only nodes that changed send again."""
    back = _steps(graph, ["CALLS"], True)
    now = settle(local.select("node_id", F.col("depth").cast("int").alias("depth")).filter("depth > 0"), "depth")
    news = now
    while True:  # maxima only grow and take values of ``local``, so this ends
        sent = news.join(back, "node_id").groupBy(F.col("next_id").alias("node_id")).agg(F.max("depth").alias("sent"))
        grown = sent.join(now, "node_id", "left").filter("depth is null or sent > depth").select("node_id", F.col("sent").alias("depth"))
        news = settle(grown, "depth-news")
        if news.isEmpty():
            return now
        now = settle(now.union(news).groupBy("node_id").agg(F.max("depth").alias("depth")), "depth")
