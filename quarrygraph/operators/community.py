"""Communities of the undirected CALLS graph by the Leiden method, and their report.

The algorithm is sequential and its input is capped by meaning (the ``NODE_CAP`` smallest ids), so it runs in one
group of ``applyInPandas``; building its weighted graph and reporting on the result are distributed.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import package_of
from ..schema import CALLABLE, Graph
from ..session import by_value

NODE_CAP, LEVELS, TOP_CLUSTERS, TOP_MEMBERS = 8000, 64, 12, 5


def leiden(n: int, edges: list[tuple[int, int, float]], gamma: float = 1.0) -> list[int]:
    """Community of each of ``n`` vertices; self loops are dropped and parallel edges add up."""
    adj: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            adj[a][b] = adj[a].get(b, 0.0) + w
            adj[b][a] = adj[b].get(a, 0.0) + w
    degree = [sum(x.values()) for x in adj]
    total = sum(degree)
    if total <= 0:
        return list(range(n))
    home = list(range(n))  # the current vertex of each original one
    part = list(range(n))

    def relabel(c: list[int]) -> list[int]:
        names: dict[int, int] = {}
        return [names.setdefault(x, len(names)) for x in c]

    for _ in range(LEVELS):
        size = len(adj)
        weight = [0.0] * (max(part) + 1)
        for v in range(size):
            weight[part[v]] += degree[v]
        queue, queued, pops = deque(range(size)), [True] * size, 0
        while queue and pops < 100 * size + 64:
            v = queue.popleft()
            queued[v] = False
            pops += 1
            own = part[v]
            links: dict[int, float] = {own: 0.0}
            for u, w in adj[v].items():
                links[part[u]] = links.get(part[u], 0.0) + w
            weight[own] -= degree[v]
            best, gain = own, links[own] - gamma * degree[v] * weight[own] / total
            for c, w in links.items():
                g = w - gamma * degree[v] * weight[c] / total
                if g > gain + 1e-12:
                    best, gain = c, g
            weight[best] += degree[v]
            if best != own:
                part[v] = best
                for u in adj[v]:
                    if part[u] != best and not queued[u]:
                        queued[u] = True
                        queue.append(u)
        part = relabel(part)
        if max(part) + 1 == size:
            break
        # refine: vertices still alone join the best cluster inside their own community
        fine, alone = list(range(size)), [True] * size
        mass = list(degree)
        for v in range(size):
            if not alone[v]:
                continue
            links = {}
            for u, w in adj[v].items():
                if part[u] == part[v] and fine[u] != fine[v]:
                    links[fine[u]] = links.get(fine[u], 0.0) + w
            best, gain = -1, 1e-12
            for c, w in links.items():
                g = w - gamma * degree[v] * mass[c] / total
                if g > gain:
                    best, gain = c, g
            if best >= 0:
                alone[v] = alone[best] = False
                mass[best] += degree[v]
                mass[fine[v]] -= degree[v]
                fine[v] = best
        fine = relabel(fine)
        count = max(fine) + 1
        if count == size:
            break
        seed, deg, merged = [-1] * count, [0.0] * count, [{} for _ in range(count)]
        for v in range(size):
            c = fine[v]
            deg[c] += degree[v]
            if seed[c] < 0:
                seed[c] = part[v]
            for u, w in adj[v].items():
                if fine[u] != c:
                    merged[c][fine[u]] = merged[c].get(fine[u], 0.0) + w
        home = [fine[h] for h in home]
        adj, degree, part = merged, deg, relabel(seed)
    return relabel([part[h] for h in home])


def _cluster(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = sorted(set(pdf.loc[pdf.b < 0, "a"].tolist()))  # rows without a partner: a null would turn ids into floats
    index = {x: i for i, x in enumerate(ids)}
    links = pdf[pdf.b >= 0]
    edges = [(index[a], index[b], w) for a, b, w in sorted(zip(links.a.tolist(), links.b.tolist(), links.w.tolist()))]
    return pd.DataFrame({"id": ids, "community": leiden(len(ids), edges)})


def communities(graph: Graph, cap: int = NODE_CAP) -> DataFrame:
    """(id, community) of callables and classes; only the ``cap`` smallest ids take part."""
    nodes = graph.nodes.filter(F.col("label").isin(*CALLABLE, "Class")).select("id").orderBy("id").limit(cap)
    calls = graph.edges.filter("type = 'CALLS' and source_id <> target_id")
    calls = calls.join(nodes.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(nodes.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    pairs = calls.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = nodes.select(F.col("id").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0.0).alias("w")).union(pairs)
    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_cluster, "id long, community int")


def cluster_report(graph: Graph, members: DataFrame, top: int = TOP_CLUSTERS) -> DataFrame:
    """(community, members, internal, boundary, cohesion, top_nodes, top_packages, label) of communities of two or more."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").orderBy(F.desc("members"), "community").limit(top)
    calls = graph.edges.filter("type = 'CALLS' and source_id <> target_id").select("source_id", "target_id")
    side = lambda k: members.select(F.col("id").alias(f"{k}_id"), F.col("community").alias(f"{k}_c"))
    joined = calls.join(side("source"), "source_id").join(side("target"), "target_id")
    same = F.col("source_c") == F.col("target_c")
    ends = joined.select(F.explode(F.array_distinct(F.array("source_c", "target_c"))).alias("community"), same.alias("same"))
    edges = ends.groupBy("community").agg(F.count_if("same").alias("internal"), F.count_if(~F.col("same")).alias("boundary"))
    degree = joined.filter(same).select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    named = members.join(sizes.select("community"), "community", "left_semi").join(graph.nodes.select("id", "name", package_of(F.col("qualified_name")).alias("package")), "id").join(degree, "id", "left").fillna(0, ["degree"])

    def best(df: DataFrame, value: str, order: list, name: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("community").orderBy(*order))
        kept = df.withColumn("r", rank).filter(F.col("r") <= TOP_MEMBERS)
        return kept.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda x: x[value]).alias(name))

    nodes = best(named, "name", [F.desc("degree"), "id"], "top_nodes")
    packs = named.filter("package <> ''").groupBy("community", "package").agg(F.count(F.lit(1)).alias("n"))
    packs = best(packs, "package", [F.desc("n"), "package"], "top_packages")
    out = sizes.join(edges, "community", "left").fillna(0, ["internal", "boundary"]).join(nodes, "community", "left").join(packs, "community", "left")
    whole = F.col("internal") + F.col("boundary")
    label = F.coalesce(F.get("top_packages", F.lit(0)), F.get("top_nodes", F.lit(0)), F.lit("cluster"))
    return out.withColumn("cohesion", F.when(whole > 0, F.col("internal") / whole).otherwise(0.0)).withColumn("label", label).orderBy(F.desc("members"), "community")


by_value(__name__)
