"""Keyed maintenance of the graph tables: upsert, name resolution, cascading deletes, snapshots, persistence.

Plain Parquet has no MERGE, so a change is a new version of the tables of one project, written beside the old one
and switched to by a small pointer file: readers see the old or the new version, never a mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import check_project
from ..schema import EDGE, FACTS, FILE_HASH, NODE, OBSERVATION, Graph

NODE_KEY, EDGE_KEY, HASH_KEY = ["project", "qualified_name"], ["source_id", "target_id", "type"], ["project", "rel_path"]


def last_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The row with the largest ``seq`` of each key."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(seq)))
    return rows.withColumn("__r", rank).filter("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """``old`` with the last of ``new`` for each key (``new`` has ``seq`` besides); an existing row keeps its id."""
    news = last_wins(new, key, seq).drop(seq)
    if "id" in old.columns:
        kept = old.select(*key, F.col("id").alias("__id"))
        news = news.join(kept, key, "left").withColumn("id", F.coalesce("__id", "id")).drop("__id")
    return old.join(news.select(*key), key, "left_anti").select(*old.columns).unionByName(news.select(*old.columns))


def with_ids(nodes: DataFrame) -> DataFrame:
    """Ids made from the key, the same in every run: 63 bits of a hash of project and qualified name."""
    return nodes.withColumn("id", F.shiftrightunsigned(F.xxhash64("project", "qualified_name"), 1))


def resolve_edges(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by qualified name to edges by id; unresolved ones are dropped, equal ones are one (the first by
    properties). Nodes are never broadcast: their files say little of their size in memory, and every task would count it."""
    ids = nodes.select("project", "qualified_name", "id").hint("merge")
    out = (
        named.join(ids.select("project", F.col("qualified_name").alias("source_qn"), F.col("id").alias("source_id")), ["project", "source_qn"])
        .join(ids.select("project", F.col("qualified_name").alias("target_qn"), F.col("id").alias("target_id")), ["project", "target_qn"])
        .groupBy("project", *EDGE_KEY).agg(F.min("properties").alias("properties"))
    )
    return out.select(F.shiftrightunsigned(F.xxhash64(*EDGE_KEY), 1).alias("id"), "project", "source_id", "target_id", "type", "properties")


def delete_files(graph: Graph, paths: DataFrame) -> Graph:
    """Without the nodes of some files and all edges that touch them."""
    nodes = graph.nodes.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(*graph.nodes.columns)
    return Graph(nodes, attached(graph.edges, nodes))


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    out = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return out.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def detach_observations(observations: DataFrame, graph: Graph) -> DataFrame:
    """References to nodes and edges that are gone become null."""
    out = observations
    for column, ids in (("caller_node_id", graph.nodes), ("callee_node_id", graph.nodes), ("calls_edge_id", graph.edges)):
        known = ids.select(F.col("id").alias("__k")).distinct()
        out = out.join(known, F.col(column) == F.col("__k"), "left").withColumn(column, F.col("__k")).drop("__k")
    return out


def inbound_snapshot(graph: Graph, paths: DataFrame) -> DataFrame:
    """Edges into nodes of some files from nodes of others, by qualified name, to be restored after a reload."""
    p = paths.select("file_path").distinct()
    n = graph.nodes.select("id", "qualified_name", "file_path")
    inside, outside = n.join(p, "file_path", "left_semi"), n.join(p, "file_path", "left_anti")
    return (
        graph.edges.join(inside.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target_qn")), "target_id")
        .join(outside.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source_qn")), "source_id")
        .select("project", "source_qn", "target_qn", "type", "properties")
    )


def restore(snapshot: DataFrame, graph: Graph) -> Graph:
    """Put snapshot edges back where both names still resolve; edges that exist stay as they are."""
    back = resolve_edges(snapshot, graph.nodes).join(graph.edges.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return Graph(graph.nodes, graph.edges.unionByName(back.select(*graph.edges.columns)))


class Store:
    """Tables of all projects under one folder of any Hadoop file system."""

    TABLES = {"nodes": NODE, "edges": EDGE, "file_hashes": FILE_HASH, "observations": OBSERVATION, "facts": FACTS}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _version(self, project: str) -> str | None:
        """The newest committed version; a version counts once its marker is there."""
        done = [x for x in self._list(f"{self.root}/{project}") if x.startswith("commit-")]
        return done[-1].split("-", 2)[2] if done else None

    def save(self, project: str, graph: Graph, **tables: DataFrame) -> None:
        """Write a new version of a project: all tables first, then the marker that switches readers to it."""
        check_project(project)
        version = uuid.uuid4().hex
        base = f"{self.root}/{project}/{version}"
        graph.nodes.sortWithinPartitions("label", "qualified_name").write.parquet(f"{base}/nodes")
        graph.edges.sortWithinPartitions("type", "source_id").write.parquet(f"{base}/edges")
        for name, df in tables.items():
            if name not in self.TABLES:
                raise ValueError(f"no table {name}")
            df.write.parquet(f"{base}/{name}")
        n = len([x for x in self._list(f"{self.root}/{project}") if x.startswith("commit-")])
        fs, p = self._fs(f"{self.root}/{project}/commit-{n:08d}-{version}")
        fs.create(p, False).close()

    def table(self, project: str, name: str) -> DataFrame:
        version, path = self._version(project), None
        if version:
            path = f"{self.root}/{project}/{version}/{name}"
            fs, p = self._fs(path)
            path = path if fs.exists(p) else None
        return self.spark.read.schema(self.TABLES[name]).parquet(path) if path else self.spark.createDataFrame([], self.TABLES[name])

    def load(self, project: str) -> Graph:
        return Graph(self.table(project, "nodes"), self.table(project, "edges"))

    def projects(self) -> DataFrame:
        """(name, nodes, edges) of all projects; names that begin with ``_`` are internal."""
        rows = []
        for name in self._list(self.root):
            if not name.startswith("_") and self._version(name):
                g = self.load(name)
                rows.append((name, g.nodes.count(), g.edges.count()))
        return self.spark.createDataFrame(rows, "name string, nodes long, edges long").orderBy("name")

    def status(self, project: str) -> str:
        if self._version(project) is None:
            return "not_found"
        return "empty" if self.table(project, "nodes").isEmpty() else "ready"

    def delete(self, project: str) -> bool:
        fs, p = self._fs(f"{self.root}/{check_project(project)}")
        return bool(fs.delete(p, True))
