"""Table schemas of the property graph and its companions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = (
    "id long, project string, label string, name string, qualified_name string, file_path string, "
    "start_line int, end_line int, properties string"
)
EDGE = "id long, project string, source_id long, target_id long, type string, properties string"
NAMED_EDGE = "project string, source_qn string, target_qn string, type string, properties string"
FILE_HASH = "project string, rel_path string, sha256 string, mtime_ns long, size long"
OBSERVATION = (
    "project string, caller string, callee string, service string, target_service string, route string, method string, "
    "caller_node_id long, callee_node_id long, calls_edge_id long, count long, error_count long, "
    "avg_duration_ms double, p99_duration_ms double, last_seen string, duration_samples array<long>, attributes string"
)
#: What a source file says on its own, before names are resolved.
FACTS = (
    "kind string, project string, file_path string, label string, name string, qualified_name string, "
    "start_line int, end_line int, properties string, target string, args int, parent string"
)
NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]

#: Node columns that a query reads directly; any other name is a key of ``properties``.
SCALARS = ("name", "qualified_name", "label", "file_path", "start_line", "end_line")
CALLABLE = ("Method", "Constructor")


@dataclass(frozen=True)
class Graph:
    """Nodes and edges. ``scoped`` keeps one project: on tables partitioned by project, that prunes."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def scoped(self, project: str) -> Graph:
        own = F.col("project") == project
        return Graph(self.nodes.filter(own), self.edges.filter(own))


def graph_of(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> Graph:
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
