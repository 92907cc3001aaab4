"""Incremental maintenance: classify files by fingerprints, decide how to index, patch the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Graph
from .store import attached, inbound_snapshot, resolve_edges, restore, with_ids


def classify(found: DataFrame, stored: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """(rel_path, status) from two fingerprint tables (rel_path, size, mtime_ns, sha256).

    Same time and size, or same digest: unchanged. Stored only: mode_skipped where the path is still in ``on_disk``,
    else deleted. One full outer join on the path.
    """
    new = found.select("rel_path", *[F.col(c).alias(f"n_{c}") for c in ("size", "mtime_ns", "sha256")], F.lit(True).alias("__new"))
    old = stored.select("rel_path", *[F.col(c).alias(f"o_{c}") for c in ("size", "mtime_ns", "sha256")], F.lit(True).alias("__old"))
    both = new.join(old, "rel_path", "full_outer")
    if on_disk is not None:
        both = both.join(on_disk.select("rel_path").distinct().withColumn("__disk", F.lit(True)), "rel_path", "left")
    else:
        both = both.withColumn("__disk", F.lit(None).cast("boolean"))
    same = ((F.col("n_mtime_ns") == F.col("o_mtime_ns")) & (F.col("n_size") == F.col("o_size"))) | (F.lower("n_sha256") == F.lower("o_sha256"))
    status = (
        F.when(F.col("__new").isNull() & F.col("__disk"), "mode_skipped").when(F.col("__new").isNull(), "deleted")
        .when(F.col("__old").isNull(), "new").when(same, "unchanged").otherwise("changed")
    )
    return both.select("rel_path", status.alias("status"))


def change_counts(classified: DataFrame) -> DataFrame:
    """One row of counts; ``total`` is what was discovered."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return classified.agg(
        n("unchanged").alias("unchanged"), n("changed").alias("changed"), n("new").alias("new"), n("deleted").alias("deleted"),
        n("mode_skipped").alias("mode_skipped"), n("unchanged", "changed", "new").alias("total"),
    )


def index_mode(stored_files: int, found_files: int, changes: dict[str, int], project_changed: bool = False) -> tuple[str, str | None]:
    """(mode, reason): none, incremental or full with the reason for falling back."""
    if not stored_files:
        return "full", "initial_index"
    if project_changed:
        return "full", "project_graph_changed"
    if found_files > 1.5 * stored_files:
        return "full", "discovery_count_exceeded"
    return ("incremental", None) if any(changes.get(k) for k in ("changed", "new", "deleted")) else ("none", None)


def patch(graph: Graph, stale: DataFrame, nodes: DataFrame, named_edges: DataFrame) -> Graph:
    """Replace the nodes of the ``stale`` files (file_path) by new ones, keep other files' edges into them by name, and
    add the new edges. Equal to a full load of the result."""
    snapshot = inbound_snapshot(graph, stale)
    kept = graph.nodes.join(stale.select("file_path").distinct(), "file_path", "left_anti").select(*graph.nodes.columns)
    old_ids = graph.nodes.select("project", "qualified_name", F.col("id").alias("__id"))
    fresh = with_ids(nodes).join(old_ids, ["project", "qualified_name"], "left").withColumn("id", F.coalesce("__id", "id"))
    every = kept.unionByName(fresh.select(*kept.columns))
    left = attached(graph.edges, kept)
    added = resolve_edges(named_edges, every).join(left.select("source_id", "target_id", "type"), ["source_id", "target_id", "type"], "left_anti")
    return restore(snapshot, Graph(every, left.unionByName(added.select(*left.columns))))
