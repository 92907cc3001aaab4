"""Architecture analytics: counts, degrees, hotspots, boundaries, packages, layers, property catalogs, file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import in_path, package_of
from ..schema import CALLABLE, Graph

TOP_HOTSPOTS, TOP_ENTRIES, TOP_BOUNDARIES, TOP_PACKAGES = 10, 20, 10, 15


def scoped(graph: Graph, path: str = "") -> Graph:
    """Nodes under a path and the edges with both ends there."""
    if not path:
        return graph
    nodes = graph.nodes.filter(in_path(F.col("file_path"), path))
    ids = nodes.select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return Graph(nodes, edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*graph.edges.columns))


def schema_counts(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(label, count) and (type, count), the largest first."""
    tally = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), c)
    return tally(graph.nodes, "label"), tally(graph.edges, "type")


def degrees(graph: Graph, types: list[str] | None = None) -> DataFrame:
    """(id, in_degree, out_degree) of every node, over all edges or some types: one pass over the edges."""
    e = graph.edges if types is None else graph.edges.filter(F.col("type").isin(types))
    ends = e.select(F.explode(F.array(
        F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
    )).alias("x")).select("x.*")
    counts = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return graph.nodes.select("id").join(counts, "id", "left").select("id", zero("i").alias("in_degree"), zero("o").alias("out_degree"))


def flag(name: str):
    """A boolean of the property bag; false where absent."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(F.col("properties")), f"$.{name}", "boolean"), F.lit(False))


def not_test():
    return ~flag("is_test") & ~F.contains(F.lower("file_path"), F.lit("test"))


def hotspots(graph: Graph, top: int | None = TOP_HOTSPOTS) -> DataFrame:
    """Callables outside tests by CALLS in-degree."""
    n = graph.nodes.filter(F.col("label").isin(*CALLABLE) & not_test())
    counts = graph.edges.filter("type = 'CALLS'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    out = n.join(counts, "id").select("id", "name", "qualified_name", "fan_in").orderBy(F.desc("fan_in"), "qualified_name")
    return out.limit(top) if top else out


def entry_points(graph: Graph, top: int | None = TOP_ENTRIES) -> DataFrame:
    out = graph.nodes.filter(flag("is_entry_point") & not_test()).select("name", "qualified_name", "file_path").orderBy("qualified_name")
    return out.limit(top) if top else out


def boundaries(graph: Graph, top: int | None = TOP_BOUNDARIES) -> DataFrame:
    """(from_package, to_package, calls) between different packages."""
    n = graph.nodes.filter(F.col("label").isin(*CALLABLE, "Class") & not_test()).select("id", package_of(F.col("qualified_name")).alias("p"))
    calls = graph.edges.filter("type = 'CALLS'").select("source_id", "target_id")
    out = (
        calls.join(n.select(F.col("id").alias("source_id"), F.col("p").alias("from_package")), "source_id")
        .join(n.select(F.col("id").alias("target_id"), F.col("p").alias("to_package")), "target_id")
        .filter("from_package <> to_package and from_package <> '' and to_package <> ''")
        .groupBy("from_package", "to_package").agg(F.count(F.lit(1)).alias("calls"))
        .orderBy(F.desc("calls"), "from_package", "to_package")
    )
    return out.limit(top) if top else out


def _fans(bounds: DataFrame) -> DataFrame:
    ends = bounds.select(F.col("from_package").alias("name"), F.lit(0).cast("long").alias("fan_in"), F.col("calls").alias("fan_out")).union(
        bounds.select(F.col("to_package"), F.col("calls"), F.lit(0).cast("long"))
    )
    return ends.groupBy("name").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"))


def packages(graph: Graph, bounds: DataFrame, top: int = TOP_PACKAGES) -> DataFrame:
    """(name, node_count, fan_in, fan_out): namespaces by name; without any, Package nodes; without those, the
    packages of qualified names. Fans come from the given boundaries."""
    source = graph.nodes
    for label in ("Namespace", "Package"):
        found = source.filter(F.col("label") == label)
        if not found.isEmpty():
            names = found.select("name")
            break
    else:
        names = source.select(package_of(F.col("qualified_name")).alias("name")).filter("name <> ''")
    counts = names.groupBy("name").agg(F.count(F.lit(1)).alias("node_count")).orderBy(F.desc("node_count"), "name").limit(top)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return counts.join(_fans(bounds), "name", "left").select("name", "node_count", zero("fan_in"), zero("fan_out")).orderBy(F.desc("node_count"), "name")


def layers(graph: Graph, bounds: DataFrame) -> DataFrame:
    """(name, layer, reason) of every package in the boundaries."""
    entries = graph.nodes.filter(flag("is_entry_point") & not_test()).select(package_of(F.col("qualified_name")).alias("name")).distinct().withColumn("entry", F.lit(True))
    f = _fans(bounds).join(entries, "name", "left")
    i, o, entry = F.col("fan_in"), F.col("fan_out"), F.coalesce("entry", F.lit(False))
    layer = F.when(entry & (o > 0) & (i == 0), "entry").when((i > o) & (i > 3), "core").when((o == 0) & (i > 0), "leaf").when((i == 0) & (o > 0), "entry").otherwise("internal")
    reason = F.when(entry & (o > 0) & (i == 0), F.lit("has entry points and only outgoing calls")).otherwise(F.format_string("fan-in %d, fan-out %d", i, o))
    return f.select("name", layer.alias("layer"), reason.alias("reason")).orderBy("name")


def languages(graph: Graph) -> DataFrame:
    return graph.nodes.filter("label = 'File'").agg(F.count_distinct("file_path").alias("file_count")).select(F.lit("C#").alias("language"), "file_count").filter("file_count > 0")


def property_catalog(rows: DataFrame, kind: str = "kind", properties: str = "properties") -> DataFrame:
    """(kind, property_key, value_type): types of all JSON keys; nulls are skipped and several types are ``mixed``."""
    parsed = rows.select(F.col(kind).alias("kind"), F.try_parse_json(F.col(properties)).alias("v"))
    parsed.createOrReplaceTempView("__catalog")
    keys = parsed.sparkSession.sql("SELECT kind, key, schema_of_variant(value) AS t FROM __catalog, LATERAL variant_explode(v) WHERE key IS NOT NULL")
    t = F.col("t")
    folded = (
        F.when(t == "BIGINT", "integer").when(t.startswith("DECIMAL") | (t == "DOUBLE") | (t == "FLOAT"), "real")
        .when(t == "BOOLEAN", "boolean").when(t == "STRING", "text").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")
    )
    found = keys.filter("t <> 'VOID'").select("kind", F.col("key").alias("property_key"), folded.alias("t")).groupBy("kind", "property_key")
    return found.agg(F.when(F.min("t") == F.max("t"), F.min("t")).otherwise("mixed").alias("value_type"))


def canonical_kinds(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Kinds (kind, count) with their property lists; a kind whose list another one has already shown, in order of
    count, names that one in ``properties_same_as``."""
    lists = catalog.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("property_key", "value_type"))).alias("properties"))
    joined = counts.join(lists, "kind", "left")
    first = F.first("kind").over(W.partitionBy("properties").orderBy(F.desc("count"), "kind"))
    same = F.when(F.col("properties").isNotNull() & (first != F.col("kind")), first)
    return joined.withColumn("properties_same_as", same).orderBy(F.desc("count"), "kind")


def file_tree(paths: DataFrame) -> DataFrame:
    """(path, kind, children): distinct children of every folder (the root is ''), and files with none."""
    p = paths.select("file_path").distinct().filter("file_path <> ''").withColumn("parts", F.split("file_path", "/"))
    i = F.posexplode("parts").alias("i", "child")
    steps = p.select("file_path", "parts", i).select(F.array_join(F.slice("parts", F.lit(1), F.col("i")), "/").alias("path"), "child")
    folders = steps.groupBy("path").agg(F.count_distinct("child").alias("children")).withColumn("kind", F.lit("dir"))
    files = p.select(F.col("file_path").alias("path"), F.lit(0).cast("long").alias("children"), F.lit("file").alias("kind"))
    return folders.select("path", "kind", "children").union(files.select("path", "kind", "children"))
