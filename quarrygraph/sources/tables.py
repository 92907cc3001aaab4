"""Property graphs derived from the driver's tables: project ``tpch`` (one node per dimension row, foreign keys
as edges) and project ``code`` (parts as methods that call each other, suppliers as classes)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NODE_COLUMNS, Graph
from ..session import spread

KIND = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, kind: int, label: str, key: str, name: Column, props: dict[str, Column]) -> DataFrame:
    k = F.col(key).cast("long")
    low = label.lower()
    group = (k % 7).cast("string")
    return df.select(
        (k + kind * KIND).alias("id"),
        F.lit("tpch").alias("project"),
        F.lit(label).alias("label"),
        name.alias("name"),
        F.concat(F.lit(f"tpch.{low}.g"), group, F.lit("."), k.cast("string")).alias("qualified_name"),
        F.concat(F.lit(f"{low}/g"), group, F.lit("/"), (k % 50).cast("string"), F.lit(".cs")).alias("file_path"),
        (k % 1000 + 1).cast("int").alias("start_line"),
        (k % 1000 + 1 + k % 17).cast("int").alias("end_line"),
        F.to_json(F.struct(*[c.alias(n) for n, c in props.items()])).alias("properties"),
    )


def _code_nodes(parts: DataFrame, suppliers: DataFrame) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    text = lambda c: c.cast("string")
    is_test = p % 13 == 0
    methods = parts.select(
        (p + 7 * KIND).alias("id"),
        F.lit("code").alias("project"),
        F.when(p % 8 == 0, "Constructor").otherwise("Method").alias("label"),
        F.concat(F.lit("Run"), text(p % 400)).alias("name"),
        F.concat(F.lit("code.src.pkg"), text(p % 7), F.lit(".M"), text(p)).alias("qualified_name"),
        F.concat(F.when(is_test, "tests").otherwise("src"), F.lit("/pkg"), text(p % 7), F.lit("/f"), text(p % 97), F.lit(".cs")).alias("file_path"),
        (p % 90 * 5 + 1).cast("int").alias("start_line"),
        (p % 90 * 5 + 1 + p % 5).cast("int").alias("end_line"),
        F.to_json(
            F.struct(
                F.col("p_size").alias("complexity"),
                F.col("p_retailprice").alias("weight"),
                F.col("p_brand").alias("brand"),
                is_test.alias("is_test"),
                (p % 50 == 1).alias("is_entry_point"),
                (p % 4).cast("int").alias("loop_depth"),
            )
        ).alias("properties"),
    )
    classes = suppliers.select(
        (s + 8 * KIND).alias("id"),
        F.lit("code").alias("project"),
        F.lit("Class").alias("label"),
        F.concat(F.lit("C"), text(s)).alias("name"),
        F.concat(F.lit("code.src.pkg"), text(s % 7), F.lit(".C"), text(s)).alias("qualified_name"),
        F.concat(F.lit("src/pkg"), text(s % 7), F.lit("/f"), text(s % 97), F.lit(".cs")).alias("file_path"),
        F.lit(1).alias("start_line"),
        F.lit(450).alias("end_line"),
        F.to_json(F.struct(F.col("s_acctbal").alias("complexity"), F.lit(False).alias("is_test"))).alias("properties"),
    )
    spaces = suppliers.select((s % 7).alias("g")).distinct().select(
        (F.col("g") + 9 * KIND).alias("id"),
        F.lit("code").alias("project"),
        F.lit("Namespace").alias("label"),
        F.concat(F.lit("pkg"), text(F.col("g"))).alias("name"),
        F.concat(F.lit("code.src.ns.pkg"), text(F.col("g"))).alias("qualified_name"),
        F.concat(F.lit("src/pkg"), text(F.col("g")), F.lit("/ns.cs")).alias("file_path"),
        F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"),
        F.lit("{}").alias("properties"),
    )
    file_path = F.concat(F.lit("src/pkg"), text(s % 7), F.lit("/f"), text(s % 97), F.lit(".cs"))
    files = suppliers.select(file_path.alias("file_path"), (s % 679).alias("k")).groupBy("file_path").agg(F.min("k").alias("k")).select(
        (F.col("k") + 10 * KIND).alias("id"),
        F.lit("code").alias("project"),
        F.lit("File").alias("label"),
        F.element_at(F.split("file_path", "/"), -1).alias("name"),
        F.concat(F.lit("code."), F.replace(F.regexp_replace("file_path", r"\.cs$", ""), F.lit("/"), F.lit("."))).alias("qualified_name"),
        "file_path",
        F.lit(1).alias("start_line"),
        F.lit(500).alias("end_line"),
        F.lit('{"complexity":0}').alias("properties"),
    )
    return reduce(DataFrame.unionByName, [methods, classes, spaces, files])


def _edges(df: DataFrame, source: Column, target: Column, kind: str, project: str = "tpch") -> DataFrame:
    return df.select(
        F.lit(project).alias("project"),
        source.cast("long").alias("source_id"),
        target.cast("long").alias("target_id"),
        F.lit(kind).alias("type"),
        F.lit('{"confidence":1.0,"strategy":"key"}' if project == "code" else "{}").alias("properties"),
    )


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Both projects. Edge ids are hashes of their key, as (source, target, type) is unique."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    c = F.col
    nodes = [
        _nodes(t["region"], 1, "Region", "r_regionkey", c("r_name"), {"rank": c("r_regionkey")}),
        _nodes(t["nation"], 2, "Nation", "n_nationkey", c("n_name"), {"region": c("n_regionkey")}),
        _nodes(t["customer"], 3, "Customer", "c_custkey", c("c_name"), {"acctbal": c("c_acctbal"), "segment": c("c_mktsegment")}),
        _nodes(t["supplier"], 4, "Supplier", "s_suppkey", c("s_name"), {"acctbal": c("s_acctbal"), "preferred": c("s_suppkey") % 10 == 0}),
        _nodes(t["part"], 5, "Part", "p_partkey", c("p_name"), {"brand": c("p_brand"), "kind": c("p_type"), "size": c("p_size"), "price": c("p_retailprice")}),
        _nodes(t["orders"], 6, "Order", "o_orderkey", F.concat(F.lit("order"), c("o_orderkey").cast("string")), {"status": c("o_orderstatus"), "total": c("o_totalprice"), "priority": c("o_orderpriority")}),
        _code_nodes(t["part"], t["supplier"]),
    ]
    p = c("p_partkey")
    n_parts = t["part"].count()
    self_or = lambda target: F.when(target != p, target)
    lines = t["lineitem"]
    # pairs hardly repeat: made distinct before a shuffle, a task would hold nearly all of its input at once
    pairs = lambda *keys: spread(lines.select(*keys), *keys).distinct()
    edges = [
        _edges(t["nation"], c("n_nationkey") + 2 * KIND, c("n_regionkey") + KIND, "IN_REGION"),
        _edges(t["customer"], c("c_custkey") + 3 * KIND, c("c_nationkey") + 2 * KIND, "IN_NATION"),
        _edges(t["supplier"], c("s_suppkey") + 4 * KIND, c("s_nationkey") + 2 * KIND, "IN_NATION"),
        _edges(t["orders"], c("o_custkey") + 3 * KIND, c("o_orderkey") + 6 * KIND, "PLACED"),
        _edges(pairs("l_orderkey", "l_partkey"), c("l_orderkey") + 6 * KIND, c("l_partkey") + 5 * KIND, "CONTAINS"),
        _edges(pairs("l_suppkey", "l_partkey"), c("l_suppkey") + 4 * KIND, c("l_partkey") + 5 * KIND, "SUPPLIES"),
    ]
    calls = t["part"].select(
        p, F.explode(F.array_distinct(F.array_compact(F.array(
            self_or((p * 7 + 3) % n_parts),
            F.when(p % 3 == 0, self_or((p + 1) % n_parts)),
            F.when(p % 4 == 1, self_or(p % 10)),
        )))).alias("q"),
    )
    edges.append(_edges(calls, c("p_partkey") + 7 * KIND, c("q") + 7 * KIND, "CALLS", "code"))
    edges.append(_edges(t["part"].crossJoin(t["supplier"].agg(F.count(F.lit(1)).alias("ns"))), p % c("ns") + 8 * KIND, p + 7 * KIND, "DEFINES_METHOD", "code"))
    edges.append(_edges(t["part"].filter(p % 5 == 0), p + 7 * KIND, (p * 3 + 1) % n_parts + 7 * KIND, "USAGE", "code"))
    all_edges = reduce(DataFrame.unionByName, edges)
    ids = F.xxhash64("source_id", "target_id", "type").alias("id")
    return Graph(
        reduce(DataFrame.unionByName, nodes).select(*NODE_COLUMNS),
        all_edges.select(ids, "project", "source_id", "target_id", "type", "properties"),
    )


def _sql_nodes(label: str, kind: int, table: str, key: str, name: str, props: str) -> str:
    low = label.lower()
    return f"""SELECT {kind * KIND} + {key}::BIGINT AS id, 'tpch' AS project, '{label}' AS label, {name} AS name,
  'tpch.{low}.g' || ({key} % 7) || '.' || {key} AS qualified_name, '{low}/g' || ({key} % 7) || '/' || ({key} % 50) || '.cs' AS file_path,
  ({key} % 1000 + 1)::INT AS start_line, ({key} % 1000 + 1 + {key} % 17)::INT AS end_line, json_object({props}) AS p FROM {table}"""


#: The same graph as DuckDB common table expressions ``n`` (nodes; properties as JSON ``p``) and ``e`` (edges).
SQL_GRAPH = f"""n AS (
{_sql_nodes("Region", 1, "region", "r_regionkey", "r_name", "'rank', r_regionkey")} UNION ALL
{_sql_nodes("Nation", 2, "nation", "n_nationkey", "n_name", "'region', n_regionkey")} UNION ALL
{_sql_nodes("Customer", 3, "customer", "c_custkey", "c_name", "'acctbal', c_acctbal, 'segment', c_mktsegment")} UNION ALL
{_sql_nodes("Supplier", 4, "supplier", "s_suppkey", "s_name", "'acctbal', s_acctbal, 'preferred', s_suppkey % 10 = 0")} UNION ALL
{_sql_nodes("Part", 5, "part", "p_partkey", "p_name", "'brand', p_brand, 'kind', p_type, 'size', p_size, 'price', p_retailprice")} UNION ALL
{_sql_nodes("Order", 6, "orders", "o_orderkey", "'order' || o_orderkey", "'status', o_orderstatus, 'total', o_totalprice, 'priority', o_orderpriority")} UNION ALL
SELECT {7 * KIND} + p_partkey, 'code', CASE WHEN p_partkey % 8 = 0 THEN 'Constructor' ELSE 'Method' END, 'Run' || (p_partkey % 400),
  'code.src.pkg' || (p_partkey % 7) || '.M' || p_partkey,
  CASE WHEN p_partkey % 13 = 0 THEN 'tests' ELSE 'src' END || '/pkg' || (p_partkey % 7) || '/f' || (p_partkey % 97) || '.cs',
  (p_partkey % 90 * 5 + 1)::INT, (p_partkey % 90 * 5 + 1 + p_partkey % 5)::INT,
  json_object('complexity', p_size, 'weight', p_retailprice, 'brand', p_brand, 'is_test', p_partkey % 13 = 0, 'is_entry_point', p_partkey % 50 = 1, 'loop_depth', p_partkey % 4)
  FROM part UNION ALL
SELECT {8 * KIND} + s_suppkey, 'code', 'Class', 'C' || s_suppkey, 'code.src.pkg' || (s_suppkey % 7) || '.C' || s_suppkey,
  'src/pkg' || (s_suppkey % 7) || '/f' || (s_suppkey % 97) || '.cs', 1, 450, json_object('complexity', s_acctbal, 'is_test', false) FROM supplier UNION ALL
SELECT DISTINCT {9 * KIND} + s_suppkey % 7, 'code', 'Namespace', 'pkg' || (s_suppkey % 7), 'code.src.ns.pkg' || (s_suppkey % 7),
  'src/pkg' || (s_suppkey % 7) || '/ns.cs', 1, 1, json_object() FROM supplier UNION ALL
SELECT {10 * KIND} + min(s_suppkey % 679), 'code', 'File', split_part(f, '/', -1), 'code.' || replace(regexp_replace(f, '\\.cs$', ''), '/', '.'), f, 1, 500, json_object('complexity', 0)
  FROM (SELECT *, 'src/pkg' || (s_suppkey % 7) || '/f' || (s_suppkey % 97) || '.cs' AS f FROM supplier) GROUP BY f
), np AS (SELECT count(*) AS c FROM part), ns AS (SELECT count(*) AS c FROM supplier), calls AS (
  SELECT DISTINCT p, q FROM (
    SELECT p_partkey AS p, (p_partkey * 7 + 3) % c AS q FROM part, np UNION ALL
    SELECT p_partkey, (p_partkey + 1) % c FROM part, np WHERE p_partkey % 3 = 0 UNION ALL
    SELECT p_partkey, p_partkey % 10 FROM part WHERE p_partkey % 4 = 1) WHERE p <> q
), e AS (
SELECT 'tpch' AS project, {2 * KIND} + n_nationkey AS source_id, {KIND} + n_regionkey AS target_id, 'IN_REGION' AS type FROM nation UNION ALL
SELECT 'tpch', {3 * KIND} + c_custkey, {2 * KIND} + c_nationkey, 'IN_NATION' FROM customer UNION ALL
SELECT 'tpch', {4 * KIND} + s_suppkey, {2 * KIND} + s_nationkey, 'IN_NATION' FROM supplier UNION ALL
SELECT 'tpch', {3 * KIND} + o_custkey, {6 * KIND} + o_orderkey, 'PLACED' FROM orders UNION ALL
SELECT DISTINCT 'tpch', {6 * KIND} + l_orderkey, {5 * KIND} + l_partkey, 'CONTAINS' FROM lineitem UNION ALL
SELECT DISTINCT 'tpch', {4 * KIND} + l_suppkey, {5 * KIND} + l_partkey, 'SUPPLIES' FROM lineitem UNION ALL
SELECT 'code', {7 * KIND} + p, {7 * KIND} + q, 'CALLS' FROM calls UNION ALL
SELECT 'code', {8 * KIND} + p_partkey % c, {7 * KIND} + p_partkey, 'DEFINES_METHOD' FROM part, ns UNION ALL
SELECT 'code', {7 * KIND} + p_partkey, {7 * KIND} + (p_partkey * 3 + 1) % c, 'USAGE' FROM part, np WHERE p_partkey % 5 = 0
)"""
