"""The Cypher front end on a small order-handling graph, and every departure from the plain grammar."""

import pytest

from quarrygraph.plans.builder import cypher, rows_of
from quarrygraph.plans.cypher import CypherError, parse
from quarrygraph.schema import graph_of

NODES = [
    (1, "test", "Method", "HandleOrder", "test.HandleOrder", "handler.cs", 0, 0, '{"cognitive":90,"complexity":12,"tag":"12"}'),
    (2, "test", "Method", "ValidateOrder", "test.ValidateOrder", "validate.cs", 0, 0, '{"cognitive":50,"complexity":6}'),
    (3, "test", "Method", "SubmitOrder", "test.SubmitOrder", "submit.cs", 0, 0, '{"cognitive":30,"complexity":3,"ok":true}'),
    (4, "test", "Namespace", "main", "test.main", "main.cs", 0, 0, "{}"),
    (5, "test", "Method", "LogError", "test.LogError", "log.cs", 0, 0, '{"cognitive":85,"complexity":8}'),
    (6, "other", "Method", "Foreign", "other.Foreign", "x.cs", 0, 0, "not json"),
]
EDGES = [(1, "test", 1, 2, "CALLS", "{}"), (2, "test", 2, 3, "CALLS", "{}"), (3, "test", 1, 5, "CALLS", "{}"), (4, "test", 4, 1, "DEFINES", "{}"), (5, "test", 5, 5, "CALLS", "{}")]


@pytest.fixture(scope="module")
def g(spark):
    return graph_of(spark, NODES, EDGES)


def run(g, text):
    return sorted(tuple(r) for r in rows_of(cypher(g, text, "test"))["rows"])


@pytest.mark.parametrize(
    "text,want",
    [
        ("MATCH (f:Method) WHERE NOT EXISTS { (f)<-[:CALLS]-() } RETURN f.name", [("HandleOrder",)]),
        ("MATCH (n:Method) WHERE n.cognitive > 80 RETURN n.qualified_name, n.cognitive", [("test.HandleOrder", "90"), ("test.LogError", "85")]),
        ("MATCH (f:Method)-[:CALLS]->(g:Method) WHERE f.name <> 'LogError' RETURN f.name, COUNT(g) AS cnt", [("HandleOrder", "2"), ("ValidateOrder", "1")]),
        ("match (a {name: 'HandleOrder'})-->(b) return b.name", [("LogError",), ("ValidateOrder",)]),
        ("MATCH (a:Namespace)-[r:DEFINES]->(b)-[:CALLS]->(c) RETURN c.name", [("LogError",), ("ValidateOrder",)]),
        ("MATCH (a:Namespace)<-[:DEFINES]-(b) RETURN b.name", []),
        ("MATCH (a)-[:CALLS]-(b:Method) WHERE a.name = 'LogError' RETURN b.name", [("HandleOrder",), ("LogError",)]),
        ("MATCH (a:Method)-[:CALLS*2]->(b) WHERE a.id = 1 RETURN b.name", []),
        ("MATCH (a {name: 'HandleOrder'})-[:CALLS*2]->(b) RETURN b.name", [("LogError",), ("LogError",), ("SubmitOrder",), ("ValidateOrder",)]),
        ("MATCH (a {name: 'HandleOrder'})-[:CALLS*2..2]->(b) RETURN b.name", [("LogError",), ("SubmitOrder",)]),
        ("MATCH (a {name: 'HandleOrder'})-[:CALLS*0..1]->(b) RETURN b.name", [("HandleOrder",), ("LogError",), ("ValidateOrder",)]),
        ("MATCH (a {name: 'LogError'})-[:CALLS*1..6]->(b) RETURN COUNT(*) AS n", [("6",)]),
        ("MATCH (a)-[:CALLS*1..2]->(b) MATCH (b)<-[:CALLS]-(a) RETURN DISTINCT a.name, b.name", [("HandleOrder", "LogError"), ("HandleOrder", "ValidateOrder"), ("LogError", "LogError"), ("ValidateOrder", "SubmitOrder")]),
        ("MATCH (n) WHERE n.tag = '12' RETURN n.name", [("HandleOrder",)]),
        ("MATCH (n) WHERE n.complexity = '12' OR n.tag = 12 RETURN n.name", []),
        ("MATCH (n) WHERE n.ok = true RETURN n.name", [("SubmitOrder",)]),
        ("MATCH (n) WHERE n.complexity IN [3, 6] RETURN n.name", [("SubmitOrder",), ("ValidateOrder",)]),
        ("MATCH (n) WHERE n.complexity > -1 AND n.complexity < 6.5 RETURN n.name", [("SubmitOrder",), ("ValidateOrder",)]),
        ("MATCH (n) WHERE n.name STARTS WITH 'handle' RETURN n.name", []),
        ("MATCH (n) WHERE n.name NOT CONTAINS 'Order' RETURN n.name", [("LogError",), ("main",)]),
        ("MATCH (n) WHERE n.cognitive IS NULL XOR n.name = 'LogError' RETURN n.name", [("LogError",), ("main",)]),
        ("MATCH (n:Method) WHERE EXISTS { (n)-[:CALLS]->(x:Method {name: 'SubmitOrder'}) } RETURN n.name", [("ValidateOrder",)]),
        ("MATCH (n:Method) WHERE n.in_degree > 1 RETURN n.name, n.in_degree, n.out_degree", [("LogError", "2", "1")]),
        ("MATCH (n:Method) RETURN COUNT(DISTINCT n.label) AS l, MAX(n.complexity) AS m, MIN(n.name) AS s", [("1", "12.0", "HandleOrder")]),
        ("MATCH (n:Namespace) RETURN toUpper(n.name) AS u UNION MATCH (m:Namespace) RETURN toUpper(m.name) AS u", [("MAIN",)]),
        ("MATCH (n:Namespace) RETURN n.name UNION ALL MATCH (m:Namespace) RETURN m.name", [("main",), ("main",)]),
        ("MATCH (n:Namespace) // all of them\nRETURN n.name -- no more", [("main",)]),
        ("MATCH (n:Order) RETURN n.name", []),
    ],
)
def test_results(g, text, want):
    assert run(g, text) == sorted(want)


def test_order_skip_limit(g):
    got = rows_of(cypher(g, "MATCH (n:Method) RETURN n.name, n.cognitive AS c ORDER BY c DESC SKIP 1 LIMIT 2", "test"))
    assert got["rows"] == [["LogError", "85"], ["ValidateOrder", "50"]]
    got = rows_of(cypher(g, "MATCH (f)-[:CALLS]->(h) RETURN f.name, COUNT(h) AS n ORDER BY COUNT(h) DESC LIMIT 1", "test"))
    assert got["rows"] == [["HandleOrder", "2"]]


def test_whole_nodes_and_hints(g):
    got = rows_of(cypher(g, "MATCH (n:Namespace) RETURN n", "test"))
    assert got["columns"][:2] == ["n_id", "n_label"] and got["rows"][0][:3] == ["4", "Namespace", "main"]
    assert rows_of(cypher(g, "MATCH (n:Namespace)", "test"))["rows"] == got["rows"]
    assert "hint" in rows_of(cypher(g, "MATCH (n) WHERE n.name = 'Missing' RETURN n.name", "test"))
    with pytest.raises(CypherError, match="more than 2 rows"):
        rows_of(cypher(g, "MATCH (n) RETURN n.name", "test"), 2)


@pytest.mark.parametrize(
    "text",
    ["INVALID QUERY", "CREATE (n)", "MATCH (n) DELETE n", "OPTIONAL MATCH (n) RETURN n", "MATCH (n) OPTIONAL MATCH (m) RETURN n", "MATCH (n) RETURN size(n.name)", "MATCH (n) RETURN n.name[0]", "MATCH (n), (m) RETURN n", "MATCH (n)-[:A*1..11]->(m) RETURN n", "MATCH (n) RETURN n.name extra", "MATCH (n) WHERE n.x NOT = 1 RETURN n", "MATCH (n) RETURN SUM(*)"],
)
def test_rejections(text):
    with pytest.raises(CypherError):
        parse(text)


def test_unbound_variables(g):
    with pytest.raises(CypherError):
        cypher(g, "MATCH (n) RETURN m.name", "test")
    with pytest.raises(CypherError):
        cypher(g, "MATCH (n) WHERE m.name = 'x' RETURN n", "test")


def test_precedence():
    w = parse("MATCH (n) WHERE n.a = 1 OR n.b = 2 XOR n.c = 3 AND NOT n.d = 4 RETURN n").where
    assert w.op == "or" and w.right.op == "xor" and w.right.right.op == "and" and w.right.right.right.op == "not"


def test_fixed_hop_equals_one_step_walk(g):
    assert run(g, "MATCH (a)-[:CALLS]->(b) RETURN a.name, b.name") == run(g, "MATCH (a)-[:CALLS*1..1]->(b) RETURN a.name, b.name")


def test_undirected_is_in_and_out(g):
    one = run(g, "MATCH (a)-[:CALLS]->(b) RETURN a.name, b.name")
    back = [(b, a) for a, b in one if a != b]  # a self loop is one hop
    assert run(g, "MATCH (a)-[:CALLS]-(b) RETURN a.name, b.name") == sorted(one + back)


def test_no_nested_loop_join(g):
    plan = cypher(g, "MATCH (a)-[:CALLS]-(b) WHERE EXISTS { (a)-[:DEFINES]-() } RETURN a.name, b.name", "test")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
