"""Traversal, analytics, search, traces, store and incremental operators on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from quarrygraph.functions import text as tx
from quarrygraph.operators import adr, analytics, community, incremental, search, store, traces, traverse
from quarrygraph.schema import NODE_COLUMNS, Graph, graph_of


def build(spark, nodes, edges):
    """nodes: (label, name, qualified_name, file_path, properties); edges by name: (source, target, type)."""
    rows = [(i + 1, "test", lb, n, q, f, 1, 1, p) for i, (lb, n, q, f, p) in enumerate(nodes)]
    ids = {r[3]: r[0] for r in rows}
    return graph_of(spark, rows, [(k + 1, "test", ids[a], ids[b], t, "{}") for k, (a, b, t) in enumerate(edges)]), ids


@pytest.fixture(scope="module")
def arch(spark):
    m = "Method"
    nodes = [("File", f, f"test.{f}", f, "{}") for f in ("main.cs", "handler.cs", "service.cs", "utils.cs")]
    nodes += [
        ("Namespace", "Sample", "test.Sample", "Sample.cs", "{}"), ("Namespace", "Sample.Internal", "test.Sample.Internal", "internal/handler.cs", "{}"),
        (m, "Main", "test.cmd.server.Main", "cmd/server/main.cs", '{"is_entry_point":true}'), (m, "HandleRequest", "test.internal.handler.HandleRequest", "internal/handler/handler.cs", '{"is_entry_point":true}'),
        (m, "Process", "test.internal.service.Process", "internal/service/service.cs", "{}"), (m, "Helper", "test.internal.service.Helper", "internal/service/service.cs", "{}"),
        (m, "TestHelper", "test.internal.service.TestHelper", "internal/service/service_test.cs", '{"is_test":true}'),
    ]
    return build(spark, nodes, [("Main", "HandleRequest", "CALLS"), ("HandleRequest", "Process", "CALLS"), ("Process", "Helper", "CALLS"), ("Process", "TestHelper", "CALLS")])[0]


def chain(spark):
    names = list("ABCDEF")
    return build(spark, [("Method", n, f"test.{n}", f"src/{n.lower()}.cs", "{}") for n in names], [(a, b, "CALLS") for a, b in zip("ABCD", "BCDE")] + [("A", "F", "USAGE"), ("E", "C", "CALLS")])


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id long")


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_bfs(spark):
    g, ids = chain(spark)
    a = starts(spark, ids["A"])
    assert pairs(traverse.bfs(g, a, 1)) == [(ids["B"], 1)]
    assert (ids["D"], 3) in pairs(traverse.bfs(g, a, 3))
    assert pairs(traverse.bfs(g, starts(spark, ids["C"]), 1, ["CALLS"], True)) == [(ids["B"], 1), (ids["E"], 1)]
    assert pairs(traverse.bfs(g, a, 2, ["USAGE"])) == [(ids["F"], 1)] and pairs(traverse.bfs(g, a, 2, [])) == []
    long = pairs(traverse.bfs(g, a, 8))
    assert (ids["C"], 2) in long and (ids["C"], 5) in long and (ids["C"], 8) in long  # walks come back
    assert set(pairs(traverse.bfs(g, a, 3))) <= set(long)


def test_impact_keeps_the_smallest_hop(spark):
    g, ids = chain(spark)
    got = dict(pairs(traverse.impact(g, starts(spark, ids["C"]), 4, True)))
    assert got == {ids["B"]: 1, ids["E"]: 1, ids["A"]: 2, ids["D"]: 2, ids["C"]: 3}  # the seed by its cycle
    both = {r.name: (r.hop, r.direction) for r in traverse.call_impact(g, spark.createDataFrame([("src/b.cs",)], "file_path string"), 1).collect()}
    assert both == {"B": (0, "changed"), "A": (1, "inbound"), "C": (1, "outbound")}


def test_resolution_and_trace(spark):
    nodes = [("Namespace", "dup", "t.ns.dup", "n.cs", "{}"), ("Method", "dup", "t.m.dup", "m.cs", "{}"), ("Method", "amb", "t.a.amb", "a.cs", "{}"), ("Method", "amb", "t.b.amb", "b.cs", "{}"), ("Method", "Root", "t.Root", "src/root.cs", "{}"), ("Method", "Prod", "t.Prod", "src/prod.cs", "{}"), ("Method", "TestFn", "t.TestFn", "tests/test_fn.cs", "{}")]
    g, ids = build(spark, nodes, [("Root", "Prod", "CALLS"), ("Root", "TestFn", "CALLS")])
    assert [r.label for r in traverse.resolve(g, "dup").filter("best").collect()] == ["Method"]
    assert {r.ties for r in traverse.resolve(g, "amb").filter("best").collect()} == {2}
    assert [r.name for r in traverse.resolve(g, "t.Root").filter("best").collect()] == ["Root"]
    assert traverse.trace_path(g, ids["Root"], "outbound")["callees"].count() == 1
    got = traverse.trace_path(g, ids["Root"], "outbound", include_tests=True, risk=True)["callees"].collect()
    assert len(got) == 2 and {r.risk for r in got} == {"CRITICAL"}


def test_transitive_depth_is_exact_on_cycles(spark):
    rng = random.Random(3)
    names = [f"m{i}" for i in range(30)]
    edges = [(rng.choice(names), rng.choice(names), "CALLS") for _ in range(40)]
    g, ids = build(spark, [("Method", n, f"t.{n}", "x.cs", "{}") for n in names], edges)
    local = {ids[n]: rng.randint(0, 4) for n in names}
    reach = {i: {i} for i in local}
    for _ in names:
        for a, b, _ in edges:
            reach[ids[a]] |= reach[ids[b]]
    want = {i: max(local[j] for j in reach[i]) for i in local}
    got = dict(pairs(traverse.transitive_depth(g, spark.createDataFrame(list(local.items()), "node_id long, depth int"))))
    assert got == {i: d for i, d in want.items() if d}


def test_architecture(arch):
    assert arch.nodes.count() == 11
    assert [r.name for r in analytics.entry_points(arch).collect()] == ["Main", "HandleRequest"]
    assert not [r for r in analytics.hotspots(arch).collect() if "Test" in r.name]
    bounds = analytics.boundaries(arch)
    assert pairs(bounds) == [("handler", "service", 1), ("server", "handler", 1)]
    assert {r.name: r.layer for r in analytics.layers(arch, bounds).collect()} == {"server": "entry", "handler": "internal", "service": "leaf"}
    assert [r.name for r in analytics.packages(arch, bounds).collect()] == ["Sample", "Sample.Internal"]
    assert pairs(analytics.languages(arch)) == [("C#", 4)]
    assert dict(pairs(analytics.schema_counts(arch)[0])) == {"File": 4, "Method": 5, "Namespace": 2}
    inside = analytics.scoped(arch, "./internal//service/")
    assert inside.nodes.count() == 3 and inside.edges.count() == 2
    assert analytics.scoped(arch, "inter").nodes.count() == 0
    d = {r.id: (r.in_degree, r.out_degree) for r in analytics.degrees(arch).collect()}
    assert d[9] == (1, 2) and d[1] == (0, 0) and len(d) == 11
    tree = {r.path: r.children for r in analytics.file_tree(arch.nodes).filter("kind = 'dir'").collect()}
    assert tree["internal"] == 3 and tree["internal/service"] == 2


def test_pairs_are_dealt_by_the_size_of_their_files(spark, monkeypatch):
    """More bytes make more parts, not larger ones; degrees count every edge at both ends."""
    import os

    from quarrygraph import session
    from quarrygraph.sources.tables import graph

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(session, "SPREAD_BYTES", os.path.getsize(f"{sf}/lineitem.parquet") // 20, raising=False)
    g = graph(spark, sf)
    for kind, keys in (("CONTAINS", ("l_orderkey", "l_partkey")), ("SUPPLIES", ("l_suppkey", "l_partkey"))):
        parts = [r["count"] for r in g.edges.filter(F.col("type") == kind).groupBy(F.spark_partition_id()).count().collect()]
        assert max(parts) * 8 < sum(parts) == spark.read.parquet(f"{sf}/lineitem.parquet").select(*keys).distinct().count()
    n = g.edges.count()
    assert tuple(analytics.degrees(g).agg(F.sum("in_degree"), F.sum("out_degree")).first()) == (n, n)


def test_property_catalog(spark):
    rows = [("a", '{"flag":true,"n":1,"z":null}'), ("a", '{"flag":false,"n":2.5}'), ("b", '{"x":1}'), ("b", '{"x":"text","o":{},"l":[]}'), ("c", "broken"), ("d", '{"r":1.0,"e":1e3}')]
    got = {(r.kind, r.property_key): r.value_type for r in analytics.property_catalog(spark.createDataFrame(rows, "kind string, properties string")).collect()}
    assert got == {("a", "flag"): "boolean", ("a", "n"): "mixed", ("b", "x"): "mixed", ("b", "o"): "object", ("b", "l"): "array", ("d", "r"): "real", ("d", "e"): "real"}
    counts = spark.createDataFrame([("m", 5), ("k", 2), ("none", 1)], "kind string, count long")
    catalog = spark.createDataFrame([(k, "s", "integer") for k in ("m", "k")], "kind string, property_key string, value_type string")
    same = {r.kind: r.properties_same_as for r in analytics.canonical_kinds(counts, catalog).collect()}
    assert same == {"m": None, "k": "m", "none": None}


def test_package_names(spark):
    names = {"project.internal.store.search.Search": "store", "project.main.foo": "main", "standalone": "", "a.b": "b", "a.b..d": "b"}
    df = spark.createDataFrame(list(names.items()), "qn string, want string").select("want", tx.package_of(F.col("qn")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    assert [r[0] for r in spark.createDataFrame([("updateCloudHTTPClient",)], "s string").select(tx.camel_split(F.col("s"))).collect()] == ["updateCloudHTTPClient update Cloud HTTP Client"]


def test_leiden(spark):
    assert community.leiden(5, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1)]) == [0, 0, 0, 1, 1]
    assert community.leiden(3, []) == [0, 1, 2]
    cliques = [(f"fn{i}", f"fn{j}", "CALLS") for b in (0, 4) for i in range(b, b + 4) for j in range(i + 1, b + 4)] + [("fn0", "fn4", "CALLS")]
    g, _ = build(spark, [("Method", f"fn{i}", f"test.pkg{i // 4}.mod.fn{i}", "x.cs", "{}") for i in range(8)], cliques)
    found = community.communities(g)
    assert len({r.community for r in found.collect()}) == 2
    report = community.cluster_report(g, found).collect()
    assert [r.members for r in report] == [4, 4] and all(0 < r.cohesion < 1 and r.internal == 6 and r.boundary == 1 for r in report)
    assert {r.label for r in report} == {"mod"}


def test_search(spark):
    g, _ = build(spark, [("Method", "updateCloudClient", "a.updateCloudClient(int x)", "a.cs", "{}"), ("Method", "FindUser", "a.b.FindUser", "b.cs", "{}"), ("Class", "Other", "a.Other", "c.cs", "{}")], [("FindUser", "updateCloudClient", "CALLS")])
    assert [r.name for r in search.search_text(g, "cloud").collect()] == ["updateCloudClient"]
    assert [r.name for r in search.search_text(g, "upd* client").collect()] == ["updateCloudClient"]
    assert search.search_text(g, "cloud user").count() == 0 and search.search_text(g, '"!').count() == 0
    assert search.find_nodes(g, name="^find").count() == 1 and search.find_nodes(g, name="^find", case_sensitive=True).count() == 0
    assert [r.name for r in search.by_suffix(g, "B.finduser").collect()] == ["FindUser"]
    assert [r.name for r in search.neighbour_names(g, 1, True).collect()] == ["FindUser"]


def test_code_search(spark):
    nodes = [(1, "p", "File", "Rank.cs", "p.Rank", "Rank.cs", 1, 10, "{}"), (2, "p", "Method", "Popular", "p.Popular", "Rank.cs", 5, 5, "{}"), (3, "p", "Method", "Obscure", "p.Obscure", "Rank.cs", 6, 7, "{}"), (4, "p", "Method", "Far", "p.Far", "Orphan.cs", 10, 20, "{}")]
    g = graph_of(spark, nodes, [(1, "p", 2, 2, "CALLS", "{}"), (2, "p", 3, 2, "CALLS", "{}")])
    body = "\n".join(["using X;", "", "class R", "{", "public void Popular() {}", "public void Obscure() {", " public void inner; }", "}"])
    lines = search.lines_of(spark.createDataFrame([("Rank.cs", body + "\n"), ("Orphan.cs", "public  void here\r\nx")], "file_path string, text string"))
    assert lines.filter("file_path = 'Rank.cs'").count() == 8
    hits, raw = search.ranked_hits(g, search.grep(lines, "public void"))
    assert [(r.name, r.match_lines) for r in hits.collect()] == [("Popular", [5]), ("Obscure", [6, 7])]
    assert pairs(raw.select("file_path", "line")) == [("Orphan.cs", 1)]
    assert search.grep(lines, "public void", file_glob="**/Or?han.cs").count() == 1
    assert search.grep(lines, "void", path_regex="(").count() == 4 and search.grep(lines, "v.id", regex=True, cap=2).count() == 2
    with pytest.raises(Exception):
        search.grep(lines, "(", regex=True)


def entry(spark, rows):
    return spark.createDataFrame(rows, "seq int, caller string, callee string, service string, status_code string, duration_ms double, count int, timestamp string").withColumns({"target_service": F.lit(""), "route": F.lit(""), "method": F.lit(""), "attributes": F.lit("{}")})


def fold(rows, held=None):
    """The merge, one entry at a time."""
    n, errors, avg, samples = held or (0, 0, 0.0, [])
    for _, _, _, _, status, ms, c, _ in sorted(rows):
        if ms > 0:
            avg = (avg * n + ms * c) / (n + c)
            samples = (samples + [int(ms + 0.5)] * c)[-100:]
        n += c
        errors += c if int(status) >= 400 else 0
    return n, errors, avg, samples


def test_trace_merge(spark):
    rows = [(1, "Run", "Target", "api", "500", 100.0, 2, "t1"), (2, "Run", "Target", "api", "200", 200.0, 1, "t2")]
    r = traces.merge(entry(spark, rows)).first()
    assert (r["count"], r.error_count, round(r.avg_duration_ms, 5), r.p99_duration_ms, r.last_seen) == (3, 2, 133.33333, 200.0, "t2")
    rng = random.Random(9)
    rows = [(i, "a", "b", "s", rng.choice(["200", "404"]), rng.choice([0.0, rng.random() * 90]), rng.randint(1, 30), str(i)) for i in range(40)]
    for split in (0, 1, 17, 39):
        old = traces.merge(entry(spark, rows[:split])) if split else None
        r = traces.merge(entry(spark, rows[split:]), old).first()
        n, errors, avg, samples = fold(rows)
        assert (r["count"], r.error_count) == (n, errors) and abs(r.avg_duration_ms - avg) < 1e-9
        assert r.duration_samples == samples and r.p99_duration_ms == max(samples)


def test_trace_merge_adds_up_where_the_entries_are(spark):
    """No frame runs from a row to the end of its key, each task passes on no more than the last samples, and zero can be a
    duration. Keys may be null."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), "x", "s", "200", rng.choice([0.0, 3.25, 70.5]), rng.randint(1, 3), str(i)) for i in range(900)]
    rows = [r if r[1] != "b" else (*r[:5], 8.5, *r[6:]) for r in rows]
    rng.shuffle(rows)
    df = entry(spark, rows).repartition(3)
    merged = traces.merge(df)
    plan = merged._jdf.queryExecution().executedPlan().toString().lower()
    assert "windowgrouplimit" in plan and not [f for f in plan.split("specifiedwindowframe")[1:] if "unboundedfollowing" in f.split(")")[0] and "unboundedpreceding" not in f.split(")")[0]]
    got = {r.caller: r for r in merged.collect()}
    for c in ("a", "b", None):
        n, errors, avg, samples = fold([r for r in rows if r[1] == c])
        assert (got[c]["count"], got[c].error_count) == (n, errors) and abs(got[c].avg_duration_ms - avg) < 1e-9 and got[c].duration_samples == samples
    for r in traces.merge(df, zero=True).collect():
        own = sorted(x for x in rows if x[1] == r.caller)
        assert abs(r.avg_duration_ms - sum(x[5] * x[6] for x in own) / r["count"]) < 1e-9
        assert r.duration_samples == [int(x[5] + 0.5) for x in own for _ in range(x[6])][-100:]


def test_spans(spark):
    fields = [c.split()[0] for c in traces.SPAN.split(", ")]
    spans = [
        dict(caller="A", name="B", attributes='[{"key":"http.method","value":{"stringValue":"GET"}},{"key":"http.route","value":{"stringValue":"/orders"}},{"key":"http.status_code","value":{"intValue":"200"}}]', resource='[{"key":"service.name","value":{"stringValue":"orders-api"}}]', start_time="1000000000", end_time="1500000000"),
        dict(callee="C", attributes='{"url.full":"http://h:1/p/q?x=1"}', duration_ns="2500000"),
        dict(service="api-only"),
    ]
    df = spark.createDataFrame([tuple(s.get(f) for f in fields) for s in spans], traces.SPAN)
    good, bad = traces.normalise(df)
    a, b = sorted(good.collect(), key=lambda r: r.callee)
    assert (a.caller, a.callee, a.service, a.route, a.method, a.status_code, a.duration_ms, a["count"]) == ("A", "B", "orders-api", "/orders", "GET", "200", 500.0, 1)
    assert (b.route, b.duration_ms) == ("/p/q", 2.5) and bad.count() == 1
    g, ids = build(spark, [("Method", "A", "t.A", "a.cs", "{}"), ("Method", "B", "t.B", "b.cs", "{}")], [("A", "B", "CALLS")])
    r = traces.resolve(good, g).orderBy("callee").collect()
    assert (r[0].caller_node_id, r[0].callee_node_id, r[0].calls_edge_id) == (1, 2, 1) and r[1].callee_node_id is None


def test_stream_equals_batch(spark, tmp_path):
    from quarrygraph.streaming.traces import observations, merge_stream

    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), "x", "s", "200", rng.choice([0.0, 5.5, 7.25]), rng.randint(1, 4), str(i)) for i in range(60)]
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    schema = entry(spark, rows).schema
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(src)
    for k in range(3):
        entry(spark, rows[k * 20 : k * 20 + 20]).coalesce(1).write.mode("append").parquet(src)
        q = merge_stream(stream, out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.caller: r for r in observations(spark, out).collect()}
    for c in "ab":
        n, errors, avg, samples = fold([r for r in rows if r[1] == c])
        assert got[c]["count"] == n and abs(got[c].avg_duration_ms - avg) < 1e-9 and got[c].duration_samples == samples


def test_store(spark, tmp_path):
    g, _ = chain(spark)
    s = store.Store(spark, f"file://{tmp_path}/db")
    assert s.status("p1") == "not_found" and s.projects().count() == 0
    s.save("p1", g)
    s.save("p1", Graph(g.nodes.filter("id < 3"), g.edges.filter("id = 1")))
    assert s.status("p1") == "ready" and pairs(s.projects()) == [("p1", 2, 1)]
    assert s.table("p1", "observations").count() == 0
    s.delete("p1")
    assert s.status("p1") == "not_found"
    with pytest.raises(ValueError):
        s.save("../x", g)


def test_names_resolve_without_broadcasts(spark):
    """However small their files look, nodes do not go whole to every task."""
    from quarrygraph.queries import QUERIES
    from quarrygraph.schema import NAMED_EDGE

    g, ids = chain(spark)
    named = [("test", f"test.{a}", f"test.{b}", "CALLS", p) for a, b, p in (("A", "B", "2"), ("A", "B", "1"), ("E", "C", "3"), ("A", "none", "4"))]
    out = store.resolve_edges(spark.createDataFrame(named, NAMED_EDGE), g.nodes)
    assert pairs(out.select("source_id", "target_id", "properties")) == [(ids["A"], ids["B"], "1"), (ids["E"], ids["C"], "3")]
    for df in (out, QUERIES["resolve_named_edges"](spark, "/root/testdata/sf0.001")):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_upsert_keeps_ids_and_last_values(spark):
    g, _ = chain(spark)
    new = [(99, "test", "Class", "A2", "test.A", "n.cs", 1, 1, "{}", 1), (98, "test", "Class", "A3", "test.A", "n.cs", 1, 1, "{}", 2), (97, "test", "Method", "Z", "test.Z", "z.cs", 1, 1, "{}", 1)]
    df = spark.createDataFrame(new, ", ".join([f"{c} {t}" for c, t in zip(NODE_COLUMNS, "long string string string string string int int string".split())]) + ", seq int")
    got = {r.qualified_name: r for r in store.upsert(g.nodes, df, store.NODE_KEY, "seq").collect()}
    assert len(got) == 7 and got["test.A"].id == 1 and got["test.A"].name == "A3" and got["test.Z"].id == 97


def test_classify(spark):
    cols = "rel_path string, size long, mtime_ns long, sha256 string"
    found = spark.createDataFrame([("same", 1, 1, "x"), ("touched", 1, 2, "AB"), ("edited", 1, 2, "c"), ("new", 1, 1, "n")], cols)
    old = spark.createDataFrame([("same", 1, 1, "y"), ("touched", 1, 1, "ab"), ("edited", 1, 1, "d"), ("gone", 1, 1, "g"), ("hidden", 1, 1, "h")], cols)
    disk = spark.createDataFrame([("hidden",)], "rel_path string")
    got = dict(pairs(incremental.classify(found, old, disk)))
    assert got == {"same": "unchanged", "touched": "unchanged", "edited": "changed", "new": "new", "gone": "deleted", "hidden": "mode_skipped"}
    counts = incremental.change_counts(incremental.classify(found, old, disk)).first().asDict()
    assert counts == dict(unchanged=2, changed=1, new=1, deleted=1, mode_skipped=1, total=4)
    assert incremental.index_mode(0, 3, counts) == ("full", "initial_index") and incremental.index_mode(4, 7, counts) == ("full", "discovery_count_exceeded")
    assert incremental.index_mode(4, 4, counts) == ("incremental", None) and incremental.index_mode(4, 4, {}) == ("none", None)


def test_records(spark):
    r = adr.Records(spark)
    assert adr.manage(r, "p")["content"] is None
    assert adr.manage(r, "p", imported="## STACK\nspark")["content"] == "## STACK\nspark"
    adr.manage(r, "p", "update", "## zeta\nlast\n## PURPOSE\nwhy\n")
    text = r.get("p")
    assert text.index("PURPOSE") < text.index("STACK") < text.index("ZETA")
    assert adr.manage(r, "p", "sections")["sections"] == ["PURPOSE", "STACK", "ZETA"]
    assert {(x["header"], x.body) for x in adr.sections_frame(r.frame()).collect()} == {("PURPOSE", "why"), ("STACK", "spark"), ("ZETA", "last")}
    with pytest.raises(ValueError):
        r.store("p", "x" * 8001)


def test_validators():
    assert tx.clamp_depth(9) == 5 and tx.clamp_depth(0) == 1 and tx.clamp_depth(None) == 3
    assert tx.branch_slug("Feature/ABC_1") == "feature-abc-1" and tx.project_name("/home/x/My Repo") == "home-x-My-Repo"
    for bad in ("-x", "a..b", "", "a b"):
        with pytest.raises(ValueError):
            tx.check_ref(bad)
    for bad in ("/etc", "../x", "C:/x"):
        with pytest.raises(ValueError):
            tx.check_search_path(bad)
    assert tx.edge_types_for("data_flow") == ["CALLS", "USAGE", "WRITES"] and tx.edge_types_for("calls", ["X"]) == ["X"] and tx.edge_types_for("cross_service") == []
