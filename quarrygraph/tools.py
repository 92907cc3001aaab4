"""The sixteen tools: each takes plain arguments and returns a dictionary ready for JSON.

Operators return lazy DataFrames; only this module collects, and only pages, reports and rows under a ceiling.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import check_project, clamp_depth, direction_of, edge_types_for, project_name, snippet
from .operators import adr, analytics, community, incremental, search, store, traces, traverse
from .plans.builder import cypher, rows_of
from .plans.cypher import CypherError
from .schema import FILE_HASH, OBSERVATION, Graph
from .session import settle
from .sources import csharp, files

COMPACT = 8
ASPECTS = ("structure", "dependencies", "boundaries", "layers", "packages", "languages", "entry_points", "hotspots", "clusters", "file_tree", "runtime")

CATALOG = {
    "list_tools": ("meta", "Names, categories and purposes of the tools."), "get_skill_reference": ("meta", "How to query the graph."),
    "index_repository": ("lifecycle", "Index the C# files below a folder, incrementally where possible."), "index_status": ("lifecycle", "ready, empty or not_found."),
    "list_projects": ("lifecycle", "Projects with node and edge counts."), "delete_project": ("mutation", "Remove a project."),
    "search_graph": ("query", "Nodes by words (BM25) or by label and regular expressions, paged."), "get_code_snippet": ("query", "Source of a symbol with its degrees."),
    "get_graph_schema": ("query", "Labels, types and property keys."), "query_graph": ("query", "A read-only Cypher query."),
    "get_architecture": ("query", "Aspects: " + ", ".join(ASPECTS) + "."), "trace_path": ("query", "Callers and callees of a symbol by hop."),
    "search_code": ("query", "Lines by text or regular expression, mapped to symbols."), "manage_adr": ("mutation", "The project's decision record."),
    "ingest_traces": ("mutation", "Merge runtime spans into observations."), "detect_changes": ("query", "Changed files, their symbols and impact, from git."),
}

REFERENCE = """MATCH (a:Label {key: 'v'})-[:TYPE|OTHER*1..3]->(b) WHERE a.p > 1 AND NOT EXISTS { (a)<-[:CALLS]-() }
RETURN a.name, COUNT(b) AS n ORDER BY n DESC SKIP 0 LIMIT 10. Properties in_degree and out_degree count CALLS."""


def rows(df: DataFrame) -> list[dict]:
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.collect()]


def to_json(result: dict, verbosity: str = "full") -> str:
    """Compact JSON without nulls; ``compact`` keeps the first entries of nested lists."""

    def trim(v, depth=0):
        if isinstance(v, dict):
            return {k: trim(x, depth + 1) for k, x in v.items() if x is not None}
        if isinstance(v, (list, tuple)):
            v = v[:COMPACT] if verbosity == "compact" and depth > 1 else v
            return [trim(x, depth + 1) for x in v]
        return v

    return json.dumps(trim(result), ensure_ascii=False, separators=(",", ":"), default=str)


class Tools:
    """All tools over one folder of projects."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store, self.records = spark, store.Store(spark, root), adr.Records(spark)
        self.roots: dict[str, str] = {}

    def graph(self, project: str) -> Graph:
        if self.store.status(check_project(project)) == "not_found":
            raise LookupError(f"project not found: {project}")
        return self.store.load(project)

    # ------------------------------------------------------------------------------------------- meta

    def list_tools(self, name: str | None = None, category: str | None = None) -> dict:
        return {"tools": [{"name": n, "category": c, "summary": s} for n, (c, s) in CATALOG.items() if name in (None, n) and category in (None, c)]}

    def get_skill_reference(self) -> dict:
        return {"content": REFERENCE}

    # -------------------------------------------------------------------------------------- lifecycle

    def index_repository(self, repo_path: str, project: str | None = None, mode: str | None = None) -> dict:
        if mode == "cross-repo-intelligence":
            raise ValueError("this mode is not supported")
        project = check_project(project or project_name(repo_path))
        found = settle(files.discover(self.spark, repo_path), "found")  # a cache would answer for the files of an earlier call
        hashes = self.store.table(project, "file_hashes")
        prints = found.select(F.lit(project).alias("project"), "rel_path", "sha256", "mtime_ns", "size")
        classified = settle(incremental.classify(prints, hashes), "classified")
        counts = incremental.change_counts(classified).first().asDict()
        kind, reason = incremental.index_mode(hashes.count(), found.count(), counts)
        texts = files.texts(self.spark, repo_path).join(found.select(F.col("rel_path").alias("file_path")), "file_path", "left_semi")
        if kind != "none":
            rows_ = csharp.facts(texts, project)
            if kind == "incremental":
                # files are read and scanned only where they changed; names are resolved over the facts of all
                stale = classified.filter("status in ('changed', 'deleted', 'new')").select(F.col("rel_path").alias("file_path"))
                kept = self.store.table(project, "facts").join(stale, "file_path", "left_anti")
                rows_ = kept.unionByName(csharp.facts(texts.join(stale, "file_path", "left_semi"), project))
            rows_ = settle(rows_, "facts")
            graph = csharp.index_facts(rows_)
            observations = store.detach_observations(self.store.table(project, "observations"), graph).select(*[c.split()[0] for c in OBSERVATION.split(", ")])
            self.store.save(project, graph, file_hashes=prints.select(*[c.split()[0] for c in FILE_HASH.split(", ")]), observations=observations, facts=rows_)
        self.roots[project] = repo_path
        graph = self.store.load(project)
        return {
            "project": project, "status": "indexed", "nodes": graph.nodes.count(), "edges": graph.edges.count(), "root_path": repo_path,
            "index_mode": kind, "fallback_reason": reason, "file_hashes": counts,
        }

    def index_status(self, project: str) -> dict:
        status = self.store.status(project)
        if status == "not_found":
            return {"project": project, "status": status}
        g = self.store.load(project)
        return {"project": project, "status": status, "nodes": g.nodes.count(), "edges": g.edges.count()}

    def list_projects(self) -> dict:
        return {"projects": rows(self.store.projects())}

    def delete_project(self, project: str) -> dict:
        self.records.delete(project)
        return {"project": project, "deleted": self.store.delete(project)}

    # ------------------------------------------------------------------------------------------- query

    def query_graph(self, project: str, query: str, max_rows: int = 0) -> dict:
        return rows_of(cypher(self.graph(project), query, project), max_rows)

    def search_graph(self, project: str, query: str | None = None, label: str | None = None, name_pattern: str | None = None, qn_pattern: str | None = None, file_pattern: str | None = None, case_sensitive: bool = False, limit: int = 10, offset: int = 0, verbosity: str = "full", semantic_query: str | None = None) -> dict:
        if semantic_query:
            raise ValueError("semantic search is not supported")
        g = self.graph(project)
        if query:
            df, order = search.search_text(g, query, label), [F.desc("score"), "qualified_name"]
        else:
            df, order = search.find_nodes(g, label, name_pattern, qn_pattern, file_pattern, case_sensitive), ["qualified_name"]
        hits, total = search.page(df, order, limit, offset)
        hits = hits.join(analytics.degrees(g), "id").orderBy(*order)
        columns = ["name", "qualified_name", "label", "file_path", "start_line", "end_line", "in_degree", "out_degree"]
        out = {"total": total, "has_more": offset + limit < total, "results": rows(hits.select(*columns, *(["properties"] if verbosity == "full" else [])))}
        return out | ({"search_mode": "bm25"} if query else {}) | ({} if total else {"hint": "No matches: try a shorter pattern."})

    def get_code_snippet(self, project: str, qualified_name: str, include_neighbors: bool = False) -> dict:
        g = self.graph(project)
        found, method = g.nodes.filter(F.col("qualified_name") == qualified_name), None
        for method_, other in (("suffix", search.by_suffix(g, qualified_name)), ("name", g.nodes.filter(F.col("name") == qualified_name))):
            if not found.isEmpty():
                break
            found, method = other, method_
        first = found.orderBy("qualified_name").limit(11).collect()
        if not first:
            raise LookupError(f"symbol not found: {qualified_name}")
        if len(first) > 1:
            return {"status": "ambiguous", "suggestions": [r.qualified_name for r in first[:10]]}
        node = first[0].asDict()
        source = None
        if project in self.roots:
            text = files.texts(self.spark, self.roots[project]).filter(F.col("file_path") == node["file_path"])
            got = text.select(snippet(F.col("text"), F.lit(node["start_line"]), F.lit(node["end_line"])).alias("s")).first()
            source = got.s if got else None
        d = analytics.degrees(g, ["CALLS"]).filter(F.col("id") == node["id"]).first()
        out = node | {"source": source, "match_method": method, "callers": d.in_degree, "callees": d.out_degree}
        if include_neighbors:
            out["caller_names"] = [r.name for r in search.neighbour_names(g, node["id"], True).collect()]
            out["callee_names"] = [r.name for r in search.neighbour_names(g, node["id"], False).collect()]
        return out

    def get_graph_schema(self, project: str) -> dict:
        g = self.graph(project)
        labels, types = analytics.schema_counts(g)
        named = lambda counts, df, c: rows(analytics.canonical_kinds(counts.withColumnRenamed(c, "kind"), analytics.property_catalog(df, c)))
        show = lambda xs, c: [{c: x["kind"], "count": x["count"]} | ({"properties_same_as": x["properties_same_as"]} if x.get("properties_same_as") else {"properties": x.get("properties")}) for x in xs]
        return {"columns": [c for c in g.nodes.columns if c != "properties"], "node_labels": show(named(labels, g.nodes, "label"), "label"), "edge_types": show(named(types, g.edges, "type"), "type")}

    def get_architecture(self, project: str, path: str = "", aspects: list[str] | None = None) -> dict:
        whole = self.graph(project)
        g = analytics.scoped(whole, path)
        want = set(ASPECTS if not aspects or "all" in aspects else aspects)
        out: dict = {"total_nodes": g.nodes.count(), "total_edges": g.edges.count()}
        if path:
            out |= {"path": path, "root_total_nodes": whole.nodes.count(), "root_total_edges": whole.edges.count()}
        labels, types = analytics.schema_counts(g)
        bounds = settle(analytics.boundaries(g), "boundaries") if want & {"boundaries", "layers", "packages"} else None
        parts = {
            "structure": lambda: labels, "dependencies": lambda: types, "boundaries": lambda: bounds, "layers": lambda: analytics.layers(g, bounds),
            "packages": lambda: analytics.packages(g, bounds), "languages": lambda: analytics.languages(g), "entry_points": lambda: analytics.entry_points(g),
            "hotspots": lambda: analytics.hotspots(g), "clusters": lambda: community.cluster_report(g, community.communities(g)),
            "file_tree": lambda: analytics.file_tree(g.nodes.filter("label = 'File'")).orderBy("kind", "path").limit(500),
            "runtime": lambda: traces.top(self.store.table(project, "observations")).select("caller", "callee", "route", "method", "count", "error_count", "avg_duration_ms", "p99_duration_ms"),
        }
        for name in ASPECTS:
            if name in want and (found := rows(parts[name]())):
                out[name] = found
        return out

    def trace_path(self, project: str, function_name: str, direction: str = "both", depth: int = 3, mode: str = "calls", risk_labels: bool = False, include_tests: bool = False, edge_types: list[str] | None = None) -> dict:
        g = self.graph(project)
        best = traverse.resolve(g, function_name).filter("best").orderBy("qualified_name").collect()
        if not best:
            return {"error": f"symbol not found: {function_name}"}
        if len(best) > 1:
            return {"status": "ambiguous", "suggestions": [r.qualified_name for r in best[:10]]}
        out = {"function": best[0].qualified_name, "direction": direction_of(direction), "mode": mode}
        if not edge_types_for(mode, edge_types):
            return out | {"note": "this mode has no edges in the graph"}
        found = traverse.trace_path(g, best[0].id, direction_of(direction), clamp_depth(depth), mode, risk_labels, include_tests, edge_types)
        return out | {k: rows(v) for k, v in found.items()}

    def search_code(self, project: str, pattern: str, file_pattern: str | None = None, path_filter: str | None = None, mode: str = "compact", context: int = 0, regex: bool = False, limit: int = 10) -> dict:
        began = time.perf_counter()
        g = self.graph(project)
        lines = search.lines_of(files.texts(self.spark, self.roots[project]).join(g.nodes.select("file_path").distinct(), "file_path", "left_semi"))
        matches = settle(search.grep(lines, pattern, regex, file_pattern, path_filter), "matches")
        hits, raw = search.ranked_hits(g, matches)
        hits = settle(hits, "hits").orderBy(F.desc("score"), "file_path", "start_line", "id")
        n, n_hits, n_raw = matches.count(), hits.count(), raw.count()
        page = hits.limit(limit)
        if mode in ("full", "compact") and (mode == "full" or context):
            texts = files.texts(self.spark, self.roots[project])
            first = F.col("start_line") if mode == "full" else F.greatest(F.element_at("match_lines", 1) - context, F.lit(1))
            last = F.col("end_line") if mode == "full" else F.element_at("match_lines", 1) + context
            page = page.join(texts, "file_path").withColumn("source" if mode == "full" else "context", snippet(F.col("text"), first, last)).drop("text").orderBy(F.desc("score"), "file_path", "start_line")
        out = {
            "results": rows(page.drop("properties", "project")), "raw_matches": rows(raw.limit(search.RAW_CAP)), "directories": rows(search.directories(hits)),
            "total_grep_matches": n, "total_results": n_hits, "raw_match_count": n_raw, "dedup_ratio": f"{n / max(1, n_hits + n_raw):.1f}x",
        }
        if mode == "files":
            out["files"] = list(dict.fromkeys([r["file_path"] for r in out.pop("results")] + [r["file_path"] for r in out.pop("raw_matches")]))
        out["elapsed_ms"] = int((time.perf_counter() - began) * 1000)
        return out | ({"warnings": ["slow search: narrow it with file_pattern or path_filter"]} if out["elapsed_ms"] >= 5000 else {})

    # ---------------------------------------------------------------------------------------- mutation

    def manage_adr(self, project: str, mode: str = "get", content: str | None = None, imported: str | None = None) -> dict:
        return adr.manage(self.records, check_project(project), mode, content, imported)

    def ingest_traces(self, project: str, spans: list[dict]) -> dict:
        g = self.graph(project)
        fields = [c.split()[0] for c in traces.SPAN.split(", ")]
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        raw = [tuple((int(s["count"]) if s.get("count") is not None else None) if f == "count" else text(s.get(f)) for f in fields) for s in spans]
        frame = self.spark.createDataFrame([(*r, i) for i, r in enumerate(raw)], traces.SPAN + ", seq int")
        good, bad = traces.normalise(frame)
        keyed = settle(traces.resolve(good, g), "entries")
        old = self.store.table(project, "observations")
        merged = traces.merge(keyed, old, project=project)
        untouched = old.join(merged.select("project", *traces.KEY), ["project", *traces.KEY], "left_anti").select(*merged.columns)
        self.store.save(project, g, file_hashes=self.store.table(project, "file_hashes"), facts=self.store.table(project, "facts"), observations=merged.unionByName(untouched))
        n, rejected = keyed.count(), bad.count()
        out = {
            "status": "ok", "traces_received": len(spans), "traces_ingested": n, "edges_matched": keyed.filter("calls_edge_id is not null").count(),
            "unresolved": keyed.filter("(caller <> '' and caller_node_id is null) or (callee <> '' and callee_node_id is null)").count(),
        }
        return out | ({"warnings": [f"{rejected} spans name no caller, callee or route"]} if rejected else {})

    def detect_changes(self, project: str, repo_path: str, scope: str = "symbols", depth: int = 2, base_branch: str = "main", since: str | None = None) -> dict:
        if scope not in ("files", "symbols", "impact"):
            return {"error": "invalid_scope"}
        try:
            g = self.graph(project)
            changed = settle(files.changed_files(self.spark, repo_path, base_branch, since), "changes").orderBy("path")
            context = files.git_context(repo_path)
        except LookupError:
            return {"error": "project_not_found"}
        except ValueError:
            return {"error": "invalid_ref"}
        except files.GitError as e:
            return {"error": e.code}
        out = {"changed_files": rows(changed), "changed_count": changed.count(), "depth": depth, "base": since or base_branch, "scope": scope, "head": context["head"], "branch": context["branch"]}
        paths = changed.select(F.col("path").alias("file_path"))
        if scope == "symbols":
            symbols = g.nodes.join(paths, "file_path", "left_semi").filter(~F.col("label").isin("File", "Folder", "Project"))
            out["changed_symbols"] = rows(symbols.select("label", "name", "qualified_name", "file_path").orderBy("qualified_name"))
        elif scope == "impact":
            found = traverse.call_impact(g, paths, depth)
            out["impacted_symbols"] = rows(found.orderBy("hop", "qualified_name").drop("node_id"))
        return out


__all__ = ["CATALOG", "CypherError", "Tools", "to_json"]
