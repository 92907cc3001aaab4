"""Column expressions: names, paths, packages, scores, durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST_MARKS = ("/test/", "/tests/", "_test.", ".test.", ".spec.", "tests/")
VENDOR_MARKS = ("/vendor/", "/node_modules/", "/third_party/", "/packages/")


def camel_split(s: Column) -> Column:
    """``s`` and ``s`` with a space before each upper-case letter that starts a word."""
    return F.concat_ws(" ", s, F.regexp_replace(s, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))


def package_of(qn: Column) -> Column:
    """Third segment of a name with four or more; else the second; else empty. Segments of 1 to 255 characters."""
    parts = F.split(qn, r"\.")
    ok = lambda c: (F.length(c) >= 1) & (F.length(c) <= 255)
    second = F.when((F.size(parts) >= 2) & ok(F.get(parts, F.lit(1))), F.get(parts, F.lit(1))).otherwise("")
    return F.when((F.size(parts) >= 4) & ok(F.get(parts, F.lit(2))), F.get(parts, F.lit(2))).otherwise(second)


def top_package_of(qn: Column) -> Column:
    return F.coalesce(F.get(F.split(qn, r"\."), F.lit(1)), F.lit(""))


def risk_of(hop: Column) -> Column:
    return F.when(hop == 1, "CRITICAL").when(hop == 2, "HIGH").when(hop == 3, "MEDIUM").otherwise("LOW")


def any_of(c: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(c, F.lit(m))
    return out


def is_test_path(path: Column) -> Column:
    return any_of(F.lower(path), TEST_MARKS)


def resolution_score(label: Column, start: Column, end: Column) -> Column:
    rank = F.when(label.isin("Method", "Constructor"), 2).when(label.isin("File", "Namespace"), 0).otherwise(1)
    return rank * 1_000_000 + F.greatest(F.lit(0), end - start)


def search_score(in_degree: Column, label: Column, path: Column) -> Column:
    return (
        in_degree
        + F.when(label.isin("Method", "Constructor"), 10).otherwise(0)
        - F.when(any_of(path, VENDOR_MARKS), 50).otherwise(0)
        - F.when(is_test_path(path), 5).otherwise(0)
    )


def ascii_only(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7F]", "?")


def url_path(url: Column) -> Column:
    """From the third slash to the query string; empty where there is none."""
    return F.regexp_extract(url, r"^[^/]*/[^/]*/[^/]*(/[^?]*)", 1)


def duration_ms(ms: Column, ns: Column, start: Column, end: Column) -> Column:
    number = lambda c: F.expr("null") if c is None else c.try_cast("double")
    span = (end.try_cast("double") - start.try_cast("double")) / 1e6
    return F.coalesce(number(ms), number(ns) / 1e6, F.when(span >= 0, span), F.lit(0.0))


def is_error(status: Column) -> Column:
    return F.coalesce(status.try_cast("int") >= 400, F.lit(False))


def in_path(path: Column, scope: str) -> Column:
    scope = normal_path(scope)
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1) of a text."""
    return F.array_join(F.slice(F.split(text, "\r\n|\r|\n", -1), F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")


# ------------------------------------------------------------------------------- driver-side helpers


def normal_path(path: str) -> str:
    path = re.sub(r"/+", "/", (path or "").strip().replace("\\", "/"))
    while path.startswith("./"):
        path = path[2:]
    return path.strip("/")


def glob_regex(glob: str) -> str:
    """An anchored pattern: ``**`` crosses folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            ch = glob[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(ch) or re.escape(ch)
            i += 1
    return f"^{out}$"


def words_regex(text: str) -> str:
    """Several words become a pattern that finds them in order on a line; one stays a literal."""
    return ".*".join(re.escape(w) for w in text.split())


def edge_types_for(mode: str, explicit: list[str] | None = None) -> list[str]:
    if explicit:
        return list(explicit)
    return {"cross_service": [], "data_flow": ["CALLS", "USAGE", "WRITES"]}.get(mode, ["CALLS"])


def clamp_depth(depth: int | None, default: int = 3) -> int:
    return min(max(default if depth is None else depth, 1), 5)


def direction_of(text: str | None) -> str:
    return {"in": "inbound", "inbound": "inbound", "callers": "inbound", "out": "outbound", "outbound": "outbound", "callees": "outbound"}.get((text or "").lower(), "both")


def project_name(path: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "-", path.strip().strip("/\\")).strip("-") or "project"


def branch_slug(branch: str) -> str:
    return re.sub(r"-{2,}", "-", re.sub(r"[^a-z0-9]+", "-", branch.strip().lower())).strip("-") or "detached"


def branch_project(project: str, branch: str) -> str:
    return f"{project}@{branch_slug(branch)}"


def file_qualified_name(project: str, rel_path: str) -> str:
    return f"{project}." + re.sub(r"\.cs$", "", normal_path(rel_path)).replace("/", ".")


def check_project(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._@-]{0,254}", name or "") or ".." in name:
        raise ValueError(f"invalid project name: {name!r}")
    return name


def check_search_path(path: str) -> str:
    if "\0" in path or path.startswith(("/", "~")) or re.match(r"[A-Za-z]:", path) or ".." in path.split("/"):
        raise ValueError(f"invalid search path: {path!r}")
    return normal_path(path)


def check_ref(ref: str) -> str:
    if not ref or ref.startswith("-") or ".." in ref or not re.fullmatch(r"[A-Za-z0-9._/@{}^~-]{1,255}", ref):
        raise ValueError(f"invalid git reference: {ref!r}")
    return ref
