"""Source files: discovery with ignore rules, fingerprints, text and line tables, git changes and context."""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import check_ref, normal_path

SKIP_ALWAYS = (
    ".git .hg .svn .vs .vscode .idea bin obj node_modules packages .nuget TestResults artifacts dist build out target "
    "__pycache__ .venv venv .mypy_cache .pytest_cache coverage .cache .gradle .terraform .next .nuxt .turbo tmp temp logs"
).split()
SKIP_FAST = "docs doc examples samples benchmarks fixtures testdata migrations generated vendor third_party assets wwwroot".split()
SUFFIX_ALWAYS = (".g.cs", ".g.i.cs", ".designer.cs", ".generated.cs", ".assemblyattributes.cs", ".assemblyinfo.cs")
NAMES_FAST = ("globalusings.cs", "assemblyinfo.cs")
PARTS_FAST = ("/generated/", "/obj/", ".snapshot.")


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file, in a folder ``base`` of the tree: the last rule that matches decides."""

    regex: str
    negated: bool


def ignore_rules(text: str, base: str = "") -> list[Rule]:
    out = []
    for raw in text.splitlines():
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only_dir = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        body, i = "", 0
        while i < len(line):
            if line.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif line.startswith("**", i):
                body, i = body + ".*", i + 2
            else:
                body += {"*": "[^/]*", "?": "[^/]"}.get(line[i]) or re.escape(line[i])
                i += 1
        prefix = re.escape(normal_path(base) + "/") if base else ""
        out.append(Rule(f"^{prefix}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if only_dir else '(?:/.*)?'}$", negated))
    return out


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether the last matching rule ignores the path: rules are few, so they fold into one CASE."""
    out = None
    for r in reversed(rules):
        hit = path.rlike(r.regex)
        out = F.when(hit, F.lit(not r.negated)) if out is None else out.when(hit, F.lit(not r.negated))
    return out.otherwise(F.lit(False)) if out is not None else F.lit(False)


def eligible(path: Column, fast: bool = False) -> Column:
    """Paths outside skipped folders and without an ignored suffix, name or part."""
    low = F.lower(path)
    parts = F.split(low, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    skip = [s.lower() for s in SKIP_ALWAYS + (SKIP_FAST if fast else [])]
    bad = F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skip]))
    for s in SUFFIX_ALWAYS:
        bad = bad | F.endswith(low, F.lit(s))
    if fast:
        bad = bad | F.element_at(parts, -1).isin(*NAMES_FAST)
        for s in PARTS_FAST:
            bad = bad | F.contains(F.concat(F.lit("/"), low), F.lit(s))
    return ~bad & F.endswith(low, F.lit(".cs"))


def fingerprints(files: DataFrame, root: str) -> DataFrame:
    """(path, rel_path, size, mtime_ns, sha256) of a ``binaryFile`` table."""
    plain = re.sub(r"^file:/*", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + re.escape(plain) + "/", "")
    return files.select(
        "path", rel.alias("rel_path"), F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("sha256"),
    )


def discover(spark: SparkSession, root: str, fast: bool = False, rules: list[Rule] = (), max_size: int | None = None) -> DataFrame:
    """Fingerprints of the C# files below a root, by relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cs").load(root)
    if max_size is not None:
        files = files.filter(F.col("length") <= max_size)
    out = fingerprints(files, root)
    return out.filter(eligible(F.col("rel_path"), fast) & ~ignored(F.col("rel_path"), list(rules))).orderBy("rel_path")


def texts(spark: SparkSession, root: str, glob: str = "*.cs") -> DataFrame:
    """(file_path, text) of files read whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    plain = re.sub(r"^file:/*", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + re.escape(plain) + "/", "")
    return files.select(rel.alias("file_path"), F.col("content").cast("string").alias("text"))


# -------------------------------------------------------------------------------------------------- git


class GitError(RuntimeError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def git(root: str, *args: str, timeout: int = 60) -> str:
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout)
    except FileNotFoundError:
        raise GitError("git_not_installed") from None
    except subprocess.TimeoutExpired:
        raise GitError("git_timeout") from None
    if run.returncode:
        raise GitError("not_a_git_repo" if "not a git repository" in run.stderr else "git_failed", run.stderr.strip())
    return run.stdout


def name_status(lines: DataFrame) -> DataFrame:
    """(path, status, old_path) from lines of ``git diff --name-status``; malformed lines are dropped."""
    p = F.split("line", "\t")
    code, renamed = F.substring(F.get(p, F.lit(0)), 1, 1), F.startswith(F.get(p, F.lit(0)), F.lit("R"))
    path = F.when(renamed, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1)))
    status = F.when(renamed, "Renamed").when(code == "A", "Added").when(code == "D", "Deleted").otherwise("Modified")
    out = lines.select(path.alias("path"), status.alias("status"), F.when(renamed, F.get(p, F.lit(1))).alias("old_path"))
    return out.filter("path is not null and path <> ''")


def changed_files(spark: SparkSession, root: str, base: str = "main", since: str | None = None) -> DataFrame:
    """(path, status, old_path): the three-dot diff from a base together with the working tree, by path."""
    ref = check_ref(since or base)
    try:
        git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}")
    except GitError as e:
        raise e if e.code != "git_failed" else GitError("base_ref_not_found", ref) from None
    paths = [git(root, "diff", "--name-only", f"{ref}...HEAD"), git(root, "diff", "--name-only", "HEAD"), git(root, "ls-files", "--others", "--exclude-standard")]
    states = [git(root, "diff", "--name-status", "-M100%", f"{ref}...HEAD"), git(root, "diff", "--name-status", "-M100%", "HEAD")]
    frame = lambda text: spark.createDataFrame([(x,) for x in "\n".join(text).splitlines() if x.strip()], "line string")
    every = frame(paths).select(F.col("line").alias("path")).distinct()
    known = name_status(frame(states)).groupBy("path").agg(F.first("status").alias("status"), F.first("old_path").alias("old_path"))
    return every.join(known, "path", "left").withColumn("status", F.coalesce("status", F.lit("Modified"))).orderBy("path")


def git_context(root: str) -> dict:
    """Top level, git and common folders, commit, branch (None where detached) and merge base with upstream."""
    one = lambda *a: git(root, *a).strip()
    branch = one("rev-parse", "--abbrev-ref", "HEAD")
    try:
        upstream = one("merge-base", "HEAD", "@{upstream}")
    except GitError:
        upstream = None
    return {
        "toplevel": one("rev-parse", "--show-toplevel"), "git_dir": one("rev-parse", "--absolute-git-dir"),
        "common_dir": one("rev-parse", "--git-common-dir"), "head": one("rev-parse", "HEAD"),
        "branch": None if branch == "HEAD" else branch, "detached": branch == "HEAD", "merge_base": upstream,
    }
