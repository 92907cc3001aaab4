"""Search: regex and label filters with paging, BM25 over an inverted index, and line search mapped to symbols."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import camel_split, glob_regex, search_score, words_regex
from ..schema import Graph
from .analytics import degrees

K1, B = 1.2, 0.75
GREP_CAP, RAW_CAP, LINES_CAP = 500, 20, 64
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def find_nodes(graph: Graph, label: str | None = None, name: str | None = None, qualified_name: str | None = None, file_path: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """Nodes that pass all given filters: ``label`` exactly, the others as unanchored regular expressions."""
    df = graph.nodes
    if label:
        df = df.filter(F.col("label") == label)
    for column, pattern in (("name", name), ("qualified_name", qualified_name), ("file_path", file_path)):
        if pattern:
            df = df.filter(F.coalesce(F.col(column).rlike(pattern if case_sensitive else f"(?i){pattern}"), F.lit(False)))
    return df


def page(df: DataFrame, order: list, limit: int = 10, offset: int = 0) -> tuple[DataFrame, int]:
    """One page and the number of all rows."""
    return df.orderBy(*order).offset(max(0, offset)).limit(limit), df.count()


def by_suffix(graph: Graph, suffix: str) -> DataFrame:
    qn = F.col("qualified_name")
    return graph.nodes.filter(F.endswith(F.lower(qn), F.lit("." + suffix.lower())) | (qn == suffix)).orderBy("qualified_name")


def neighbour_names(graph: Graph, node_id: int, inbound: bool, limit: int = 20) -> DataFrame:
    """Distinct names of callers or callees over the three call types."""
    own, other = ("target_id", "source_id") if inbound else ("source_id", "target_id")
    e = graph.edges.filter(F.col("type").isin("CALLS", "HTTP_CALLS", "ASYNC_CALLS") & (F.col(own) == node_id))
    return e.select(F.col(other).alias("id")).join(graph.nodes.select("id", "name"), "id").select("name").distinct().orderBy("name").limit(limit)


# --------------------------------------------------------------------------------------------- full text


def terms(text) -> DataFrame:
    folded = F.translate(F.lower(text), *map(str, _ACCENTS))
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(nodes: DataFrame) -> DataFrame:
    """(id, term, tf, size): the inverted index over camel-split names and plain label and path."""
    text = F.concat_ws(" ", camel_split(F.col("name")), camel_split(F.col("qualified_name")), "label", "file_path")
    tokens = nodes.select("id", terms(text).alias("t"))
    return tokens.select("id", F.size("t").alias("size"), F.explode("t").alias("term")).groupBy("id", "size", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, n_docs: int, mean_size: float, query: str) -> DataFrame:
    """(id, score) of the nodes that hold all words of ``query``; ``word*`` stands for all terms it begins."""
    words = [w for w in re.split(r"[^\w*]+", query.lower()) if w.strip("*")]
    if not words or not n_docs:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    out = None
    for k, word in enumerate(words):
        stem = word.rstrip("*")
        hit = F.startswith("term", F.lit(stem)) if word.endswith("*") else F.col("term") == stem
        rows = index.filter(hit).groupBy("id", "size").agg(F.sum("tf").alias("tf"))
        df = rows.groupBy().agg(F.count(F.lit(1)).alias("df"))  # a single count
        idf = F.greatest(F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        norm = F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean_size))
        part = rows.crossJoin(F.broadcast(df)).select("id", (idf * F.col("tf") * (K1 + 1) / norm).alias(f"s{k}"))
        out = part if out is None else out.join(part, "id")
    return out.select("id", sum((F.col(f"s{k}") for k in range(len(words))), F.lit(0.0)).alias("score"))


def search_text(graph: Graph, query: str, label: str | None = None, file_path: str | None = None) -> DataFrame:
    """BM25 hits with the nodes' columns, best first, then by qualified name."""
    index = postings(graph.nodes)
    stats = index.select("id", "size").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    hits = bm25(index, stats.n, stats.mean or 1.0, query)
    return find_nodes(graph, label=label, file_path=file_path).join(hits, "id").orderBy(F.desc("score"), "qualified_name")


# ------------------------------------------------------------------------------------------ code search


def lines_of(texts: DataFrame) -> DataFrame:
    """(file_path, line, content) from (file_path, text): 1-based; a final line end adds no line."""
    parts = F.split(F.regexp_replace("text", r"(\r\n|\r|\n)$", ""), "\r\n|\r|\n", -1)
    return texts.select("file_path", F.posexplode(parts).alias("p", "content")).select("file_path", (F.col("p") + 1).alias("line"), "content")


def grep(lines: DataFrame, pattern: str, regex: bool = False, file_glob: str | None = None, path_regex: str | None = None, cap: int | None = GREP_CAP) -> DataFrame:
    """Matching lines in (file, line) order. The path filters run before the content is looked at."""
    df = lines
    if file_glob:
        df = df.filter(F.col("file_path").rlike(glob_regex(file_glob)))
    if path_regex:
        try:
            re.compile(path_regex)
            df = df.filter(F.col("file_path").rlike(path_regex))
        except re.error:
            pass  # an invalid path filter filters nothing
    if regex:
        re.compile(pattern)
        df = df.filter(F.col("content").rlike(pattern))
    elif len(pattern.split()) > 1:
        df = df.filter(F.col("content").rlike(words_regex(pattern)))
    else:
        df = df.filter(F.contains("content", F.lit(pattern)))
    df = df.orderBy("file_path", "line")
    return df.limit(cap) if cap else df


def enclosing(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each match with its tightest enclosing node (``id`` null where there is none): an equi-join on the file with a
    range as residual, then the smallest span by a grouped minimum."""
    n = nodes.select("id", F.col("file_path").alias("f"), "start_line", "end_line")
    hit = (F.col("file_path") == F.col("f")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    joined = matches.join(n, hit, "left")
    best = F.min(F.when(F.col("id").isNotNull(), F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "id")))
    return joined.groupBy("file_path", "line", "content").agg(best.alias("b")).select("file_path", "line", "content", "b.id")


def ranked_hits(graph: Graph, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by search score with their first ``LINES_CAP`` match lines, and the matches outside all nodes."""
    mapped = enclosing(matches, graph.nodes)
    lines = mapped.filter("id is not null").groupBy("id").agg(F.slice(F.sort_array(F.collect_set("line")), 1, LINES_CAP).alias("match_lines"), F.count(F.lit(1)).alias("n_matches"))
    hits = lines.join(graph.nodes, "id").join(degrees(graph, ["CALLS"]), "id")
    score = search_score(F.col("in_degree"), F.col("label"), F.col("file_path"))
    return hits.withColumn("score", score).orderBy(F.desc("score"), "file_path", "start_line", "id"), mapped.filter("id is null").drop("id").orderBy("file_path", "line")


def directories(hits: DataFrame) -> DataFrame:
    return hits.groupBy(F.get(F.split("file_path", "/"), F.lit(0)).alias("directory")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "directory")


def tightest(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``enclosing`` but by a window, for callers that want all node columns."""
    hit = (matches["file_path"] == nodes["file_path"]) & matches["line"].between(nodes["start_line"], nodes["end_line"])
    rank = F.row_number().over(W.partitionBy(matches["file_path"], matches["line"]).orderBy(nodes["end_line"] - nodes["start_line"], nodes["id"]))
    return matches.join(nodes, hit).withColumn("__r", rank).filter("__r = 1").drop("__r")
