"""Runtime traces: normalised spans, resolution to the graph, and the keyed merge.

The merge is an ordered fold per key (an average that skips calls without duration, the last 100 samples), so it is
written as sums and ordered slices that need no row-by-row state: see ``merge``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import duration_ms, is_error, resolution_score, url_path
from ..schema import Graph

KEY = ["caller", "callee", "service", "target_service", "route", "method"]
SAMPLES = 100
SPAN = (
    "caller string, parent string, parent_span_name string, callee string, name string, span_name string, service string, "
    "target_service string, route string, method string, status_code string, duration_ms string, duration_ns string, "
    "start_time string, end_time string, count int, timestamp string, attributes string, resource string"
)


def attribute_map(column: str):
    """JSON attributes as a map of strings: an object, or an array of {key, value} with plain or typed values."""
    c = F.col(column)
    pairs = F.from_json(c, "array<struct<key:string,value:string>>")
    value = lambda v: F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in ("stringValue", "intValue", "doubleValue", "boolValue")], v)
    listed = F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["key"].isNotNull()), lambda p: F.struct(p["key"].alias("key"), value(p["value"]).alias("value"))))
    plain = F.from_json(c, "map<string,string>")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.when(F.startswith(F.ltrim(c), F.lit("[")), listed), plain, empty)


def normalise(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trace entries, and the spans that name no caller, callee or route. Span attributes hide those of the resource.

    caller, callee and service fall back where absent; method, route and status where empty too. A column ``seq`` of the
    spans stays.
    """
    a = F.map_concat(F.map_filter(attribute_map("resource"), lambda k, v: ~F.array_contains(F.map_keys(F.col("__a")), k)), F.col("__a"))
    df = spans.withColumn("__a", attribute_map("attributes")).withColumn("__m", a)
    at = lambda k: F.element_at("__m", k)
    full = lambda c: F.when(F.trim(c) != "", c)
    first = lambda *cs: F.coalesce(*cs, F.lit(""))
    status = F.coalesce(full(F.col("status_code")), full(at("http.status_code")), full(at("http.response.status_code")))
    out = df.select(
        first(F.col("caller"), F.col("parent"), F.col("parent_span_name")).alias("caller"),
        first(F.col("callee"), F.col("name"), F.col("span_name")).alias("callee"),
        first(F.col("service"), at("service.name")).alias("service"),
        first(F.col("target_service"), at("peer.service")).alias("target_service"),
        first(*[full(c) for c in (F.col("route"), at("http.route"), at("http.target"), at("url.path"), url_path(at("url.full")))]).alias("route"),
        first(*[full(c) for c in (F.col("method"), at("http.method"), at("http.request.method"))]).alias("method"),
        status.alias("status_code"),
        duration_ms(F.col("duration_ms"), F.col("duration_ns"), F.col("start_time"), F.col("end_time")).alias("duration_ms"),
        F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)).alias("count"),
        F.col("timestamp"),
        F.to_json("__m").alias("attributes"),
        *([F.col("seq")] if "seq" in spans.columns else []),
    )
    blank = (F.trim("caller") == "") & (F.trim("callee") == "") & (F.trim("route") == "")
    return out.filter(~blank), out.filter(blank)


def resolve(entries: DataFrame, graph: Graph) -> DataFrame:
    """Add caller_node_id, callee_node_id and calls_edge_id (null where unknown): the best node by name, else by
    qualified name. One lookup table of best nodes, joined twice."""
    score = resolution_score(F.col("label"), F.col("start_line"), F.col("end_line"))
    best = lambda key: graph.nodes.groupBy(F.col(key).alias("__key")).agg(F.max_by("id", F.struct(score, -F.col("id"))).alias("__id"))
    by_name, by_qn = best("name"), best("qualified_name")
    out = entries
    for side in ("caller", "callee"):
        for table, name in ((by_name, "__a"), (by_qn, "__b")):
            out = out.join(table.select(F.col("__key"), F.col("__id").alias(name)), F.col(side) == F.col("__key"), "left").drop("__key")
        out = out.withColumn(f"{side}_node_id", F.coalesce("__a", "__b")).drop("__a", "__b")
    calls = graph.edges.filter("type = 'CALLS'").groupBy("source_id", "target_id").agg(F.min("id").alias("calls_edge_id"))
    on = (F.col("caller_node_id") == F.col("source_id")) & (F.col("callee_node_id") == F.col("target_id"))
    return out.join(calls, on, "left").drop("source_id", "target_id")


def merge(entries: DataFrame, stored: DataFrame | None = None, seq: str = "seq", project: str = "", zero: bool = False) -> DataFrame:
    """Observations after entries in order of ``seq``, on top of stored ones.

    count adds up; error_count adds the counts of status 400 and above. The running average is
    avg(i) = (avg(i-1) * n(i-1) + ms * c) / n(i) where ms > 0 and avg(i-1) elsewhere; times its count, it changes at a
    call without duration by the factor n(i) / n(i-1), so it is the sum of ms * c, each times the product of the later
    factors: a product over a window, as a sum of logarithms. Samples are the last 100 of rounded durations, each
    repeated by its count; p99 is read from them. Ids keep their last known value, last_seen and attributes their last.
    ``zero`` takes a duration of zero (null too) as measured; the reference takes it as absent.

    Nothing but the average of a key with calls without duration needs all its entries in order, and only that brings
    them into one task: the sums are added up where the entries are, and no task passes on more than the last 100 of a key.
    The frames of windows run from the latest entry back: one from a row to the end of its key is added up anew by each row.
    """
    e = entries.withColumn("project", F.lit(project))
    if "caller_node_id" not in e.columns:
        e = e.withColumns({c: F.lit(None).cast("long") for c in ("caller_node_id", "callee_node_id", "calls_edge_id")})
    key = ["project", *KEY]
    ms = F.coalesce("duration_ms", F.lit(0.0))
    base = e.select(
        *key, F.col(seq).alias("__seq"), F.col("count").cast("long").alias("__c"), ms.alias("__ms"), F.when(is_error(F.col("status_code")), F.col("count")).otherwise(0).cast("long").alias("__err"),
        F.col("timestamp").alias("__seen"), F.col("attributes").alias("__attr"), "caller_node_id", "callee_node_id", "calls_edge_id", F.lit(None).cast("array<long>").alias("__held"),
    )
    if stored is not None:  # a stored row is the first entry of its key: its mean, its count, its samples
        base = base.unionByName(stored.select(
            *key, F.lit(None).cast(e.schema[seq].dataType).alias("__seq"), F.col("count").alias("__c"), F.col("avg_duration_ms").alias("__ms"), F.col("error_count").alias("__err"),
            F.col("last_seen").alias("__seen"), F.col("attributes").alias("__attr"), "caller_node_id", "callee_node_id", "calls_edge_id", F.col("duration_samples").alias("__held"),
        ))
    measured = F.col("__ms") >= 0 if zero else F.col("__ms") > 0
    base = base.withColumn("__has", measured | F.col("__held").isNotNull())
    by_seq = F.struct(F.col("__seq").isNotNull(), F.col("__seq"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), by_seq)).alias(c)
    part = F.when(F.col("__ms") > 0, F.col("__ms") * F.col("__c")).otherwise(0.0)
    sums = base.groupBy(*key).agg(
        last("caller_node_id"), last("callee_node_id"), last("calls_edge_id"),
        F.sum("__c").alias("count"), F.sum("__err").alias("error_count"), (F.sum(part) / F.sum("__c")).alias("__plain"),
        F.max_by("__seen", by_seq).alias("last_seen"), F.max_by("__attr", by_seq).alias("attributes"),
    )
    own = W.partitionBy(*key)
    latest = own.orderBy(F.desc_nulls_last("__seq"), F.col("__held").isNotNull(), "__ms", "__c")
    # an entry has a sample at least, so the last SAMPLES entries have all that count
    ends = base.filter("__has and (__c > 0 or __held is not null)").select(*key, "__seq", "__held", "__ms", "__c").withColumn("__k", F.row_number().over(latest)).filter(F.col("__k") <= SAMPLES)
    repeated = lambda x: F.array_repeat(F.floor(x["__ms"] + 0.5).cast("long"), F.least(x["__c"], F.lit(SAMPLES).cast("long")).cast("int"))
    ends = ends.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("__k")).alias("k"), "__held", "__ms", "__c"))).alias("__e"))
    ends = ends.select(*key, F.flatten(F.transform("__e", lambda x: F.coalesce(x["__held"], repeated(x)))).alias("__s"))
    samples = F.coalesce(F.slice("__s", F.greatest(F.lit(1), F.size("__s") - (SAMPLES - 1)), F.lit(SAMPLES)), F.array().cast("array<long>"))
    later = latest.rowsBetween(W.unboundedPreceding, -1)
    run = _beside(base.select(*key, "__seq", "__held", "__ms", "__c", "__has"), base.filter("not __has").select(*key).distinct(), key, "left_semi")
    run = run.withColumn("__n", F.sum("__c").over(own) - F.coalesce(F.sum("__c").over(later), F.lit(0).cast("long")))
    grow = F.when(F.col("__has") | (F.col("__n") == F.col("__c")), F.lit(0.0)).otherwise(F.log(F.col("__n") / (F.col("__n") - F.col("__c"))))
    factor = F.exp(F.coalesce(F.sum(grow).over(later), F.lit(0.0)))
    mean = run.withColumn("__part", part * factor).groupBy(*key).agg((F.sum("__part") / F.sum("__c")).alias("__mean"))
    out = _beside(_beside(sums, ends, key, "left"), mean, key, "left").withColumn("avg_duration_ms", F.coalesce("__mean", "__plain"))
    return out.withColumn("duration_samples", samples).withColumn("p99_duration_ms", p99(F.col("duration_samples"))).select(
        *key, "caller_node_id", "callee_node_id", "calls_edge_id", "count", "error_count", "avg_duration_ms", "p99_duration_ms", "last_seen", "duration_samples", "attributes",
    )


def _beside(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    """A join on keys, in which nulls are equal as in a grouping."""
    right = right.withColumnsRenamed({k: f"__k_{k}" for k in key})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key])
    return left.join(right, on, how).drop(*[f"__k_{k}" for k in key])


def p99(samples):
    """The value at place min(floor(0.99 n), n - 1) of the sorted samples; 0 without any."""
    n = F.size(samples)
    return F.coalesce(F.get(F.array_sort(samples), F.least(F.floor(n * 0.99).cast("int"), n - 1)).cast("double"), F.lit(0.0))


def top(observations: DataFrame, limit: int = 10) -> DataFrame:
    return observations.orderBy(F.desc("count"), F.desc("avg_duration_ms"), *KEY).limit(limit)
