"""From a parsed query to one lazy DataFrame.

Every MATCH becomes equi-joins of nodes and edges, and clauses meet by a join on the ids of shared variables. An
undirected hop is a union of both orientations, so no join has a disjunctive condition. ``in_degree`` and
``out_degree`` come from one grouped table. EXISTS is a semi- or anti-join where it stands alone in a conjunction and
a joined flag elsewhere. Walks of variable length carry (start, end, number of walks) and are summed at every
level, so their rows are bounded by pairs and not by walks; the multiplicity is put back at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NODE_COLUMNS, SCALARS, Graph
from ..session import settle
from .cypher import Cond, CypherError, Item, NodeP, Pattern, Prop, Query, RelP, parse

MAX_ROWS = 100_000
DEGREES = ("in_degree", "out_degree")
#: Columns of a returned node.
SHOWN = [c for c in NODE_COLUMNS if c != "project"]
#: Walks up to this many hops stay one plan; longer ones are written out at every level.
INLINE_HOPS = 4


def variant(col: Column) -> Column:
    return F.try_parse_json(col)


def json_as(var: str, key: str, kind: str) -> Column:
    path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return F.try_variant_get(variant(F.col(f"{var}__properties")), path, kind)


class Builder:
    def __init__(self, graph: Graph, project: str | None = None):
        self.graph = graph.scoped(project) if project else graph
        self.degrees: dict[str, DataFrame] = {}
        self.bound: set[str] = set()

    # ------------------------------------------------------------------------------------------ pieces

    def node(self, p: NodeP) -> DataFrame:
        df = self.graph.nodes
        if p.labels:
            df = df.filter(F.col("label").isin(p.labels) if len(p.labels) > 1 else F.col("label") == p.labels[0])
        df = df.select(*[F.col(c).alias(f"{p.var}__{c}") for c in NODE_COLUMNS])
        for key, value in p.props.items():
            df = df.filter(self.compare("=", Prop(p.var, key), value))
        return df

    def steps(self, rel: RelP) -> DataFrame:
        """(a, b): from the left node of the pattern to the right one."""
        e = self.graph.edges
        if rel.types:
            e = e.filter(F.col("type").isin(rel.types) if len(rel.types) > 1 else F.col("type") == rel.types[0])
        out = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
        back = e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
        if rel.direction == "out":
            return out
        return back if rel.direction == "in" else out.union(back.filter("a <> b"))

    def walks(self, starts: DataFrame, rel: RelP) -> DataFrame:
        """(a, b) for every walk of ``low`` to ``high`` steps from the ids ``a``, as a bag."""
        steps = self.steps(rel)
        level = starts.select("a", F.col("a").alias("b"), F.lit(1).cast("long").alias("n"))
        found = [level] if rel.low == 0 else []
        hop = steps.select(F.col("a").alias("b"), F.col("b").alias("c"))
        for depth in range(1, rel.high + 1):
            level = level.join(hop, "b").groupBy("a", F.col("c").alias("b")).agg(F.sum("n").alias("n"))
            if rel.high > INLINE_HOPS:
                level = settle(level, "walks")
                if level.isEmpty():
                    break
            if depth >= rel.low:
                found.append(level)
        if not found:
            return starts.select("a", F.col("a").alias("b")).limit(0)
        every = reduce(DataFrame.union, found)
        return every.select("a", "b", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("w")).drop("w")

    def hop(self, df: DataFrame, left: NodeP, rel: RelP, right: NodeP, known: set[str]) -> DataFrame:
        a = F.col(f"{left.var}__id")
        steps = self.walks(df.select(a.alias("a")).distinct(), rel) if rel.variable else self.steps(rel)
        if right.var in known:
            if right.labels or right.props:
                df = df.join(self.node(right).select(F.col(f"{right.var}__id")), f"{right.var}__id", "left_semi")
            b = F.col(f"{right.var}__id")
            return df.join(steps, (a == F.col("a")) & (b == F.col("b"))).drop("a", "b")
        df = df.join(steps, a == F.col("a")).drop("a")
        return df.join(self.node(right), F.col("b") == F.col(f"{right.var}__id")).drop("b")

    def pattern(self, p: Pattern) -> tuple[DataFrame, list[str]]:
        df, known = self.node(p.nodes[0]), {p.nodes[0].var}
        for left, rel, right in zip(p.nodes, p.rels, p.nodes[1:]):
            df = self.hop(df, left, rel, right, known)
            known.add(right.var)
        return df, list(dict.fromkeys(n.var for n in p.nodes))

    def matches(self, patterns: list[Pattern]) -> DataFrame:
        out = None
        for p in patterns:
            df, names = self.pattern(p)
            if out is None:
                out = df
            elif shared := [v for v in names if v in self.bound]:
                drop = [f"{v}__{c}" for v in shared for c in NODE_COLUMNS if c != "id"]
                out = out.join(df.drop(*drop), [f"{v}__id" for v in shared])
            else:
                out = out.crossJoin(df)
            self.bound |= set(names)
        return out

    # -------------------------------------------------------------------------------------- expressions

    def check(self, var: str) -> None:
        if var not in self.bound:
            raise CypherError(f"the variable {var} is not bound")

    def with_degrees(self, df: DataFrame, props: list[Prop]) -> DataFrame:
        """Join the CALLS degrees of every variable that asks for them, from one grouped table each."""
        for var, key in sorted({(p.var, p.key) for p in props if p.key in DEGREES}):
            self.check(var)
            end = "target_id" if key == "in_degree" else "source_id"
            counts = self.graph.edges.filter(F.col("type") == "CALLS").groupBy(F.col(end).alias("__d"))
            counts = counts.agg(F.count(F.lit(1)).alias(f"{var}__{key}"))
            df = df.join(counts, F.col(f"{var}__id") == F.col("__d"), "left").drop("__d")
        return df

    def value(self, p: Prop, kind: str | None = None) -> Column:
        """A property; one kept in JSON has ``kind``, or a string form where no kind is asked for."""
        if p.key is None:
            return F.col(f"{p.var}__id")
        if p.key in DEGREES:
            return F.coalesce(F.col(f"{p.var}__{p.key}"), F.lit(0).cast("long"))
        if p.key in SCALARS:
            return F.col(f"{p.var}__{p.key}")
        return json_as(p.var, p.key, kind or "string")

    def compare(self, op: str, p: Prop, value: object) -> Column:
        """Values of another type than the literal are null and so never match."""
        stored = p.key is not None and p.key not in SCALARS and p.key not in DEGREES
        text_column = p.key in ("name", "qualified_name", "label", "file_path")
        if stored:
            kind = "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "double"
            found = F.schema_of_variant(json_as(p.var, p.key, "variant"))
            fits = found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") if kind == "double" else found == kind.upper()
            left = F.when(fits, self.value(p, kind))
        else:
            left = self.value(p)
            if text_column:
                value = {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else str(value)
            elif isinstance(value, str):
                left = left.cast("string")
        right = F.lit(float(value) if stored and isinstance(value, int) and not isinstance(value, bool) else value)
        return {
            "=": lambda: left == right, "<>": lambda: left != right, "<": lambda: left < right, "<=": lambda: left <= right,
            ">": lambda: left > right, ">=": lambda: left >= right,
        }[op]()

    def condition(self, c: Cond, flags: list[tuple[str, Cond]]) -> Column:
        if c.op in ("and", "or", "xor"):
            a, b = self.condition(c.left, flags), self.condition(c.right, flags)
            return a & b if c.op == "and" else a | b if c.op == "or" else a != b
        if c.op == "not":
            return ~self.condition(c.left, flags)
        if c.op == "exists":
            flags.append((f"__exists{len(flags)}", c))
            return F.coalesce(F.col(flags[-1][0]), F.lit(False))
        self.check(c.left.var)
        if c.op == "label":
            return F.col(f"{c.left.var}__label") == c.right
        if c.op == "isnull":
            return self.value(c.left).isNull()
        if c.op == "in":
            if not c.right:
                return F.lit(False)
            return reduce(lambda a, b: a | b, [self.compare("=", c.left, v) for v in c.right])
        if c.op in ("=~", "contains", "starts", "ends"):
            text = self.value(c.left, "string").cast("string")
            if c.op == "=~":
                return F.coalesce(text.rlike(str(c.right)), F.lit(False)) if c.right != "" else F.lit(False)
            return {"contains": text.contains, "starts": text.startswith, "ends": text.endswith}[c.op](str(c.right))
        return self.compare(c.op, c.left, c.right)

    def witnesses(self, p: Pattern) -> tuple[str, DataFrame]:
        """The bound variable of an EXISTS pattern and the distinct ids ``__w`` for which it holds."""
        left, right, rel = p.nodes[0], p.nodes[1], p.rels[0]
        if left.var not in self.bound:
            left, right = right, left
            rel = RelP(rel.types, {"out": "in", "in": "out", "any": "any"}[rel.direction])
        self.check(left.var)
        steps = self.steps(rel)
        if right.var in self.bound:
            raise CypherError("EXISTS between two bound variables is not supported")
        if right.labels or right.props:
            steps = steps.join(self.node(right), F.col("b") == F.col(f"{right.var}__id"), "left_semi")
        ids = steps.select(F.col("a").alias("__w")).distinct()
        if left.labels or left.props:
            ids = ids.join(self.node(left), F.col("__w") == F.col(f"{left.var}__id"), "left_semi")
        return left.var, ids

    def where(self, df: DataFrame, c: Cond) -> DataFrame:
        if c.op == "and":
            return self.where(self.where(df, c.left), c.right)
        inner, kind = (c.left, "left_anti") if c.op == "not" else (c, "left_semi")
        if inner.op == "exists":
            var, ids = self.witnesses(inner.left)
            return df.join(ids, F.col(f"{var}__id") == F.col("__w"), kind)
        flags: list[tuple[str, Cond]] = []
        test = self.condition(c, flags)
        for name, cond in flags:
            var, ids = self.witnesses(cond.left)
            df = df.join(ids.withColumn(name, F.lit(True)), F.col(f"{var}__id") == F.col("__w"), "left").drop("__w")
        return df.filter(test)

    # ------------------------------------------------------------------------------------------ results

    def aggregate(self, item: Item) -> Column:
        if item.prop is None:
            return F.count(F.lit(1))
        stored = item.prop.key is not None and item.prop.key not in SCALARS and item.prop.key not in DEGREES
        if item.fn in ("COUNT", "COLLECT"):
            v = self.value(item.prop)
            if item.fn == "COUNT":
                return F.count_distinct(v) if item.distinct else F.count(v)
            return F.collect_set(v) if item.distinct else F.collect_list(v)
        v = self.value(item.prop, "double" if stored else None)
        if item.fn in ("SUM", "AVG"):
            v = v.cast("double") if item.prop.key in ("name", "qualified_name", "label", "file_path") else v
            fn = (F.sum_distinct if item.distinct else F.sum) if item.fn == "SUM" else F.avg
            return F.avg_distinct(v) if item.fn == "AVG" and item.distinct else fn(v)
        return {"MIN": F.min, "MAX": F.max}[item.fn](v)

    def scalar(self, item: Item) -> Column:
        if item.kind == "func":
            text = self.value(item.prop).cast("string")
            return {"toLower": F.lower, "toUpper": F.upper, "toString": lambda c: c}[item.fn](text)
        return self.value(item.prop)

    def expand(self, items: list[Item]) -> list[tuple[str, Item]]:
        """Result columns in order: whole nodes become their columns, ``n_id`` and so on."""
        out = []
        for item in items:
            if item.kind == "star":
                out += self.expand([Item("prop", Prop(v, None), alias=v) for v in sorted(self.bound) if not v.startswith("_a")])
            elif item.kind == "prop" and item.prop.key is None:
                self.check(item.prop.var)
                out += [(f"{item.alias}_{c}", Item("prop", Prop(item.prop.var, c))) for c in SHOWN]
            else:
                if item.prop:
                    self.check(item.prop.var)
                out.append((item.alias, item))
        return out

    def output(self, item: Item) -> Column:
        if item.kind == "prop" and item.prop.key in ("id", "properties"):
            return F.col(f"{item.prop.var}__{item.prop.key}")
        return self.scalar(item)

    def sort_keys(self, item: Item) -> list[Column]:
        """A JSON property sorts as a number where it is one, then as text."""
        if item.kind == "prop" and item.prop.key and item.prop.key not in (*SCALARS, *DEGREES, "id", "properties"):
            return [self.value(item.prop, "double"), self.value(item.prop)]
        return [self.output(item)]

    def single(self, q: Query) -> DataFrame:
        self.bound = set()
        df = self.matches(q.patterns)
        items = self.expand(q.items or [Item("prop", Prop(q.patterns[0].nodes[0].var, None), alias=q.patterns[0].nodes[0].var)])
        props = [i.prop for _, i in items if i.prop] + [k.item.prop for k in q.order if k.item and k.item.prop] + _props(q.where)
        df = self.with_degrees(df, props)
        if q.where:
            df = self.where(df, q.where)
        names = [n for n, _ in items]
        grouped = any(i.kind == "agg" for _, i in items)
        by_name = dict(items)
        keys: list[tuple[list[Column], bool]] = []
        extra: dict[str, Column] = {}
        for n, k in enumerate(q.order):
            target = by_name.get(k.alias) if k.alias else next((i for i in by_name.values() if (i.kind, i.fn, i.distinct, i.prop) == (k.item.kind, k.item.fn, k.item.distinct, k.item.prop)), k.item)
            target = target or k.item
            name = next((m for m, i in items if i is target), None)
            if target.kind == "agg":
                if name is None:
                    extra[f"__k{n}"] = self.aggregate(target)
                keys.append(([F.col(f"`{name}`") if name else F.col(f"__k{n}")], k.desc))
            else:
                if target.prop:
                    self.check(target.prop.var)
                cols = self.sort_keys(target)
                for j, c in enumerate(cols):
                    extra[f"__k{n}_{j}"] = c
                keys.append(([F.col(f"__k{n}_{j}") for j in range(len(cols))], k.desc))
        if grouped:
            plain = [(n, self.output(i)) for n, i in items if i.kind != "agg"]
            order_plain = {n: c for n, c in extra.items() if "_" in n[3:]}
            group = [c.alias(n) for n, c in plain] + [c.alias(n) for n, c in order_plain.items()]
            aggs = [self.aggregate(i).alias(n) for n, i in items if i.kind == "agg"]
            aggs += [c.alias(n) for n, c in extra.items() if n not in order_plain]
            df = df.groupBy(*group).agg(*aggs)
        else:
            df = df.select(*[self.output(i).alias(n) for n, i in items], *[c.alias(n) for n, c in extra.items()])
        if q.distinct:
            df = df.dropDuplicates(names)
        if keys:
            df = df.orderBy(*[c.desc_nulls_last() if desc else c.asc_nulls_first() for cols, desc in keys for c in cols])
        if q.skip:
            df = df.offset(q.skip)
        if q.limit:
            df = df.limit(q.limit)
        return df.select(*[F.col(f"`{n}`") for n in names])

    def query(self, q: Query) -> DataFrame:
        out = self.single(q)
        while q.union:
            every, q = q.union_all, q.union
            part = self.single(q)
            if len(part.columns) != len(out.columns):
                raise CypherError("the parts of a UNION return different numbers of columns")
            out = out.union(part)
            out = out if every else out.distinct()
        return out


def _props(c: Cond | None) -> list[Prop]:
    if c is None:
        return []
    if c.op in ("and", "or", "xor"):
        return _props(c.left) + _props(c.right)
    if c.op == "not":
        return _props(c.left)
    return [c.left] if isinstance(c.left, Prop) else []


def cypher(graph: Graph, text: str, project: str | None = None) -> DataFrame:
    """The result of a query as a lazy DataFrame."""
    return Builder(graph, project).query(parse(text))


def rows_of(df: DataFrame, max_rows: int = 0) -> dict:
    """Columns and rows as strings (null is empty) with a hint for no rows; more than ``max_rows`` is an error."""
    most = max_rows or MAX_ROWS
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise CypherError(f"the query returns more than {most} rows; add LIMIT or narrow the pattern")

    def text(v) -> str:
        return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    out = {"columns": df.columns, "rows": [[text(v) for v in r] for r in rows], "total": len(rows)}
    if not rows:
        out["hint"] = "No rows. Check labels, relationship types and property names against the graph's schema."
    return out
